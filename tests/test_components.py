"""Components by rounds of joins are those of a sequential union-find."""

import random

from binledger.functions.components import connected_components


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    pairs += [(7, 7), (None, 3), (500, 501), (501, 500)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
