import hashlib
import random
from collections import defaultdict

import numpy as np

from binledger.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    kept = [
        (i, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], label)
        for i, v, label, *_ in rows
        if v and all(x is not None and np.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1]) // 8

    def part(v, p):
        return v[p * size : (p + 1) * size]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    for _ in range(6):
        for p in range(8):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(books[p], part(v, p))[1]].append(part(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    per_label, out = defaultdict(int), []
    for i, v, label in kept:
        found = [nearest(books[p], part(v, p)) for p in range(8)]
        error = sum(d for d, _ in found)
        per_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, per_label[label], sha) for i, c, e, label in out), key=repr)


def vectors(n, width, dice, grid):
    return [
        (i, [dice.choice(grid) if dice.random() < 0.7 else dice.uniform(-2, 2) for _ in range(width)], dice.choice([0, 1, None]), "x")
        for i in range(n)
    ]


def test_equals_brute_force(spark):
    dice = random.Random(1)
    for n, width, grid in [(90, 16, [0.0, 0.5, -0.25]), (40, 8, [0.1, -0.1]), (9, 24, [1.0, -1.0])]:
        rows = vectors(n, width, dice, grid)
        rows += [rows[0], rows[3], (None, rows[1][1], 1, "y"), (5000, None, 0, "z"), (5001, [None] * width, 0, "z")]
        rows += [(5002, [float("nan")] * width, 0, ""), (5003, [float("-inf")] + [0.0] * (width - 1), 0, ""), (5004, [], 1, "")]
        got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_walk_shares_prefixes_across_blocks():
    dice = np.random.default_rng(2)
    parts = np.unique(dice.integers(-3, 3, (500, 5)), axis=0)
    book = dice.integers(-3, 3, (7, 5))
    whole = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    for block in (1, 3, 64, 4096):
        assert np.array_equal(np.concatenate([d for *_, d in codes.walk(parts, book, block)]), whole)


def test_decodes_to_entries(spark):
    rows = vectors(60, 16, random.Random(4), [0.0, 0.5])
    own = codes.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    width, books = codes.first_entries(own)
    books = codes.learn(own, width, books)
    back = codes.decode(codes.encode(own, books), books).collect()
    want = {r[0]: [int(np.floor(4096 * np.float64(np.float32(x)))) for x in r[1]] for r in rows}
    assert len(back) == 60
    for r in back:
        assert sum((a - b) ** 2 for a, b in zip(r.v, want[r.vec_id])) == r.error


def test_tables_without_usable_vectors(spark):
    for rows in ([], [(1, None, 1, None), (2, [1.0] * 7, 1, None), (3, [1e30] * 8, 1, None)]):
        got = codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_other_lengths_take_no_part(spark):
    rows = vectors(30, 8, random.Random(6), [0.0, 1.0])
    got = codes.compress(spark.createDataFrame([*rows, (77, [1.0] * 16, 1, "")], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
