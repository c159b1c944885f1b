import re
from collections import defaultdict

import pytest

from binledger.llm import catalog, neardup


def brute_force(rows, k):
    """Components by comparing every pair that shares a shingle."""
    sets, holders = [], defaultdict(list)
    for i, (_, text) in enumerate(rows):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        made = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        sets.append(made)
        for s in made:
            holders[s].append(i)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)], least[root(i)] == doc) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(docs, k).collect()}
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k)
    assert got == want
    assert sum(not v[2] for v in want.values()) > 0
    if k == 4:
        assert {r[0]: tuple(r[1:]) for r in catalog.op3_minhash_near_dedup(spark, sf_dir).collect()} == want


def test_chain_and_large_group(spark):
    """Chains whose ends differ, and many near copies of one text."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        words[d * 2 % 120] = f"x{d}"
        words[(d * 7 + 3) % 120] = f"y{d}"
        rows.append((d, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for d in range(30):
        rows.append((1000 - d, " ".join(chain[d:] + [f"n{j}" for j in range(d)])))
    rows += [(2000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == brute_force(rows, 4)


def test_odd_rows(spark):
    rows = [(5, None, 1), (6, "", 1), (7, " \t\n", 1), (8, "One two", 1), (9, "one TWO", 2), (9, "one TWO", 2),
            (None, "one two", 3), (11, "ÉTÉ deux", 4), (12, "été deux", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False),
                          (9, 1, 8, False), (None, 1, None, True), (11, 1, 11, True), (12, 1, 12, True)], key=str)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or -1 for r in kept.collect()) == [-1, 5, 6, 7, 8, 11, 12]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_every_text_of_a_repeated_id_is_linked(spark):
    """Two texts of one doc_id with as many shingles each: near copies of both belong to it."""
    rows = []
    for kind, copy in (("a", 20), ("b", 30), ("c", 40)):
        words = [f"{kind}{i}" for i in range(80)]
        rows += [(7, " ".join(words)), (copy, " ".join([*words[:-1], "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == {(7, 77, 7, True), (20, 77, 7, False), (30, 77, 7, False), (40, 77, 7, False)}
