import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from binledger.llm import catalog, quality
from binledger.llm.words import find_words


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again), failed


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.op10_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d.doc_id][1:7]) == brute(d.text)
        assert not (got[d.doc_id].base_failed and got[d.doc_id].kept)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    rows = quality.quality_rules(docs, even).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id")
    rows = rows.where("NOT base_failed").select("quality", "kept", "p_good").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_odd_rows(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, 9), (2, "", 9), (None, plain, 9), (4, plain, 9), (4, plain, 9), (5, "é\n\né\n é\n", 9), (6, "x" * 300_000, 9), (7, "a b c " * 40_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:7] for r in quality.quality_rules(docs, none).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None"]
    one_kind = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one_kind) is None
    assert quality.quality_rules(docs.limit(0), none).count() == 0


def test_trigrams_are_of_characters_and_scores_of_a_text_alone():
    texts = ["héllo wörld", "日本語の文章です 日本語", None, "", "ab", "🙂🙂🙂 x🙂", "plain words here and plain words there"]
    grams = {}
    for text in filter(None, texts):
        bucket, offsets = quality._inputs(find_words(pa.array([text])))[2]
        assert offsets.tolist() == [0, len(text)] and len(bucket) == max(0, len(text) - 2)
        for i, b in enumerate(bucket.tolist()):
            assert grams.setdefault(text[i : i + 3], b) == b
    assert len(set(grams.values())) > 0.95 * len(grams)
    model = quality.Model(np.random.default_rng(2).normal(size=quality.BUCKETS), 0.1)
    together = quality.score(find_words(pa.array(texts)), model)
    alone = [quality.score(find_words(pa.array([t], pa.string())), model)[0] for t in texts]
    assert together.tolist() == alone
