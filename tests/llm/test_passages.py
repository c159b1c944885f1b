import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from binledger.llm import catalog, passages


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def covered(rows, least):
    """Words of each document that lie in a run of ``least`` words which another document also holds, by brute force."""
    holders, docs = defaultdict(set), {d: words_of(t) for d, t in rows}
    for d, w in docs.items():
        for i in range(len(w) - least + 1):
            holders[tuple(w[i : i + least])].add(d)
    out = {}
    for d, w in docs.items():
        marks = np.zeros(len(w), bool)
        for i in range(len(w) - least + 1):
            if len(holders[tuple(w[i : i + least])]) > 1:
                marks[i : i + least] = True
        out[d] = marks
    return out


def marked(found, docs):
    out = {d: np.zeros(len(words_of(t)), bool) for d, t in docs}
    for r in found:
        assert 0 <= r.start_word < r.end_word <= len(out[r.doc_id]) and r.n_words == r.end_word - r.start_word >= 50
        out[r.doc_id][r.start_word : r.end_word] = True
    return out


def test_every_exact_repeat_of_the_table_is_covered(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = catalog.op9_substring_dedup(spark, sf_dir).collect()
    got, want, loose = marked(found, docs), covered(docs, 50), covered(docs, 8)
    assert sum(m.sum() for m in want.values()) > 0
    for d, marks in want.items():
        assert not (marks & ~got[d]).any(), d
    for d, marks in got.items():  # nothing where hardly a word run recurs
        assert not marks.any() or (marks & loose[d]).sum() >= 0.5 * marks.sum(), d


def test_fuzzy_passages_and_clean_documents(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passage = text(120)
    rows = []
    for d in range(40):
        own = list(passage)
        for _ in range(6):  # changed, dropped and added words
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["zz%d" % d], [], [own[at], "yy%d" % d]])
        rows.append((d, " ".join(text(rng.randint(0, 90)) + own + text(rng.randint(0, 90)))))
    halves = (text(40), text(40))
    rows += [(100, " ".join(text(30) + halves[0] + text(30))), (101, " ".join(text(30) + halves[1] + text(30))),
             (102, " ".join(text(30) + halves[0] + halves[1] + text(30))), (103, " ".join(text(30) + halves[0] + halves[1] + text(30)))]
    rows += [(200 + d, " ".join(text(300))) for d in range(40)]
    rows += [(300, None), (301, ""), (302, "short text"), (303, " ".join(passage[:20] * 30)), (None, " ".join(passage)), (304, "x " * 60_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, seed int").repartition(6)
    found = passages.repeated_passages(docs).collect()
    per = defaultdict(int)
    for r in found:
        per[r.doc_id] += r.n_words
    assert all(per[d] >= 100 for d in range(40))
    assert per[102] >= 75 and per[103] >= 75
    assert not any(d is None or 200 <= d < 302 or d == 304 for d in per)
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_chains_follow_order_and_gap_costs():
    x = np.array([0, 10, 20, 30, 40, 500, 510])
    y = np.array([100, 110, 121, 131, 5, 700, 710])
    made = sorted(tuple(c[0].tolist()) for c in passages.chains(x, y))
    assert made == [(0, 10, 20, 30), (40,), (500, 510)]
    assert passages._common(np.array([1, 2, 3, 4, 5]), np.array([2, 9, 3, 5])) == 3
    a, b = np.arange(60, dtype=np.uint32), np.arange(60, dtype=np.uint32)
    b[30] = 999
    assert passages.aligned(a, b, np.array([5, 40]), np.array([5, 40])) == [(0, 60, 0, 60, 59)]


def test_two_passages_far_apart_are_both_found_whole(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for gap in range(50, 601, 25):
        one, two = text(rng.randint(51, 60)), text(rng.randint(51, 60))
        for _ in range(2):
            apart = text(gap + rng.randint(0, 20))
            rows.append((len(rows), " ".join(text(rng.randint(0, 90)) + one + apart + two + text(rng.randint(0, 90)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = marked(passages.repeated_passages(docs).collect(), rows), covered(rows, 50)
    for d, marks in want.items():
        assert marks.sum() >= 102 and not (marks & ~got[d]).any(), d


def test_chains_fall_apart_at_wide_gaps_and_extend_to_both_sides():
    a, b = np.arange(400, dtype=np.uint32), np.arange(1000, 1420, dtype=np.uint32)
    b[20:75], b[320:375] = a[10:65], a[300:355]
    found = passages.aligned(a, b, np.array([20, 40, 310, 340]), np.array([30, 50, 330, 360]))
    assert found == [(10, 65, 20, 75, 55), (300, 355, 320, 375, 55)]


def test_later_copies_inside_the_first_document_are_found(spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(20_000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    twice, quoted, thrice = text(60), text(60), text(55)
    rows = [
        (1, " ".join(text(20) + twice + text(300) + twice + text(40))), (2, " ".join(text(35) + twice + text(10))),
        (11, " ".join(text(10) + quoted[:30] + text(460) + quoted + text(20))), (12, " ".join(text(70) + quoted + text(5))),
        (21, " ".join(text(15) + thrice + text(9) + thrice + text(200) + thrice)), (22, " ".join(thrice + text(30) + thrice)),
        (23, " ".join(text(80) + thrice[:40] + text(30))), (31, " ".join(vocabulary[:60] * 3)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = marked(passages.repeated_passages(docs).collect(), rows), covered(rows, 50)
    assert [int(want[d].sum()) for d in (1, 11, 21, 22)] == [120, 60, 165, 110]
    for d, marks in want.items():
        assert not (marks & ~got[d]).any(), d
    assert not got[31].any()


def test_passages_whose_pieces_have_other_anchors_are_found_whole(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40_000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    pieces, wholes = [], []
    for _ in range(150):
        passage = text(60)
        cuts = [0, *sorted(rng.sample(range(9, 52), rng.choice((2, 3)))), 60]
        pieces += [text(30) + passage[a:b] + text(30) for a, b in zip(cuts, cuts[1:])]
        wholes += [text(rng.randint(5, 40)) + passage + text(rng.randint(5, 40)) for _ in range(2)]
    rows = [(d, " ".join(w)) for d, w in enumerate(pieces + wholes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got, want = marked(passages.repeated_passages(docs).collect(), rows), covered(rows, 50)
    whole = [d for d, m in want.items() if m.sum() == 60]
    missed = [int((want[d] & ~got[d]).sum()) for d in whole]
    assert len(whole) >= 300 and max(missed) < passages.WINDOW
    assert all(not m.any() for d, m in got.items() if not want[d].any())


def batch_of(chains):
    """The batch of ``_laid`` for chains (doc, anchor, lo, anchor_lo, xs, ys, x, y), of texts numbered like their documents."""
    chains = [(c[0], c[1], *c) for c in chains]
    names = ("part", "anchor_part", "doc_id", "anchor", "lo", "anchor_lo", "at", "anchor_at", "words", "anchor_words")
    kinds = (None, None, None, None, None, None, np.int32, np.int32, np.uint32, np.uint32)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    columns = zip(*chains, strict=True)
    return pa.RecordBatch.from_pydict({
        name: pa.array([v if kind is None else np.asarray(v, kind).tobytes() for v in values], type_)
        for name, kind, type_, values in zip(names, kinds, types, columns)
    })


def told(batch):
    got = passages._laid(batch)
    assert got.column("part") == got.column("doc_id")
    return list(zip(*(got.column(c).to_pylist() for c in ("doc_id", "start", "end", "other", "same"))))


def test_chains_of_one_seed_are_aligned_at_once_like_one_by_one(monkeypatch):
    rng = np.random.default_rng(12)
    chains, want, many = [], [], 0
    for d in range(600):
        x = rng.integers(0, rng.choice([3, 40, 5000]), rng.integers(8, 240)).astype(np.uint32)
        y, at = x.copy(), int(rng.integers(0, len(x) - 7))
        for p in rng.integers(0, len(x), rng.integers(0, 40)):  # changed words, never those of the seed
            if not at <= p < at + 8:
                y[p] = 9000 + p
        left, right = rng.integers(0, 4, 2)  # other words before, a few words dropped behind the seed
        gone = slice(at + 8 + int(right), at + 8 + int(right) + int(rng.integers(0, 14)))
        y = np.concatenate([rng.integers(0, 9, left).astype(np.uint32), np.delete(y, gone), x[:right]])
        xs, ys = [at], [at + int(left)]
        if d % 50 == 0 and at + 8 < len(x) and at + left + 8 < len(y) and x[at + 8] == y[at + left + 8]:
            xs, ys, many = [at, at + 8], [at + int(left), at + int(left) + 8], many + 1
        lo, anchor_lo = 64 * (d % 3), 64 * (d % 5)
        chains.append((d, 1000 + d, lo, anchor_lo, np.add(xs, lo), np.add(ys, anchor_lo), x, y))
        for a, b, c, e, same in passages.aligned(x, y, np.array(xs), np.array(ys)):
            want.append((d, a + lo, b + lo, 1000 + d, same))
            want.append((1000 + d, c + anchor_lo, e + anchor_lo, d, same))
    calls, one_by_one = [], passages.aligned
    monkeypatch.setattr(passages, "aligned", lambda *a: calls.append(len(a[2])) or one_by_one(*a))
    batch, got = batch_of(chains), []
    for at in range(0, len(chains), 170):
        got += told(batch.slice(at, 170))
    assert sorted(got) == sorted(want) and 0 < many
    assert len(calls) == many and min(calls) > 1  # chains of one seed cost no call of their own


def test_seeds_that_do_not_stand_in_the_text_are_left_out():
    x, y, z = np.arange(90), np.arange(500, 590), np.arange(40)
    chains = [
        (1, 2, 0, 0, [5], [5], x, y), (1, 3, 0, 0, [60], [60], x, z), (1, 6, 0, 0, [5, 9], [5, 9], x, y),
        (1, 4, 64, 0, [70, 84], [6, 20], x, x), (1, 5, 0, 0, [9, 50], [9, 50], x, z),
    ]
    assert sorted(told(batch_of(chains))) == [(1, 0, 40, 5, 40), (1, 64, 154, 4, 90), (4, 0, 90, 1, 90), (5, 0, 40, 1, 40)]


def test_every_text_of_a_repeated_doc_id_keeps_its_passages(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(20_000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], set()
    for d in range(0, 60, 3):
        one, two, short = text(70), text(80), text(60)
        rows += [(d, text(50) + one + text(60)), (d, text(200) + two + text(90)), (d + 1, text(20) + one + text(9)), (d + 2, text(33) + two + text(70))]
        want |= {(d, 50, 120), (d, 200, 280), (d + 1, 20, 90), (d + 2, 33, 113)}
        # pieces under 50 words that would be one passage if the texts' words were numbered together; a copy within one doc_id
        rows += [(d, text(300) + short[:30] + text(40)), (d, text(328) + short[30:] + text(40)), (d + 1, text(99) + short[:30] + text(9) + short[30:])]
        inside = text(70)
        rows += [(d, text(400) + inside), (d, text(410) + inside), (d, text(50) + one + text(9))]
    rows = [(d, " ".join(w)) for d, w in rows]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()]
    assert sorted(got) == sorted(want)
