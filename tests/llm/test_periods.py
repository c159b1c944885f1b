import hashlib
import random
import zlib

import numpy as np
import pytest

from binledger.llm import periods


def brute_runs(words):
    """Every lag's maximal match stretches; a run is kept under its smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                span = words[i - q : j]
                if not any(all(span[k] == span[k - d] for k in range(d, len(span))) for d in range(1, q)):
                    found[(i - q, j - i + q, q)] = True
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def hashed(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.random.default_rng(5).integers(1, 2**63, len(ids) + 1, dtype=np.uint64)[[ids[w] for w in words]]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    dice = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdefghij"
    words = []
    while len(words) < 260:
        kind = dice.random()
        if kind < 0.4:
            root = [dice.choice(letters) for _ in range(dice.randint(1, 40))]
            if dice.random() < 0.3:
                root = root * 2 + root[:1]
            length = int(len(root) * dice.uniform(1.5, 6))
            words += (root * 7)[:length]
        else:
            words += [dice.choice(letters) for _ in range(dice.randint(1, 30))]
    assert [tuple(r) for r in periods.find_runs(hashed(words))] == brute_runs(words)


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 100, "aab" * 60 + "b", "ab" * 20 + "aba" * 30, "a" * 23, "a" * 24, "abcdefgh" * 3])
def test_regular_texts(text):
    assert [tuple(r) for r in periods.find_runs(hashed(list(text)))] == brute_runs(list(text))


def test_one_long_text_of_one_word_is_quick():
    words = np.full(400_000, 7, np.uint64)
    assert periods.find_runs(words) == [(0, 400_000, 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_report(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_report_equals_brute_force(spark, tmp_path):
    dice = random.Random(3)
    rows = [(None, None), (None, "x " * 30), (1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "één twee drie " * 12)]
    for doc_id in range(5, 160):
        n = dice.choice([1, 3, 24, 90, 250])
        words = [dice.choice(["aa", "b", "ç", "dd"]) for _ in range(n)]
        if dice.random() < 0.3:
            words[n // 3 :] = (words[n // 3 : n // 3 + 5] * n)[: n - n // 3]
        rows.append((doc_id, dice.choice([" ", "\n", "\x0b "]).join(words)))
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_runs int")
    got = sorted(map(tuple, periods.run_report(docs, tailed=True).collect()), key=repr)
    assert got == sorted((brute_report(*r) for r in rows), key=repr)


def test_lists_and_collapses(spark):
    docs = spark.createDataFrame(
        [(1, "x y " * 20 + "end", "k"), (2, "plain  text", None), (3, None, "n")], "doc_id int, text string, period string"
    )
    assert [tuple(r) for r in periods.list_runs(docs).collect()] == [(1, 0, 40, 2)]
    made = {r.doc_id: (r.text, r.period) for r in periods.collapse_runs(docs).collect()}
    assert made == {1: ("x y end", "k"), 2: ("plain  text", None), 3: (None, "n")}
    assert periods.run_report(docs.where("false")).count() == 0
