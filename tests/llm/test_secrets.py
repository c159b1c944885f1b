import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from binledger.llm import catalog, secrets


def brute_base(text):
    found = []
    text = text or ""
    for kind, (name, pattern, group, least) in enumerate((
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    )):
        found += [(m.start(), kind, name, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    found = [f"{n}:{s}:{e}" for s, _, n, e in sorted(found)]
    return [sum(f.startswith(n) for f in found) for n in ("assign", "access", "hex")] + [
        hashlib.sha256(",".join(found).encode()).hexdigest()
    ]


def test_base_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in catalog.op7_secret_scans(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc, text in docs:
        assert list(got[doc][1:5]) == brute_base(text)


def test_random_tokens_are_found_and_structured_ones_left(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = {i: "".join(rng.choices(letters, k=40)) for i in range(200)}
    plain = {i: f"the-quick-brown-fox-jumps-over-{i}" for i in range(200, 400)}
    rows = [(i, f"é before {t} after") for i, t in (keys | plain).items()]
    got = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:9:49" for i in keys) >= 180
    assert not any(got[i] for i in plain)


def test_odd_rows_and_redaction(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (None, "ü Password: 'abcdefghijkl' x", 27, "c"),
            (4, "AKIA" + "Z" * 20 + " token=short API_KEY=0123456789abcdef0123", 66, "d"), (5, "x" * 300_000 + " " + "0" * 16, 300017, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted((tuple(r) for r in secrets.secret_scan(docs).collect()), key=str)
    want = sorted(((d, *brute_base(t)) for d, t, _, _ in rows), key=str)
    assert [g[:5] for g in got] == want
    assert [g[5] for g in got if g[0] == 4] == ["access:0:24,assign:37:65,hex:45:65"]
    out = {r.spans: r for r in secrets.redact(docs).collect()}
    assert out["a"].text is None and out["b"].text == ""
    assert out["c"].text == "ü [secret]' x" and out["c"].n_chars == 13
    assert out["d"].text == "[secret] token=short [secret]"
    assert out["e"].text == "x" * 300_000 + " [secret]"
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_battery_tells_random_from_text():
    rng = np.random.default_rng(1)
    hexes = [secrets.battery(rng.choice(np.frombuffer(b"0123456789abcdef", np.uint8), 40)) for _ in range(200)]
    assert all(w == 0 for w, _ in hexes) and sum(p > 0.05 for _, p in hexes) > 170
    assert secrets.battery(np.frombuffer(b"aaaaaaaaaaaaaaaaaaaaaaa1", np.uint8))[1] < 1e-3


def test_overlap_with_base_spans_in_a_text_of_many_hashes():
    rng = np.random.default_rng(3)
    starts = np.sort(rng.choice(5000, 300, replace=False))
    ends = starts + rng.integers(1, 30, 300)
    spans = [(int(s), int(s + n)) for s, n in zip(rng.choice(5000, 200), rng.integers(1, 40, 200))]
    want = [any(s < e2 and s2 < e for s2, e2 in spans) for s, e in zip(starts, ends)]
    assert secrets._overlapped(starts, ends, spans).tolist() == want
    assert not secrets._overlapped(starts, ends, []).any()
    text = " ".join(f"{i:024x}" for i in range(60_000))
    _, _, base, tokens = secrets._scan(pa.array([text, None, "a" * 30 + "1"]))
    assert [len(b) for b in base] == [60_000, 0, 1] and not any(tokens)


def test_few_tokens_share_a_threshold():
    bands = len(secrets.BANDS) + 1
    counts = np.zeros((len(secrets.ENCODINGS) * bands, secrets.P_BINS), np.int64)
    assert (secrets.thresholds(counts) > 1).all()
    counts[0, 0], counts[0, -1] = 6, 1  # seven tokens alone decide nothing
    assert (secrets.thresholds(counts) > 1).all()
    counts[1:3] = 10  # 800 random tokens in the next two bands, of which one is enough
    out = secrets.thresholds(counts)
    assert len(set(out[:2])) == 1 and (out[:bands] <= 0.05).all() and (out[bands:] > 1).all()
