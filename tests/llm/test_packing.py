import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from binledger.llm import catalog, packing
from binledger.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunked_ids_are_those_of_whole_texts(tokenizer):
    import public_tokenizers

    rng = random.Random(3)
    texts = [None, "", " ", "a  b\n\n c  d    e", "<|endoftext|> a<|endoftext|>b", "don't we'll 1,2\r\n\tq", "é  à\u0085 b   c", "日本 語　 x"]
    texts += ["".join(rng.choices(" \n\t  é漢a1.'sß<|>", k=50)) for _ in range(2000)]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from memory
        ids, offsets = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, tokenizer, tokens=2048, documents=None, attention=None):
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(whole) == set(texts)
    for doc, own in whole.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(own) == 1 or all(r.length == tokens for r in own if r.piece))
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= tokens and len(own) <= (documents or tokens)
        assert sum(r.length**2 for r in own) <= (attention or tokens**2)
    return len(sequences)


def test_round_trip_and_number_of_sequences(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.op8_best_fit_packing(spark, sf_dir).collect()
    n = check(rows, texts, tokenizer)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_every_constraint(spark, tokenizer):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choices(["the", "cat", "Ünder", "x1"], k=rng.choice([0, 1, 3, 9, 30, 70]))) for i in range(400)}
    texts |= {500: None, 501: "", 502: "word " * 3000}
    docs = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, length int")
    for choose in ("norm", "dot"):
        limits = packing.Limits(128, 5, 6000, choose=choose)
        rows = packing.pack(docs, limits, with_ids=True).collect()
        assert all(len(r.ids) == r.length for r in rows)
        for r in rows:
            assert r.length <= limits.longest == 77
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append(r)
        assert all(len(s) <= 5 and sum(r.length for r in s) <= 128 and sum(r.length**2 for r in s) <= 6000 for s in sequences.values())
    check(packing.pack(docs).collect(), texts, tokenizer)
    odd = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert packing.pack(odd).select("offset", "sequence_id").distinct().count() == 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_is_as_good_as_item_by_item():
    rng = random.Random(9)
    lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1, 300)]) for _ in range(3000)]
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    _, n = packing.plan(counts, packing.Limits())
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= x]
        if fit:
            left[min(fit)[1]] -= x
        else:
            left.append(2048 - x)
    assert n <= len(left)
