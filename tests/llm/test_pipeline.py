from collections import Counter

import corpus_pipeline
from binledger.llm import mixing, quality, secrets
from binledger.session import cut
from tests.llm.test_neardup import brute_force


def test_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    made, held = docs, []
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, made, sf_dir), name)
        held.append(made)
        if name != "pack":
            assert made.columns == docs.columns
    good, first, clean, mixed, packed = held

    kept = {r.doc_id for r in quality.quality_rules(docs, labels).where("kept").collect()}
    source = {tuple(r) for r in docs.collect() if r.doc_id in kept}
    assert {tuple(r) for r in good.collect()} == source

    want = {d for d, v in brute_force([(r[0], r[1]) for r in source], 5).items() if v[2]}
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == want and all(tuple(r) in source for r in rows.values())

    spans = {r.doc_id: r.spans for r in secrets.secret_scan(first).collect()}
    masked = {r.doc_id: r for r in clean.collect()}
    assert set(masked) == want and any(spans.values())
    for d, r in masked.items():
        text, end, out = rows[d].text, 0, []
        for s, e in (map(int, span.split(":")[1:]) for span in spans[d].split(",") if span):
            if s >= end:
                out += [text[end:s], "[secret]"]
            end = max(end, e)
        assert r.text == "".join(out) + text[end:] and r.n_chars == len(r.text) and r.source == rows[d].source

    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(clean).collect() if r.taken}
    words = Counter()
    for r in mixed.collect():
        n = len([w for w in mixing_words(r.text) if w])
        words[r.doc_id] += n
        assert masked[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    assert words == sizes

    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(words)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    room = Counter()
    for r in pieces:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= sum(room.values()) / 2048 * 1.02 + 1


def mixing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_odd_documents(spark, tmp_path):
    def good(i):
        return " ".join(f"word{i}x{j}" for j in range(80))

    rows = [(i, good(i), "en", "s%d" % (i % 3), 0) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (None, good(99), None, None, 5), (29, good(29), "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} <= {*range(30), None} and None in {r.doc_id for r in pieces}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
