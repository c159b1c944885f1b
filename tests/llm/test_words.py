import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from binledger.llm import words
from binledger.llm.language import _letters

TEXT = st.text(alphabet=st.sampled_from(list("aAbZ \t\n\r\x0b\x0c\x1c éß漢😀.")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words.find_words(pa.array(texts, pa.string()), lower=True)
    for i, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        assert got == want
        for a, h in zip(want, w.hashes[w.first[i] : w.first[i + 1]]):
            for b, k in zip(want, w.hashes[w.first[i] : w.first[i + 1]]):
                low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
                assert (low(a) == low(b)) == (h == k)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 4))
def test_windows_stay_inside_their_text(texts, k):
    w = words.find_words(pa.array(texts))
    made, at, before = words.windows(w.hashes, w.first, k)
    for i, n in enumerate(w.counts):
        assert before[i + 1] - before[i] == max(0, n - k + 1)
        assert all(w.first[i] <= a and a + k <= w.first[i + 1] for a in at[before[i] : before[i + 1]])
    assert len(made) == before[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_letters_are_decoded(texts):
    data, offsets = words.text_bytes(pa.array(texts))
    x, own = _letters(data, offsets)
    for i, text in enumerate(texts):
        got = "".join(chr(c) if c else " " for c in x[own == i].tolist()).split()
        want = re.findall(r"[^\W\d_]+", text)
        assert got == [t.lower() if t != "ß" else t for t in want]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * n for n in (0, 5, 100, 3, 0, 7)] + [None])}).slice(1)
    got = [r for piece in words.slices(batch, "t", 10) for r in piece.column("t").to_pylist()]
    assert got == batch.column("t").to_pylist()
    assert np.array_equal(words.mix(np.arange(3, dtype=np.uint64)), words.mix(np.arange(3, dtype=np.uint64)))


def test_long_words_are_hashed_in_blocks_alike(monkeypatch):
    texts = pa.array(["ab " + "xyz" * 900 + " c", "q" * 64, "tail " + "Y" * 131 + " " + "ab" * 33])
    whole = words.find_words(texts, lower=True).hashes
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    assert words.find_words(texts, lower=True).hashes.tolist() == whole.tolist()
