"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding makes spellings that look alike equal: compatibility forms are composed, loose marks and
invisible characters dropped, look-alike letters of other scripts replaced, and digits and signs inside
words read as the letters they stand for (a word with a 1 is read twice, with i and with l). What is left are words parted by
single spaces. A lexicon term is a word or a stem that goes on; a word counts once, with its heaviest
term, unless an exception phrase covers it. Weights are summed over the text and taken per thousand words; a logistic
curve over both turns them into a probability.

Terms, weights, exceptions and the curve are learned from labelled documents, besides ``BASE_TERMS`` and
``BASE_EXCEPTIONS``: from at most ``FIT_ROWS`` of each label, those with the smallest hash of their doc_id, a bounded
sample whose bound is a parameter. Words and stems that are at least ``MIN_RATIO`` times as frequent in toxic documents
are candidates, at most ``CANDIDATES`` of them; of these the one that explains most of the toxic documents not explained yet is
taken, again and again, so that the ordinary words of a toxic text with many copies aren't. A term explains a
document in full from ``FULL_RATE`` occurrences per thousand words on, and in part below. An exception is a matched
word with a neighbour, seen in ``MIN_EXCEPTION`` clean documents and in no toxic one.

Defined results: null and empty texts have no match and the lowest score; without labels of both kinds the base
lexicon and ``UNTRAINED`` stand; null doc_ids are scored, never learned from, and not held out; a doc_id with several labels is
toxic if one says so, one with several texts is learned from its smallest; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger.llm.words import map_slices, slices
from binledger.session import cut

FIT_ROWS = 6000
CANDIDATES = 2000
MIN_RATIO = 12.0
FULL_RATE = 10.0
MIN_DOCUMENTS = 3
#: A term is taken as long as it explains so many documents, in parts, that no other does.
MIN_GAIN = 2.0
MIN_EXCEPTION = 3
EXCEPTIONS = 1000
STEMS = range(3, 9)
MIN_WORD = 3
#: A document is called toxic from this probability on.
TOXIC_FROM = 0.3
BASE_WEIGHT = 4.0
#: Bias, and slopes over the logarithms of summed and per-thousand weights, where there is nothing to learn from.
UNTRAINED = (-4.0, 1.0, 1.0)

# fixed values: common English insults, and harmless phrases that hold one
BASE_TERMS = (
    "idiot", "moron", "stupid", "imbecile", "dumbass", "loser", "scum", "trash", "worthless", "pathetic", "disgusting",
    "bastard", "asshole", "bitch", "clown", "retard",
)
BASE_EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "pond scum")

# fixed values: letters of other scripts by the Latin letters they look like
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "i", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_DIGITS = str.maketrans("013456789", "oieasgtbg")
_DROPPED = [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]
_FOREIGN = {**{ord(a): b for a, b in _LOOKALIKES.items()}, **dict.fromkeys(_DROPPED)}
_SIGNS = {"@": "a", "$": "s", "!": "i"}
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_MIXED = re.compile(r"(?<!\w)(?=\w*\d)(?=\w*[^\W\d_])\w+")
_GAP = re.compile(r"[\W_]+")


def _read(word: re.Match) -> str:
    made = word[0].translate(_DIGITS)
    return f"{made} {word[0].replace('1', 'l').translate(_DIGITS)}" if "1" in word[0] else made


def fold(text: str) -> str:
    """The words of a text in their folded spelling, with one space before each and one at the end."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).translate(_FOREIGN)
    text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    text = _MIXED.sub(_read, text)
    return _GAP.sub(" ", f" {text} ")


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # " word " or " stem" that must go on, folded
    exceptions: tuple[str, ...] = ()  # " word word ", folded
    curve: tuple[float, float, float] = UNTRAINED
    _key: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_key", (tuple(sorted(self.weights.items())), tuple(sorted(self.exceptions))))


@lru_cache(maxsize=4)
def _automaton(key: tuple) -> ahocorasick.Automaton:
    terms, exceptions = key
    made = ahocorasick.Automaton()
    for term, weight in terms:
        made.add_word(term, (len(term), weight))
    for phrase in exceptions:
        made.add_word(phrase, (len(phrase), None))
    made.make_automaton()
    return made


def _occurrences(folded: str, lexicon: Lexicon) -> Iterator[tuple[int, int, float | None]]:
    """First and last place of every term (with its weight) and exception phrase."""
    for end, (length, weight) in _automaton(lexicon._key).iter(folded):
        if folded[end] == " " or folded[end + 1] != " ":
            yield end - length + 1, end, weight


def matches(folded: str, lexicon: Lexicon) -> dict[int, float]:
    """Where the matched words begin (at the space before), with their weights; excepted words are left out."""
    found: dict[int, float] = {}
    covered = []
    if not lexicon.weights:
        return found
    for start, end, weight in _occurrences(folded, lexicon):
        if weight is None:
            covered.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    for start, end in covered:
        at = folded.find(" ", start)
        while at < end:
            found.pop(at, None)
            at = folded.find(" ", at + 1)
    return found


def measures(folded: str, lexicon: Lexicon) -> tuple[float, float]:
    """Logarithms of the summed weights and of the weights per thousand words."""
    total = sum(sorted(matches(folded, lexicon).values()))
    n = folded.count(" ") - 1
    return float(np.log1p(total)), float(np.log1p(1000.0 * total / max(n, 1)))


def score(text: str | None, lexicon: Lexicon) -> float:
    bias, by_sum, by_share = lexicon.curve
    one, two = measures(fold(text or ""), lexicon)
    return float(1 / (1 + np.exp(-(bias + by_sum * one + by_share * two))))


def base_lexicon() -> Lexicon:
    return Lexicon({fold(t): BASE_WEIGHT for t in BASE_TERMS}, tuple(map(fold, BASE_EXCEPTIONS)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(folded: str) -> Counter:
    """How often every word and every stem stands in a text."""
    out: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        if len(word) >= MIN_WORD:
            out[f" {word} "] += n
            for k in STEMS:
                if k < len(word):
                    out[f" {word[:k]}"] += n
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: documents with each term, and occurrences of it, in toxic and clean ones; words under the term ''."""
    for batch in batches:
        for piece in slices(batch, "text"):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
                folded = fold(text)
                found = _terms(folded)
                found[""] = folded.count(" ") - 1
                for term, n in found.items():
                    row = seen.setdefault(term, [0, 0, 0])
                    row[0] += toxic
                    row[1 if toxic else 2] += n
            columns = zip(*seen.values()) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "documents", "toxic", "clean"]
            )


def _sample(documents: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``(text, toxic)`` of at most ``fit_rows`` documents a label, written; and how many each label has in all."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    known = cut(known, "toxic-labels")
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(*order).limit(fit_rows) for k in (0, 1)]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * fit_rows pairs of numbers
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return cut(one.select("text", "toxic"), "toxic-sample"), have


def cover(share: np.ndarray, toxic: np.ndarray, price: float, terms: list[str]) -> list[int]:
    """Columns of ``share`` (documents x terms, 0 to 1) taken one after the other, each explaining most of what toxic documents leave open.

    What a term explains of clean documents counts against it, times ``price``. Ties go to the longer term, then to the smaller.
    """
    cost = share[~toxic].sum(axis=0) * price
    own = share[toxic]
    open_, taken = np.ones((len(own), 1), np.float32), []
    prefer = np.lexsort((np.array(terms), -np.array([len(t) for t in terms])))
    while len(terms):
        gain = np.minimum(own, open_).sum(axis=0)
        value = np.round(gain - cost, 3)[prefer]
        best = int(prefer[int(np.argmax(value))])
        if gain[best] < MIN_GAIN or value.max() <= 0:
            return taken
        taken.append(best)
        open_ = np.maximum(open_ - own[:, best : best + 1], 0)
    return taken


def _choose_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    counted = sample.mapInArrow(_term_counts, "term string, documents long, toxic long, clean long")
    counted = cut(counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("documents", "toxic", "clean"))), "toxic-terms")
    words = counted.where("term = ''").first()
    ratio = (F.col("toxic") / max(words["toxic"], 1)) / ((F.col("clean") + 1) / max(words["clean"], 1))
    likely = counted.where((F.col("term") != "") & (F.col("documents") >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO))
    terms = [r["term"] for r in likely.orderBy(F.desc("documents"), "term").limit(CANDIDATES).collect()]
    number = {t: i for i, t in enumerate(terms)}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, shares = [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                full = FULL_RATE * max(folded.count(" ") - 1, 1) / 1000
                held = {number[t]: min(n / full, 1.0) for t, n in _terms(folded).items() if t in number}
                ats.append(list(held)), shares.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(ats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["toxic", "at", "share"],
            )

    rows = sample.mapInArrow(marks, "toxic int, at array<int>, share array<float>").where("size(at) > 0").collect()
    share = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        share[i, r["at"]] = r["share"]
    price = MIN_RATIO * n_toxic / n_clean
    return [terms[i] for i in cover(share, np.array([r["toxic"] == 1 for r in rows], bool), price, terms)]


def _observed(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Per sampled document: its words, the terms it holds and how often, and its matched words with each neighbour."""
    plain = Lexicon(lexicon.weights)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            folded = fold(text)
            held = Counter(folded[start : end + 1] for start, end, _ in _occurrences(folded, plain))
            held[""] = folded.count(" ") - 1
            phrases = set()
            for at in matches(folded, plain):
                stop = folded.index(" ", at + 1)
                before, after = folded.rfind(" ", 0, at), folded.find(" ", stop + 1)
                phrases.update(folded[a:b] for a, b in ((before, stop + 1), (at, after + 1)) if a >= 0 and b > 0)
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array([toxic], pa.int32()), "terms": pa.array([list(held.items())], pa.map_(pa.string(), pa.int64())),
                "phrases": pa.array([sorted(phrases)], pa.list_(pa.string())),
            })


def _learned_weights(base: dict[str, float], counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Logarithm of how much more frequent a term is in toxic texts; a base term keeps its weight until seen ``MIN_DOCUMENTS`` times."""
    words_toxic, words_clean = counts.pop("", (1, 1))
    out = dict(base)
    for term, (t, k) in counts.items():
        if term in base and t + k < MIN_DOCUMENTS:
            continue
        out[term] = float(np.log((t + 0.5) / (words_toxic + 1)) - np.log((k + 0.5) / (words_clean + 1)))
    return {t: w for t, w in out.items() if w > 0}


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with slopes of at least 0, by projected Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    theta, ridge = np.array([-2.0, 0.5, 0.5]), np.array([1e-6, 1e-4, 1e-4]) * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        free = np.array([True, True, True])
        grad = design.T @ (weight * (p - y)) + ridge * theta
        free[1:] = (theta[1:] > 0) | (grad[1:] < 0)
        h = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.zeros(3)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], grad[free])
        theta = theta - np.clip(step, -2, 2)
        theta[1:] = np.maximum(theta[1:], 0)
    return tuple(float(v) for v in theta)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon, its exceptions and its curve, from labelled documents that are not held out."""
    sample, have = _sample(documents, labels, fit_rows)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = base_lexicon()
    if not n.get(0) or not n.get(1):
        return base
    chosen = {t: BASE_WEIGHT for t in _choose_terms(sample, n[1], n[0])}
    first = Lexicon({**base.weights, **chosen})
    seen = cut(
        sample.mapInArrow(lambda b: _observed(b, first), "toxic int, terms map<string,long>, phrases array<string>"), "toxic-seen"
    )
    pair = [F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("k")]
    held = seen.select("toxic", F.explode("terms").alias("term", "n")).groupBy("term")
    held = held.agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("k")).collect()  # a row a term
    weights = _learned_weights(base.weights, {r["term"]: (r["t"], r["k"]) for r in held})
    harmless = (
        seen.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(*pair)
        .where((F.col("t") == 0) & (F.col("k") >= MIN_EXCEPTION))
        .orderBy(F.desc("k"), "phrase").limit(EXCEPTIONS).collect()
    )
    lexicon = Lexicon(weights, tuple({*base.exceptions, *(r["phrase"] for r in harmless)}))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [measures(fold(t), lexicon) for t in batch.column("text").to_pylist()]
            if both:
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, zip(*both))], ["toxic", "a", "b"])

    rows = sample.mapInArrow(measured, "toxic int, a double, b double").orderBy("toxic", "a", "b").toArrow()  # the bounded sample
    y = rows["toxic"].to_numpy().astype(float)
    weight = np.where(y > 0, have[1] / n[1], have[0] / n[0])
    curve = fit_curve(np.column_stack([rows["a"].to_numpy(), rows["b"].to_numpy()]), y, weight / weight.mean())
    return Lexicon(weights, lexicon.exceptions, curve)


def score_documents(documents: DataFrame, lexicon: Lexicon, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, score and verdict of every document."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([score(t, lexicon) for t in piece.column("text").to_pylist()], float)
        return pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id"), "score": pa.array(made), "predicted": pa.array((made >= toxic_from).astype(np.int32)),
        })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, "text", work, "doc_id long, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, whether it was held out of the fit, score and verdict."""
    scored = score_documents(documents, fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
