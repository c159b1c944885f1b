"""Repeated passages, exact or fuzzy, by collinear chaining of shared k-mers.

* **Seeds.** Minimizers: of every ``WINDOW`` neighbouring word k-mers the one with the least hash, so any
  run of K + WINDOW - 1 equal words shares a seed. Whole texts, all documents.
* **Join.** Seeds held by several documents (pre-aggregated) have an anchor, their first occurrence. Every
  other occurrence meets its anchor only: a passage shared by n documents gives n - 1 links, not all pairs, and every
  one of the n documents is linked. Later occurrences inside the anchor document meet the seed's last document instead,
  so that a second copy there is found too; a row per occurrence in any case.
* **Chaining.** The matches of a document with an anchor document are runs on diagonals; a Fenwick tree over anchor
  positions finds for each run the best chain before it in both texts, less a cost for the words skipped.
* **Alignment.** Chains are laid over the words of both texts: gaps by longest common subsequence, ends by exact
  runs over short mismatches; chains of one seed, most of all, a whole batch at once. Chains that agree in too few
  words are parted at their widest gaps, and each part is extended to both sides.
* **Passages.** A document's aligned stretches, on either side of a link, are united; those of
  ``MIN_WORDS`` words or more are its repeated passages. A passage whose parts have different anchors is thus found whole,
  however short the parts; only then are short results left out. Where every seed of a passage lies in
  pieces that other documents hold, up to ``WINDOW`` - 1 words before the first or after the last piece may stay out.

Defined results: null, empty and short texts hold no passage; rows without doc_id take no part; rows that repeat a doc_id are one document
and no repeat of each other: each of its texts, told apart by ``part``, a hash, has passages and word numbers of its own, and
equal rows of them are one; repeats inside one document alone don't count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binledger.llm.words import find_words, map_slices, text_bytes, windows
from binledger.session import cut

K, WINDOW = 8, 12
MIN_WORDS = 50
#: Stretches this near to each other are one. A wider gap inside a passage of two documents holds WINDOW k-mers
#: or more that touch it, hence a seed of its own.
JOIN_GAP = WINDOW - K
GAP_COST = 0.05
MIN_IDENTITY = 0.6
_PAD, _STEP = 48, 64
_SKIP, _AFTER_SKIP = 12, 4
#: Pairs of skipped words, row by row, in the order they are tried.
_NEAREST = np.add.outer(np.arange(_SKIP + 1), np.arange(_SKIP + 1)).ravel().argsort(kind="stable")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("part"), "text").where("text IS NOT NULL")


def seeds(documents: DataFrame) -> DataFrame:
    """``seed, doc_id, part, pos``: the minimizers of every document of ``MIN_WORDS`` words or more."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        w = find_words(piece.column("text"), lower=True)
        kmers, at, before = windows(w.hashes, w.first, K)
        if len(kmers) < WINDOW:
            return None
        own = np.repeat(np.arange(len(before) - 1), np.diff(before))
        least = np.lib.stride_tricks.sliding_window_view(kmers, WINDOW).argmin(axis=1) + np.arange(len(kmers) - WINDOW + 1)
        least = np.unique(least[own[: len(least)] == own[WINDOW - 1 :]])
        least = least[(w.counts >= MIN_WORDS)[own[least]]]
        doc = own[least]
        return pa.RecordBatch.from_pydict({
            "seed": pa.array(kmers[least].view(np.int64)),
            "doc_id": piece.column("doc_id").take(pa.array(doc)),
            "part": piece.column("part").take(pa.array(doc)),
            "pos": pa.array((at[least] - w.first[doc]).astype(np.int32)),
        })

    rows = _texts(documents).where("doc_id IS NOT NULL")
    return map_slices(rows, "text", work, "seed long, doc_id long, part int, pos int")


def matches(found: DataFrame) -> DataFrame:
    """``doc_id, part, pos, anchor, anchor_part, anchor_pos``: every occurrence of a shared seed with the seed's first occurrence.

    Later occurrences in the anchor document itself meet the seed's first occurrence in its last document.
    """
    least, last = F.min(F.struct("doc_id", "part", "pos")), F.max(F.struct("doc_id", "part", (-F.col("pos")).alias("back")))
    anchors = found.groupBy("seed").agg(least.alias("a"), last.alias("b")).where("a.doc_id < b.doc_id")
    anchors = anchors.select(
        "seed", F.col("a.doc_id").alias("first"), F.col("a.part").alias("first_part"), F.col("a.pos").alias("first_pos"),
        F.col("b.doc_id").alias("last"), F.col("b.part").alias("last_part"), (-F.col("b.back")).alias("last_pos"),
    )
    anchors = cut(anchors, "anchors")  # a plain join then, of which Spark splits the partitions of common seeds
    met = found.join(anchors, "seed").where("doc_id <> first OR part <> first_part OR pos <> first_pos")
    other = F.col("doc_id") != F.col("first")
    return met.select(
        "doc_id", "part", "pos", F.when(other, F.col("first")).otherwise(F.col("last")).alias("anchor"),
        F.when(other, F.col("first_part")).otherwise(F.col("last_part")).alias("anchor_part"),
        F.when(other, F.col("first_pos")).otherwise(F.col("last_pos")).alias("anchor_pos"),
    )


def chains(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Collinear chains of matches (x ascending): positions in both texts, each match in one chain at most."""
    cut_ = np.flatnonzero((np.diff(x) != np.diff(y)) | (np.diff(x) > 4 * WINDOW)) + 1
    first = np.concatenate([[0], cut_])
    last = np.concatenate([cut_, [len(x)]]) - 1
    if len(first) == 1:
        return [(x, y)]
    weight = (x[last] - x[first] + K).astype(float)
    places = np.unique(np.concatenate([y[first], y[last]]))
    tree = [(-np.inf, -1)] * (len(places) + 1)
    rank_first, rank_last = np.searchsorted(places, y[first]).tolist(), np.searchsorted(places, y[last]).tolist()
    xs, xe, ys, ye = (a.tolist() for a in (x[first], x[last], y[first], y[last]))
    score, before, waiting = [0.0] * len(first), [-1] * len(first), sorted(range(len(first)), key=lambda i: xe[i])
    entered = 0
    for i in range(len(first)):  # runs in the order of their first word
        while entered < len(waiting) and xe[waiting[entered]] < xs[i]:
            j = waiting[entered]
            value, at = (score[j] + GAP_COST * (xe[j] + ye[j]), j), rank_last[j] + 1
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
            entered += 1
        best, at = (-np.inf, -1), rank_first[i]
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (xs[i] + ys[i])
        score[i] = weight[i] + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    used, out = [False] * len(first), []
    for i in sorted(range(len(first)), key=lambda i: -score[i]):
        runs = []
        while i >= 0 and not used[i]:
            used[i] = True
            runs.append(i)
            i = before[i]
        if runs:
            pick = np.concatenate([np.arange(first[r], last[r] + 1) for r in reversed(runs)])
            out.append((x[pick], y[pick]))
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair of a document's and an anchor's text, of sorted matches; holds one pair's matches at a time."""
    held: list[tuple] = []
    rows: list[tuple] = []

    def told() -> None:
        x, y = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        rows.extend((*held[0][0], *c) for c in chains(x, y))

    def made() -> pa.RecordBatch:
        out = {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(PAIR, (pa.int64(), pa.int32()) * 2))}
        for k, (name, lo, hi) in enumerate((("at", "lo", "hi"), ("anchor_at", "anchor_lo", "anchor_hi"))):
            out[lo] = pa.array([max(0, int(r[4 + k][0]) - _PAD) // _STEP * _STEP for r in rows], pa.int32())
            out[hi] = pa.array([-(-(int(r[4 + k][-1]) + K + _PAD) // _STEP) * _STEP for r in rows], pa.int32())
            out[name] = pa.array([r[4 + k].astype(np.int32).tobytes() for r in rows], pa.binary())
        rows.clear()
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        pair = [batch.column(c).to_numpy() for c in PAIR]
        pos, anchor_pos = (batch.column(c).to_numpy() for c in ("pos", "anchor_pos"))
        if not len(pos):
            continue
        border = np.flatnonzero(np.any([p[1:] != p[:-1] for p in pair], axis=0)) + 1
        for lo, hi in zip([0, *border.tolist()], [*border.tolist(), len(pos)]):
            own = tuple(int(p[lo]) for p in pair)
            if held and held[0][0] != own:
                told()
                held.clear()
            held.append((own, pos[lo:hi].astype(np.int64), anchor_pos[lo:hi].astype(np.int64)))
            if len(rows) >= 2000:
                yield made()
    if held:
        told()
    if rows:
        yield made()


PAIR = ("doc_id", "part", "anchor", "anchor_part")
CHAIN = "doc_id long, part int, anchor long, anchor_part int, lo int, hi int, at binary, anchor_lo int, anchor_hi int, anchor_at binary"


def stretches(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """``doc_id, part, lo, hi, words``: hashes of the asked words of each text (four bytes a word), a row per ask."""
    per_text = cut(asked.groupBy("doc_id", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("asked")), "asked")
    rows = _texts(documents).join(per_text.hint("merge"), ["doc_id", "part"])  # one plan for all sizes: the asks grow with the texts

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        w = find_words(piece.column("text"), lower=True)
        short = (w.hashes >> np.uint64(32)).astype(np.uint32)
        out: dict[str, list] = {"row": [], "lo": [], "hi": [], "words": []}
        for i, asks in enumerate(piece.column("asked").to_pylist()):
            own = short[w.first[i] : w.first[i + 1]]
            for a in asks:
                out["row"].append(i)
                out["lo"].append(a["lo"])
                out["hi"].append(a["hi"])
                out["words"].append(own[a["lo"] : a["hi"]].tobytes())
        return pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").take(pa.array(out["row"], pa.int64())),
            "part": piece.column("part").take(pa.array(out["row"], pa.int64())),
            "lo": pa.array(out["lo"], pa.int32()), "hi": pa.array(out["hi"], pa.int32()), "words": pa.array(out["words"], pa.binary()),
        })

    cutouts = map_slices(rows, "text", work, "doc_id long, part int, lo int, hi int, words binary")
    return cut(cutouts.dropDuplicates(["doc_id", "part", "lo", "hi"]), "stretches")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``b``."""
    masks: dict[int, int] = {}
    for i, v in enumerate(b.tolist()):
        masks[v] = masks.get(v, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for v in a.tolist():
        hit = row & masks.get(v, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """How many words are equal from the start on."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _extended(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> tuple[int, int, int]:
    """Words of x and y that go on alike, over short mismatches followed by equal words; and how many are equal.

    Goes as far as a share of ``least`` is equal.
    """
    i = j = same = 0
    kept = (0, 0, 0)
    while True:
        n = _run(x[i:], y[j:])
        i, j, same = i + n, j + n, same + n
        if same >= least * max(i, j):
            kept = (i, j, same)
        a, b = x[i : i + _SKIP + _AFTER_SKIP], y[j : j + _SKIP + _AFTER_SKIP]
        if min(len(a), len(b)) < _AFTER_SKIP:
            return kept
        equal = a[:, None] == b[None, :]
        runs = np.ones((len(a) - _AFTER_SKIP + 1, len(b) - _AFTER_SKIP + 1), bool)
        for k in range(_AFTER_SKIP):
            runs &= equal[k : k + runs.shape[0], k : k + runs.shape[1]]
        found = np.argwhere(runs)
        if not len(found):
            return kept
        di, dj = found[np.argmin(found.sum(axis=1))].tolist()
        same += _common(x[i : i + di], y[j : j + dj])
        i, j = i + di, j + dj


def aligned(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The stretches (start, end, start, end, equal words) that a chain stands for in both texts.

    A chain that agrees in too few words is parted at its widest gap, again and again; each part is
    extended to both sides by itself, up to the far end of the run next to it.
    """
    runs, between, aside = [], [], []  # equal words, common words of the gaps, seeds that cross a run
    i, j, k = int(xs[0]), int(ys[0]), 0
    back = 0
    while True:
        n = _run(x[i:], y[j:])
        runs.append((i - back, i + n, j - back, j + n))
        diagonal, i, j = i - j, i + n, j + n
        while k < len(xs) and (xs[k] < i or ys[k] < j):
            if xs[k] - ys[k] != diagonal:
                aside.append((int(xs[k]), int(ys[k])))
            k += 1
        if k == len(xs):
            break
        a, b = x[i : xs[k]], y[j : ys[k]]
        back = _run(a[::-1], b[::-1])
        between.append(_common(a[: len(a) - back], b[: len(b) - back]))
        i, j = int(xs[k]), int(ys[k])
    r = np.array(runs)
    equal = np.concatenate([[0], np.cumsum(r[:, 1] - r[:, 0])])
    common = np.concatenate([[0], np.cumsum(between, dtype=np.int64)])
    gaps = np.maximum(r[1:, 0] - r[:-1, 1], r[1:, 2] - r[:-1, 3])

    def stretch(first: int, last: int, least: float) -> tuple[int, int, int, int, int]:
        start, _, other, _ = runs[first]
        _, end, _, other_end = runs[last]
        x0, y0 = (runs[first - 1][0], runs[first - 1][2]) if first else (0, 0)
        x1, y1 = (runs[last + 1][1], runs[last + 1][3]) if last + 1 < len(runs) else (len(x), len(y))
        di, dj, before = _extended(x[x0:start][::-1], y[y0:other][::-1], least)
        ei, ej, after = _extended(x[end:x1], y[other_end:y1], least)
        same = int(equal[last + 1] - equal[first] + common[last] - common[first]) + before + after
        return start - di, end + ei, other - dj, other_end + ej, same

    def agrees(s: tuple[int, int, int, int, int]) -> bool:
        return s[4] >= MIN_IDENTITY * max(s[1] - s[0], s[3] - s[2])

    whole = stretch(0, len(runs) - 1, 0.0)
    if agrees(whole):
        return [whole]
    out, waiting = [], [(0, len(runs) - 1)]
    while waiting:
        first, last = waiting.pop()
        found = stretch(first, last, MIN_IDENTITY)
        if first == last or agrees(found):
            out.append(found)
        else:
            at = first + int(np.argmax(gaps[first:last]))
            waiting += [(at + 1, last), (first, at)]
    last = None
    for i, j in aside:
        if last and i - j == last[0] - last[1] and i < last[2]:
            continue
        di, dj, before = _extended(x[:i][::-1], y[:j][::-1], MIN_IDENTITY)
        ei, ej, after = _extended(x[i:], y[j:], MIN_IDENTITY)
        out.append((i - di, i + ei, j - dj, j + ej, before + after))
        last = (i, j, i + _run(x[i:], y[j:]))
    return out


def _equal_ahead(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, step: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words are equal from x[i] and y[j] on, by ``step`` (1 or -1), of ``room`` at most; many pairs at once."""
    out, live, width = np.zeros(len(i), np.int64), np.flatnonzero(room > 0), _SKIP + _AFTER_SKIP
    while len(live):
        ahead = out[live, None] + np.arange(width)
        inside = ahead < room[live, None]
        ahead = np.where(inside, ahead, 0) * step[live, None]
        equal = (x[i[live, None] + ahead] == y[j[live, None] + ahead]) & inside
        whole = equal.all(axis=1)
        out[live] += np.where(whole, width, equal.argmin(axis=1))
        live = live[whole]
    return out


def _ahead(words: np.ndarray, at: np.ndarray, step: np.ndarray, room: np.ndarray, outside: int) -> np.ndarray:
    """The words of each window from ``at`` on; ``outside`` where there is none."""
    ahead = np.arange(_SKIP + _AFTER_SKIP)
    inside = ahead < room[:, None]
    return np.where(inside, words[at[:, None] + np.where(inside, ahead, 0) * step[:, None]].astype(np.int64), outside)


def _extended_all(
    x: np.ndarray, i: np.ndarray, room_x: np.ndarray, y: np.ndarray, j: np.ndarray, room_y: np.ndarray, step: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``_extended`` for many pairs at once, each from x[i] and y[j] on by ``step``: with no share asked and with MIN_IDENTITY."""
    kept = np.zeros((2, 3, len(i)), np.int64)
    di, dj, same, live = *np.zeros((3, len(i)), np.int64), np.arange(len(i))
    while len(live):
        a, b, s = i[live] + di[live] * step[live], j[live] + dj[live] * step[live], step[live]
        left_x, left_y = room_x[live] - di[live], room_y[live] - dj[live]
        n = _equal_ahead(x, a, y, b, s, np.minimum(left_x, left_y))
        for moved in (di, dj, same):
            moved[live] += n
        good = live[same[live] >= MIN_IDENTITY * np.maximum(di[live], dj[live])]
        for row, chosen in ((0, live), (1, good)):
            kept[row][:, chosen] = di[chosen], dj[chosen], same[chosen]
        more = np.minimum(left_x, left_y) - n >= _AFTER_SKIP
        live, a, b, s, left_x, left_y = (v[more] for v in (live, a + n * s, b + n * s, s, left_x - n, left_y - n))
        equal = _ahead(x, a, s, left_x, -1)[:, :, None] == _ahead(y, b, s, left_y, -2)[:, None, :]
        runs = equal[:, : _SKIP + 1, : _SKIP + 1].copy()
        for k in range(1, _AFTER_SKIP):
            runs &= equal[:, k : k + _SKIP + 1, k : k + _SKIP + 1]
        runs = runs.reshape(len(live), len(_NEAREST))
        found = np.flatnonzero(runs.any(axis=1))
        live, a, b, s = (v[found] for v in (live, a, b, s))
        skip_x, skip_y = np.divmod(_NEAREST[runs[found][:, _NEAREST].argmax(axis=1)], _SKIP + 1)
        for k in np.flatnonzero((skip_x > 0) & (skip_y > 0) & (skip_x + skip_y > 2)).tolist():  # the first words differ
            p, q = a[k] + s[k] * np.arange(skip_x[k]), b[k] + s[k] * np.arange(skip_y[k])
            same[live[k]] += _common(x[p], y[q])
        di[live] += skip_x
        dj[live] += skip_y
    return kept[0], kept[1]


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binaries and the offsets of each row's."""
    data, offsets = text_bytes(column)
    return data.view(kind), offsets // np.dtype(kind).itemsize


def _lone(rows: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray) -> np.ndarray:
    """``aligned`` for chains of one seed, most of all, at once: x[i] meets y[j]; columns start, end, start, end, equal words."""
    x0, x1, y0, y1, one = xo[rows], xo[rows + 1], yo[rows], yo[rows + 1], np.ones(len(rows), np.int64)
    n = _equal_ahead(x, i, y, j, one, np.minimum(x1 - i, y1 - j))
    both = np.concatenate
    loose, strict = _extended_all(
        x, both([i - 1, i + n]), both([i - x0, x1 - i - n]), y, both([j - 1, j + n]), both([j - y0, y1 - j - n]), both([-one, one])
    )

    def stretch(kept: np.ndarray) -> np.ndarray:
        (di, dj, before), (ei, ej, after) = kept[:, : len(rows)], kept[:, len(rows) :]
        return np.stack([i - x0 - di, i - x0 + n + ei, j - y0 - dj, j - y0 + n + ej, n + before + after])

    whole = stretch(loose)
    agrees = whole[4] >= MIN_IDENTITY * np.maximum(whole[1] - whole[0], whole[3] - whole[2])
    return np.where(agrees, whole, stretch(strict))


def _laid(piece: pa.RecordBatch) -> pa.RecordBatch:
    doc, part, anchor, anchor_part, lo, anchor_lo = (piece.column(c).to_numpy().astype(np.int64) for c in (*PAIR, "lo", "anchor_lo"))
    (xs, first), (ys, _) = _numbers(piece.column("at"), np.int32), _numbers(piece.column("anchor_at"), np.int32)
    (x, xo), (y, yo) = (_numbers(piece.column(c), np.uint32) for c in ("words", "anchor_words"))
    own = np.repeat(np.arange(len(doc)), np.diff(first))
    i, j = xo[own] + xs - lo[own], yo[own] + ys - anchor_lo[own]
    good = (i < xo[own + 1]) & (j < yo[own + 1])  # texts of a doc_id with one hash: a seed need not stand in the one
    good[good] = x[i[good]] == y[j[good]]
    own, i, j = own[good], i[good], j[good]
    seeds_of = np.bincount(own, minlength=len(doc))
    lone = seeds_of[own] == 1
    rows, made = [own[lone]], [_lone(own[lone], i[lone], j[lone], x, xo, y, yo)]
    begin = np.concatenate([[0], np.cumsum(seeds_of)])
    for r in np.flatnonzero(seeds_of > 1).tolist():
        at = slice(begin[r], begin[r + 1])
        parts = aligned(x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]], i[at] - xo[r], j[at] - yo[r])
        rows.append(np.full(len(parts), r))
        made.append(np.array(parts, np.int64).T)
    rows, (a, b, c, d, same) = np.concatenate(rows), np.concatenate(made, axis=1)
    a, b, c, d = a + lo[rows], b + lo[rows], c + anchor_lo[rows], d + anchor_lo[rows]
    seen = {
        "doc_id": (doc[rows], anchor[rows]), "part": (part[rows], anchor_part[rows]),
        "start": (a, c), "end": (b, d), "other": (anchor[rows], doc[rows]), "same": (same, same),
    }
    return pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(both), pa.int64()) for name, both in seen.items()})


def links(documents: DataFrame) -> DataFrame:
    """``doc_id, part, start, end, other, same``: aligned stretches of words, seen from both documents of each link."""
    found = matches(seeds(documents))
    found = found.repartition("doc_id", "anchor").sortWithinPartitions(*PAIR, "pos", "anchor_pos")
    chained = cut(found.select(*PAIR, "pos", "anchor_pos").mapInArrow(_chained, CHAIN), "chains")
    key = ("doc_id", "part", "lo", "hi")
    anchor_key = ("anchor", "anchor_part", "anchor_lo", "anchor_hi")
    asked = chained.select(*key).unionByName(chained.select(*(F.col(a).alias(k) for k, a in zip(key, anchor_key))))
    words = stretches(documents, asked.distinct())
    other = words.select(*(F.col(k).alias(a) for k, a in zip(key, anchor_key)), F.col("words").alias("anchor_words"))
    both = chained.join(words, list(key)).join(other, list(anchor_key))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _laid(batch)

    return both.mapInArrow(work, "doc_id long, part long, start long, end long, other long, same long")


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words and other_doc_id (the smallest other holder met) of every repeated passage."""
    laid = links(documents).groupBy("doc_id", "part", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    order = Window.partitionBy("doc_id", "part").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reach + JOIN_GAP).cast("int"), F.lit(1))
    laid = laid.withColumn("opens", opens).withColumn("no", F.sum("opens").over(order))
    united = laid.groupBy("doc_id", "part", "no").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id")
    )
    united = united.withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= MIN_WORDS)
    return united.groupBy("doc_id", "start_word", "end_word", "n_words").agg(F.min("other_doc_id").alias("other_doc_id"))
