"""Periodic runs of words, by the harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least max(LEAST, TIMES q)
words, which no neighbouring word extends.  For each period p up to n / TIMES, the words at p, 2p, 3p, ... are compared with
their followers jp and (j+1)p: if e words agree from there on and b before, words jp - b to (j+1)p + e have period p, and
no more around them.  Any run of period p covers several points of that grid, so it is met.  Both extensions come from
suffix arrays (of the words, and of the words reversed) with range minima over the common prefixes of neighbours.  A stretch
met with several periods is a run of the smallest: by the theorem of Fine and Wilf the others are its multiples.

Several documents share one array, parted by words of their own; a long one has its own.  Pairs whose two words differ have
an extension of 0, and a run covers at least TIMES points, so three equal pairs in a row: the middle ones are asked, and
documents without any need no arrays.  The grid has n ln n points, which are made in slices of SLICE.

Words are what stands between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns; a null text has none,
an empty text neither: both give 0 runs, null for the longest one, and the hashes of the empty string.  Texts are worked
on whole whatever their length; equal texts, also of repeated rows, give equal results; an empty table no rows.  Columns
``keep`` come back whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.ship import map_texts

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words that one array holds, where single documents do not need more; grid points in memory at once.
WORDS, SLICE = 1 << 17, 1 << 20


def _sorted_ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the common prefix of each suffix with the one before it, by doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank.astype(np.int32)], 1
    while True:
        pair = rank * (n + 1)
        if step < n:
            pair[: n - step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        told = pair[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(told[1:] != told[:-1])])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
        levels.append(rank.astype(np.int32))
    # Neighbours in the suffix array: each level says whether another 2^k words agree.
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int32)
    at = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + at, b + at
        fits = (x < n) & (y < n)
        same = np.zeros(n - 1, bool)
        same[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        at[same] += 1 << k
    common[1:] = at
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    return order, inverse, common


def extensions(words: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of places: how many words agree from there on.  Places must differ."""
    _, inverse, common = _sorted_ranks(words)
    minima, width = [common], 1
    while 2 * width <= len(common):
        last = minima[-1]
        minima.append(np.minimum(last[:-width], last[width:]))
        width *= 2

    def asked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = inverse[i], inverse[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(minima[k][lo[at]], minima[k][hi[at] - (1 << int(k))])
        return out

    return asked


def grid(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid points of every document whose word equals the next one's, as on the pairs before and after."""
    docs = np.repeat(np.arange(len(size)), size // TIMES)
    first = np.concatenate([[0], np.cumsum(size // TIMES)])
    period = np.arange(len(docs)) - first[docs] + 1
    points = (size[docs] - 1) // period  # pairs (jp, (j+1)p) with (j+1)p inside
    ends = np.cumsum(points)
    places, periods = [], []
    at = 0
    while at < len(docs):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        n = points[at:to]
        p = np.repeat(period[at:to], n)
        j = np.arange(len(p)) - np.repeat(ends[at:to] - n - done, n)
        x = np.repeat(start[docs[at:to]], n) + j * p
        same = words[x] == words[x + p]
        inner = np.zeros(len(same), bool)
        inner[1:-1] = same[:-2] & same[1:-1] & same[2:] & (j[2:] > 1)
        places.append(x[inner])
        periods.append(p[inner])
        at = to
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def found(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each document's word numbers, the runs as rows (start, length, period) by start, then period."""
    size = np.array([len(t) for t in texts], np.int64)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    place, period = grid(words, start, size)
    if not len(place):
        return out
    # Only the documents with such points, each followed by a word that no other has.
    doc = np.searchsorted(start, place, "right") - 1
    some = np.unique(doc)
    new_start = np.zeros(len(texts), np.int64)
    new_start[some] = np.concatenate([[0], np.cumsum(size[some] + 1)])[:-1]
    top = int(words.max()) + 1
    joined = np.concatenate([np.append(texts[d], top + i) for i, d in enumerate(some)])
    x = place - start[doc] + new_start[doc]
    y = x + period
    ahead = extensions(joined)(x, y)
    n = len(joined)
    behind = np.zeros(len(x), np.int64)
    inner = x > 0
    behind[inner] = extensions(joined[::-1])(n - x[inner], n - y[inner])
    from_, to = x - behind, y + ahead
    good = to - from_ >= np.maximum(LEAST, TIMES * period)
    rows = np.stack([doc[good], from_[good] - new_start[doc[good]], (to - from_)[good], period[good]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    at = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for d in some:
        out[d] = rows[at[d] : at[d + 1], 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run has after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step)[:n] == 0


def with_loop(words: list, g: int) -> list:
    """The words with their end made periodic, as the number says."""
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def planted(documents: DataFrame) -> Column:
    """For each document the number by which its end is made periodic, null for most: of its id's CRC-32 h, h / 10 where 10
    divides h."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.when((h % 10 == 0) & F.col("doc_id").isNotNull(), F.floor(h / 10))


_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _results(texts: list[list[bytes]], runs: list[np.ndarray]) -> list[tuple]:
    out = []
    for words, r in zip(texts, runs):
        if len(r):
            best = r[np.lexsort((r[:, 2], r[:, 0], -r[:, 1]))[0]]
            s, l, p = (int(v) for v in best)
            kept = [w for w, k in zip(words, kept_words(len(words), r).tolist()) if k]
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in r.tolist())
            out.append((len(r), s, l, p, 1000 * l // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
        else:
            out.append((0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    return out


def _maker(planting: bool):
    def make():
        def work(texts: list[str]) -> dict:
            rows: list[tuple] = []
            group: list[list[bytes]] = []
            total = 0

            def flush():
                nonlocal total
                known: dict[bytes, int] = {}
                numbered = [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in group]
                rows.extend(_results(group, found(numbered)))
                group.clear()
                total = 0

            for text in texts:
                loop = None
                if planting:
                    loop, _, text = text.partition(":")
                words = text.encode().split()
                if loop and words:
                    words = with_loop(words, int(loop))
                if group and total + len(words) > WORDS:
                    flush()
                group.append(words)
                total += len(words)
            if group:
                flush()
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            names = [f.split()[0] for f in _FIELDS.split(", ")]
            return {n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)}

        return work

    return make


def periodic(documents: DataFrame, keep: list[str], loops: Column | None = None) -> DataFrame:
    """keep..., n_runs, the longest run (start, length, period, 1000 times its exponent; ties: the first, then the smaller
    period), the hash of all runs, and of the text without the words that repeat in a run.

    ``loops``: a number or null for each document; by the number the document's end is made periodic first (``with_loop``).
    """
    if loops is None:
        return map_texts(documents, _maker(False), _FIELDS, keep)
    from densigrid.llm.ship import fresh

    # The number travels in front of the text, as there is one text a row.
    name = fresh(documents, "looped")
    text = F.concat(F.coalesce(loops.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return map_texts(documents.withColumn(name, text), _maker(True), _FIELDS, keep, text=name)
