"""Stretches of words that repeat with a period, by power-of-two naming.

The words of a batch of texts stand in one array.  Level k names every stretch
of 2^k words: a name is the rank of the pair of level k-1 names of its halves
(Karp, Miller, Rosenberg), so two stretches are equal if and only if their names are.
Names are a text's own, hence no match leaves a text, and a stretch that occurs
once is never looked at again.

A run of period q and at least 4 * q words covers three whole blocks of the
grid 0, q, 2q, ... and each of the first two equals the next.  So only chains
of equal neighbouring blocks, found by two names each, are candidates; their
ends are extended by less than q words, in descending levels of names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are named together; a longer text is a batch of its own.
BATCH_WORDS = 500_000
FIELDS = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,best:struct<start:long,length:long,period:long>,collapsed:string>"


def words_of(text: str) -> list[bytes]:
    """Maximal stretches without space, tab, line feed, vertical tab, form feed or carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def first_names(texts: list[list[bytes]]) -> np.ndarray:
    """Level 0: equal words of a text share a name, no other words do."""
    out: list[np.ndarray] = []
    taken = 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + taken)
        taken += len(known)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _settled(names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of the ``n`` places with repeats ranked from 0 and every single one negative; the places that repeat."""
    again = np.flatnonzero(np.bincount(names, minlength=1)[names] > 1)
    out = -1 - np.arange(n + 1)
    ranks, inverse = np.unique(names[again], return_inverse=True)
    out[again] = inverse
    return out, again, len(ranks)


def naming(first: np.ndarray) -> Iterator[np.ndarray]:
    """Names by level, while any repeats; place n, behind the last word, has a name of its own."""
    n = len(first)
    level, live, count = _settled(first, n)
    step = 1
    while len(live):
        yield level
        ahead = live[live + step < n]
        ahead = ahead[level[ahead + step] >= 0]
        pairs = level[ahead] * count + level[ahead + step]
        found, inverse, times = np.unique(pairs, return_inverse=True, return_counts=True)
        kept = times[inverse] > 1
        rank = np.cumsum(times > 1) - 1
        count = int((times > 1).sum())
        live = ahead[kept]
        level = -1 - np.arange(n + 1)
        level[live] = rank[inverse[kept]]
        step *= 2


def _ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from places a and b on, fewer than twice the longest named stretch."""
    n, done = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + done, n), np.minimum(b + done, n)
        done += (levels[k][x] == levels[k][y]) * (1 << k)
    return done


def _behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words before places a < b."""
    done = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - done - (1 << k), b - done - (1 << k)
        done += ((x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])) * (1 << k)
    return done


def find_runs(first: np.ndarray, longest: int) -> np.ndarray:
    """All runs as rows (start, length, period), by start and period.

    ``first`` are level 0 names, ``longest`` the words of the longest text:
    periods beyond a quarter of it cannot repeat often enough.
    """
    n, levels, found = len(first), [], []
    for k, level in enumerate(naming(first)):
        levels.append(level)
        for q in range(1 << k, min((1 << k + 1) - 1, longest // LEAST_PERIODS) + 1):
            blocks = n // q - 1  # block t is equal to block t + 1: its first and its last 2^k words are
            head, tail = level[: n + 1 : q], level[q - (1 << k) : n + 1 : q]
            equal = (head[:blocks] == head[1 : blocks + 1]) & (tail[:blocks] == tail[1 : blocks + 1])
            if not (equal[:-1] & equal[1:]).any():
                continue
            turns = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
            starts, ends = turns[::2], turns[1::2]
            chained = ends - starts > 1
            x, y = starts[chained] * q, ends[chained] * q  # blocks from x on equal the next; y begins the last of the chain
            a = x - _behind(levels, x, x + q)
            length = y + q + _ahead(levels, y, y + q) - a
            good = length >= max(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.stack([a[good], length[good], np.full(int(good.sum()), q)], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), bool)  # the same stretch has every multiple of its period too
    smallest[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def described(texts: list[str]) -> list[dict]:
    """What :func:`with_runs` says of each text."""
    words = [words_of(t) for t in texts]
    first = np.cumsum([0, *map(len, words)])
    runs = find_runs(first_names(words), max(map(len, words), default=0))
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, (text, ws) in enumerate(zip(texts, words)):
        own = (runs[cuts[i] : cuts[i + 1]] - [first[i], 0, 0]).tolist()
        best, kept = None, ws
        if own:
            best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            depth = np.zeros(len(ws) + 1, np.int64)
            for a, length, q in own:
                depth[a + q] += 1
                depth[a + length] -= 1
            kept = [w for w, d in zip(ws, np.cumsum(depth[:-1])) if not d]
        row = lambda r: dict(zip(("start", "length", "period"), r))
        out.append({"n_words": len(ws), "runs": [row(r) for r in own], "best": row(best) if best else None, "collapsed": b" ".join(kept).decode("utf-8", "surrogatepass")})
    return out


def with_runs(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """Add the column ``name``: the periodic runs of each whole text, and the text with each run collapsed to one period.

    Fields: ``n_words``; ``runs`` of ``start, length, period`` in words, by
    start and then period, each maximal, with its smallest period, at least 6
    words and 4 periods long; ``best``, the run with most periods (ties: the
    earlier, the shorter period), null without runs; ``collapsed``, the words
    outside of all runs' repeats joined by one space.

    Null, empty and word-less texts have no runs and collapse to the empty
    string.  Rows that repeat count each for itself, other columns are carried
    along untouched.  Memory is that of a batch of ``BATCH_WORDS`` words or of
    one longer text: some 100 bytes a word, and 8 for each level in which a
    stretch of it repeats.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("best", run), ("collapsed", pa.string())])

    @F.arrow_udf(FIELDS)
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts, group, size = [], [], 0
            for text in column:
                group.append(text.as_py() or "")
                size += len(group[-1]) // 4
                if size >= BATCH_WORDS:
                    parts, group, size = [*parts, pa.array(described(group), kind)], [], 0
            yield pa.concat_arrays([*parts, pa.array(described(group), kind)])

    return docs.withColumn(name, runs(F.col(text_col).cast("string")))
