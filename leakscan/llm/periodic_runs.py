"""Periodic runs of words within a text: a stretch that repeats itself at least four times.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(min_words, repeats * q)`` words that no neighbouring word extends. Seeds
are extended along diagonals, text by text:

1. Index. Periods are taken in classes of (2^(c-1), 2^c]. Words that lie one
   period apart in a run are equal over ``overlap`` words at least, the least
   that any period of the class guarantees, so all k-grams of that length get a
   name: the number of their content, made by doubling shorter names. Names are
   exact, there are no hash collisions.
2. Pairs. As a k-gram of a class is no shorter than the class's periods, the
   next place of a k-gram inside a run is exactly one period on. So each place
   is paired with the next one of the same name alone, and no name's places are
   ever paired with one another.
3. Extension. A pair whose lag lies in the class is extended to both sides. A
   table holds, for each lag, how far its last extension reached; pairs before
   that belong to a diagonal that is known already.

The search ends with the first class none of whose k-grams occurs twice, so
ordinary text costs one or two classes, and any text about n log n steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import by_bytes, utf8

RUN = "struct<start:long,length:long,period:long>"


@dataclass(frozen=True)
class RunOptions:
    min_words: int = 6  # of a run, whatever its period
    repeats: int = 4  # whole periods of a run; 3 at least
    batch_bytes: int = 8 << 20  # of texts that are held as words at once


def name_words(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs of names, numbered from 0."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


class KGrams:
    """Exact names of all k-grams of a text, for growing k."""

    def __init__(self, words: np.ndarray):
        self._names, self._width = words, 1

    def names(self, k: int) -> np.ndarray:
        """The name of the ``k`` words from each place on; ``k`` is at least that of the call before."""
        while 2 * self._width <= k:
            self._names = _pair_names(self._names[: -self._width], self._names[self._width :])
            self._width *= 2
        over = k - self._width
        return _pair_names(self._names[:-over], self._names[over:]) if over else self._names


def guaranteed_overlap(low: int, options: RunOptions) -> int:
    """Over how many words a run is equal to itself one period on, for any period from ``low`` on. Never less than 2 * low."""
    turn = max(low, options.min_words // options.repeats)  # up to here a longer period leaves less, behind it more
    return min(max(options.min_words, options.repeats * q) - q for q in (turn, turn + 1))


def next_places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, the next place of the same name), in order of place."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    first, second = order[:-1][same], order[1:][same]
    by_place = np.argsort(first)
    return first[by_place], second[by_place]


def _equal_run(x: np.ndarray, y: np.ndarray) -> int:
    """How many words two stretches of one length begin with in common, looked at in growing blocks."""
    at, block = 0, 32
    while at < len(x):
        differ = np.flatnonzero(x[at : at + block] != y[at : at + block])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, 2 * block
    return len(x)


def find_runs(words: np.ndarray, options: RunOptions = RunOptions()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text given as word numbers, by start, then period."""
    n, out, grams = len(words), [], KGrams(words)
    low, high = 1, 1  # the periods of the class
    while max(options.min_words, options.repeats * low) <= n:
        overlap = guaranteed_overlap(low, options)
        places, others = next_places(grams.names(overlap))
        if not len(places):
            break
        wanted = (others - places >= low) & (others - places <= high)
        reached: dict[int, int] = {}
        for i, j in zip(places[wanted].tolist(), others[wanted].tolist(), strict=True):
            lag = j - i
            if i < reached.get(lag, 0):
                continue
            back = _equal_run(words[:i][::-1], words[lag:j][::-1])
            on = overlap + _equal_run(words[i + overlap : n - lag], words[j + overlap :])
            reached[lag] = i + on
            length = back + on + lag
            if length >= max(options.min_words, options.repeats * lag):
                out.append((i - back, length, lag))
        low, high = high + 1, 2 * high
    return sorted(out, key=lambda r: (r[0], r[2]))


def _higher(r: tuple[int, int, int], s: tuple[int, int, int]) -> int:
    """Order by exact length / period, highest first; then by start and period."""
    return s[1] * r[2] - r[1] * s[2] or r[0] - s[0] or r[2] - s[2]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """(doc_id, runs, best, collapsed): the periodic runs of each row's whole text.

    Words lie between ASCII white space. ``runs`` is an array of (start, length,
    period), counted in words from 0, by start, then period; ``best`` the one
    with the highest exact length / period, the first of equal ones by start,
    then period, or null; ``collapsed`` the text's words without those that a
    run has behind its first period, one space between them. Runs may overlap.

    A row for each row, in any order: repeated rows and ids, and rows without an
    id, each have theirs. A null or empty text, or one of white space, has no
    runs and collapses to the empty text. An empty table gives an empty one.
    Other columns are not read. A map over the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "text", options.batch_bytes):
                found, best, left = [], [], []
                for data in utf8(some.column(1)):
                    words = data.split()
                    runs = find_runs(name_words(words), options)
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    best.append(found[-1][runs.index(min(runs, key=cmp_to_key(_higher)))] if runs else None)
                    left.append(b" ".join(collapse(words, runs)).decode())
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(found, pa.list_(kind)), pa.array(best, kind), pa.array(left, pa.string())],
                    ["doc_id", "runs", "best", "collapsed"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id long, runs array<{RUN}>, best {RUN}, collapsed string")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, every tenth one (by the crc32 of its id) with a repeat of its own planted in it."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    first = words[a : a + p]
    return words[:a] + (first * (-(-(n - a) // len(first))))[: n - a]


def plant_repeats(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """(doc_id, text) with repeats planted in every tenth document, to look for.

    In rows that get none, and in those without an id, the text stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "text", options.batch_bytes):
                texts = []
                for doc_id, data in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = (data or b"").split()
                    new = planted(words, doc_id)
                    texts.append(data if new is words else b" ".join(new))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, text string")
