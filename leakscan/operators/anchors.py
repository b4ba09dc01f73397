"""Finding many values in many texts by one whole run of identifier characters.

A value counts where it is not part of a longer word. So every run of identifier
characters inside it is a whole run of the text there, the first and the last
ones included, and one of them, the longest, can stand for the value: its
*anchor*. Values without such a character have the first bytes of themselves as
anchor, to be met inside text without such characters.

Texts are read where they lie. A small filter of all anchors decides which runs
of a text may be anchors; only those leave, each with as much of the text around
it as a value can need. They are joined to the values by hash and compared
there. However many values there are, no text is shuffled or copied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from leakscan.operators.membership import HashFilter, build_filters

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")] = True
_PAD = 8  # bytes behind a text that may be looked at
_GRAM = 8  # bytes of an anchor without identifier characters, at most
_NEAREST = 64  # bytes around an anchor in the first class of values; those of the next reach four times as far
BLOCK_BYTES = 4 << 20  # of text that is searched at once


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def _repo_hash(repo: str) -> int:
    return zlib.crc32(repo.encode()) << 8


class _Bytes:
    """Some texts one behind the other, a NUL between them, and eight bytes as a number from any place on."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = b"\0".join(texts) + bytes(_PAD)
        #: Where each text begins, and the end of the last.
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        size = len(self.data) - _PAD
        self.raw = np.frombuffer(self.data, np.uint8)[:size]
        self._eight = np.ndarray(size + 1, "<u8", self.data, strides=(1,))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def word_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of all whole runs of identifier characters."""
        edges = np.flatnonzero(np.diff(_WORD[self.raw], prepend=False, append=False))
        return edges[::2], edges[1::2]

    def symbol_grams(self, size: int) -> np.ndarray:
        """Where ``size`` bytes without an identifier character begin."""
        begins, ends = self.word_runs()
        stretches, until = np.append(0, ends), np.append(begins, len(self.raw))
        counts = np.maximum(until - stretches - size + 1, 0)
        return np.repeat(stretches - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())

    def hashes(self, begins: np.ndarray, ends: np.ndarray, repos: np.ndarray) -> np.ndarray:
        """Of runs with their repository: length, first, middle and last eight bytes. Equal hashes are compared later."""
        size = ends - begins
        short = size < 8
        mask = np.where(short, (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        out = _mixed(repos + size.astype(np.uint64) + np.uint64(1))
        for at in (begins, np.where(short, begins, begins + size // 2 - 4), np.where(short, begins, ends - 8)):
            out = _mixed(out * np.full(1, _ODD) + (self._eight[at] & mask))
        return out


@dataclass(frozen=True)
class AnchorFilter:
    """What tasks need to know of all anchors."""

    classes: tuple[tuple[int, HashFilter], ...]  # (bytes around an anchor, the anchors)
    shortest: int  # bytes of an anchor that is a run
    longest: int
    gram: int  # bytes of an anchor that is none; 0 if there are none

    def reach(self, hashes: np.ndarray) -> np.ndarray:
        """Bytes around each place that a value may need; -1 where none is anchored."""
        out = np.full(len(hashes), -1, np.int64)
        for reach, held in self.classes:
            out[held.may_hold(hashes)] = reach
        return out


def anchored(values: DataFrame, gram: int) -> DataFrame:
    """``values(repo, ord, value)`` with hash, before and size: its anchor, the bytes before it and all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v or b"" for v in batch.column(2).cast(pa.binary()).to_pylist()]
            held = _Bytes(texts)
            repos = np.array([_repo_hash(r or "") for r in batch.column(0).to_pylist()], np.uint64)
            begins, ends = held.word_runs()
            of = held.text_of(begins)
            longest = np.lexsort((begins, begins - ends, of))
            longest = longest[np.flatnonzero(np.diff(of[longest], prepend=-1))]
            first, last = held.starts[:-1].copy(), held.starts[:-1] + gram
            first[of[longest]], last[of[longest]] = begins[longest], ends[longest]
            hashes = held.hashes(first, np.minimum(last, held.starts[1:] - 1), repos)
            added = [hashes.view(np.int64), (first - held.starts[:-1]).astype(np.int32), np.array([len(t) for t in texts], np.int32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], ["repo", "ord", "value", "hash", "before", "size"])

    return values.select("repo", "ord", "value").mapInArrow(run, "repo string, ord string, value string, hash long, before int, size int")


def gram_bytes(values: DataFrame) -> int:
    """Bytes that stand for a value without identifier characters; 0 if all have some."""
    least = values.where(~F.rlike("value", F.lit("[A-Za-z0-9_]")) & (F.col("value") != "")).agg(F.min(F.octet_length("value"))).first()[0]
    return min(least or 0, _GRAM)


def build_filter(found: DataFrame, gram: int) -> AnchorFilter:
    """The filter of ``anchored`` values."""
    behind = F.greatest(F.col("before"), F.col("size") - F.col("before"))
    distance = F.greatest(F.ceil(F.log2(behind / _NEAREST) / 2), F.lit(0)).cast("int")
    classed = found.where("size > 0").select(distance.alias("kind"), "hash", F.col("value"))
    run = F.array_max(F.transform(F.split("value", "[^A-Za-z0-9_]+"), F.octet_length))
    sizes = classed.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.when(run > 0, run)).alias("shortest"), F.max(run).alias("longest")).collect()
    if not sizes:
        return AnchorFilter((), 0, 0, 0)
    filters = build_filters(classed, {r["kind"]: r["n"] for r in sizes})
    classes = tuple((_NEAREST * 4**kind, filters[kind]) for kind in sorted(filters))
    return AnchorFilter(classes, min((r["shortest"] for r in sizes if r["shortest"]), default=0), max(r["longest"] for r in sizes), gram)


def _slices(batch: pa.RecordBatch, content: int) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(content)), 0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            yield batch.slice(begin, end - begin)


def anchor_places(units: DataFrame, keys: Sequence[str], known: AnchorFilter) -> DataFrame:
    """``keys``, hash, at, line, around: the places in ``content`` that the filter takes for anchors.

    ``around`` are the bytes before and behind that a value may need, and one
    more on either side; ``at`` is where the anchor begins in them, ``line`` the
    line on which they begin. ``keys`` hold ``repo``. A map over the input.
    """
    shared = units.sparkSession.sparkContext.broadcast(known)
    own = units.select(*keys, "content")
    repo = list(keys).index("repo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for some in _slices(batch, len(keys)) if known.classes else ():
                held = _Bytes([t or b"" for t in some.column(len(keys)).cast(pa.binary()).to_pylist()])
                hashed: dict[str | None, int] = {}
                repos = np.array([hashed.setdefault(r, _repo_hash(r or "")) for r in some.column(repo).to_pylist()], np.uint64)
                begins, ends = held.word_runs()
                wanted = (ends - begins >= known.shortest) & (ends - begins <= known.longest)
                begins, ends = begins[wanted], ends[wanted]
                if known.gram:
                    grams = held.symbol_grams(known.gram)
                    begins, ends = np.append(begins, grams), np.append(ends, grams + known.gram)
                of = held.text_of(begins)
                hashes = held.hashes(begins, ends, repos[of])
                reach = known.reach(hashes)
                hit = np.flatnonzero(reach >= 0)
                of, begins, reach = of[hit], begins[hit], reach[hit]
                low = np.maximum(begins - reach - 1, held.starts[of])
                high = np.minimum(begins + reach + 1, held.starts[of + 1] - 1)
                breaks = np.flatnonzero(held.raw == 10)
                line = 1 + np.searchsorted(breaks, low) - np.searchsorted(breaks, held.starts[of])
                around = [held.data[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                rows = some.select(list(keys)).take(pa.array(of))
                added = [pa.array(hashes[hit].view(np.int64)), pa.array((begins - low).astype(np.int32)), pa.array(line.astype(np.int32)), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*keys, "hash", "at", "line", "around"])

    added = [StructField("hash", LongType()), StructField("at", IntegerType()), StructField("line", IntegerType()), StructField("around", BinaryType())]
    return own.mapInArrow(run, StructType([*own.drop("content").schema, *added]))
