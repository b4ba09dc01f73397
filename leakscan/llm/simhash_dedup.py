"""Near-duplicate documents: SimHash fingerprints linked by anchor points.

A fingerprint has 64 bits. Two that differ in at most ``2`` bits differ in at
most one bit of the lower or of the upper 31 bits of their halves. The anchors
of a half are the words of the Hamming code of length 31, which is perfect:
every value lies within one bit (the covering radius) of exactly one anchor.
Each fingerprint is sent to all anchors within the covering radius plus the
threshold, that is two bits: sixteen of the 2^26, or one. The neighbour's own
anchor is among them, so comparing, at each anchor, those that live there with
those sent there finds every pair, and none twice.

Equal fingerprints are one class before anything is compared, so a group of
copies costs one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import unused, utf8
from leakscan.llm.components import components
from leakscan.sources.workspace import materialise

_LANE = np.uint64(0x0001000100010001)
_RUN = 65535  # hashes that fit a 16-bit lane
_HALF = (1 << 31) - 1
_NO_ID = (1 << 63) - 1  # stands for a null id, after all others


def shingle_hashes(data: bytes, words_each: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, repeats included; of the whole sequence if it is shorter."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    count = len(words) - words_each + 1
    if count <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: count - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none. Sixteen passes of four 16-bit counters each."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    runs = np.arange(0, len(hashes), _RUN)
    for shift in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(shift) & _LANE, runs)
        for lane in range(4):
            ones[shift + 16 * lane] = int((sums >> np.uint64(16 * lane) & np.uint64(0xFFFF)).sum())
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """(doc_id, fp) for every row: fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([majority(shingle_hashes(data, words_each)) for data in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def syndromes(values: np.ndarray) -> np.ndarray:
    """Which bit (1 to 31) to flip to reach the nearest code word; 0 if the value is one."""
    out = np.zeros(len(values), np.int64)
    for bit in range(31):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def anchors_within_two(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every code word within two bits of each 31-bit value; a row's first is its home."""
    flips = np.concatenate([[0], 1 << np.arange(31)])  # by bit number, from 1
    s = syndromes(values)
    home = values ^ flips[s]
    rows, anchors = [np.arange(len(values))], [home]
    away = np.flatnonzero(s)
    for first in range(1, 32):
        second = first ^ s[away]
        pick = second > first
        rows.append(away[pick])
        anchors.append(values[away[pick]] ^ flips[first] ^ flips[second[pick]])
    return np.concatenate(rows), np.concatenate(anchors)


def _sent(classes: DataFrame) -> DataFrame:
    """(key, home, fp, rep): each class at its home and at every anchor in reach, for either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            for half in (0, 1):
                rows, anchors = anchors_within_two(fp >> (32 * half) & _HALF)
                home = np.arange(len(rows)) < len(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors | half << 31), pa.array(home), pa.array(fp[rows]), pa.array(rep[rows])],
                    ["key", "home", "fp", "rep"],
                )

    return classes.select("fp", "rep").mapInArrow(run, "key long, home boolean, fp long, rep long")


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v) representatives of every two classes (fp, rep) whose fingerprints differ in 1 to ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors are laid out for at most two differing bits")
    sent = _sent(classes)
    here = sent.where("home").select("key", F.col("fp").alias("fp1"), F.col("rep").alias("u"))
    there = sent.select("key", F.col("fp").alias("fp2"), F.col("rep").alias("v"))
    differ = F.col("fp1").bitwiseXOR(F.col("fp2"))
    lower = F.bit_count(differ.bitwiseAND(F.lit(_HALF)))
    near = here.join(there, "key").where((F.col("fp1") < F.col("fp2")) & (F.bit_count(differ) <= max_bits))
    # A pair may meet in either half; the one that is bound to find it counts.
    return near.where((F.col("key") < F.lit(1 << 31)) == (lower <= 1)).select("u", "v")


def near_duplicates(docs: DataFrame, words_each: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Texts without words have fingerprint zero and link like any other. A null
    id takes part but names a group only where no row of it has an id
    (component_id is then null). Repeated rows come out as often as they came
    in; an empty table gives an empty one. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, words_each), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("rep")), "classes")
    nameless = classes["rep"] == _NO_ID
    some_nameless = not classes.where(nameless).isEmpty()
    # A class without an id gets a node below all others; classes that share one differ in the top bit only.
    nodes = classes.withColumn("node", F.when(nameless, F.col("fp").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("rep")))
    roots = components(links(nodes.select("fp", F.col("node").alias("rep")), max_bits)).withColumnRenamed("node", "of")
    named = nodes.join(roots, nodes["node"] == roots["of"], "left").select("fp", "rep", F.coalesce("root", "node").alias("root"))
    if some_nameless:
        least = named.groupBy("root").agg(F.min(F.nullif("rep", F.lit(_NO_ID))).alias("least"))
        named = named.join(least, "root").select("fp", F.col("least").alias("root"))
    else:
        named = named.select("fp", "root")
    named = materialise(named, "components")
    joined = prints.join(named, "fp")
    return joined.select("doc_id", "fp", F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, words_each: int = 3, max_bits: int = 2, broadcast_ids: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` without those that are near copies: of each group the smallest doc_id stays.

    Rows without an id are kept, as no result names them, and join no groups.
    Rows that share an id are compared each by itself: unlike ones all stay, of
    near copies the one with the smallest text. Up to ``broadcast_ids`` ids of
    8 bytes that go are sent to all tasks, so no text is exchanged.
    """
    named, key = docs.where("doc_id IS NOT NULL"), unused(docs, "key")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        keyed = named.withColumn(key, F.col("doc_id").cast("long"))
    else:
        keyed = materialise(named.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words_each, max_bits)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "gone")
    kept = keyed.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, key, "left_anti")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
