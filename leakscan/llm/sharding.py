"""A uniform shuffle of all records into shards, by two external passes.

1. Scatter. A seeded hash sends every record to one of so many buckets that one
   fits into a task's memory; the exchange keeps them on disk. The hash takes
   the record's id, so a bucket's size doesn't depend on how texts or sources
   are spread. Where ids repeat, records are numbered once, in a written table,
   and the number is hashed too: copies of one record do not share a bucket.
2. Shuffle. Each bucket is put in order of the hash and then shuffled by Fisher
   and Yates with a generator seeded by the bucket's number, and written.

The buckets one behind the other are a permutation of all records in which
every order is as likely as any other. Shards are equal cuts of it, so their
counts are at most one apart, and a bucket is written to the one or two shards
its places fall in. Both passes give the same rows again when an executor is
lost: nothing depends on the order in which records arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from leakscan.sources.workspace import fresh_path, materialise

ADDED = ["shard", "slot"]


@dataclass(frozen=True)
class ShardOptions:
    shards: int = 16
    seed: int = 1
    bucket_bytes: int = 16 << 20  # of a bucket's texts, on average; several times that is a worker's memory
    batch_bytes: int = 4 << 20  # of texts that are handed back at once


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of 0 to n - 1: each place, from the last on, is swapped with one drawn from those not after it."""
    order = list(range(n))
    drawn = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for k, j in zip(range(n - 1, 0, -1), drawn, strict=False):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def shard_starts(n: int, shards: int) -> np.ndarray:
    """The place at which each shard begins, and the end of the last."""
    return np.array([k * n // shards for k in range(shards + 1)], np.int64)


def _dealt(docs: DataFrame, options: ShardOptions) -> DataFrame:
    """(row, hash, tie, size): each record as a struct, so that no column's name can clash, and its seeded hash.

    Where ids repeat, the record's number is hashed too. Equal hashes of unlike
    ids are rare; ``tie`` puts these in order, whatever way they came.
    """
    packed = docs.select(F.struct("*").alias("row"))
    repeated = not packed.groupBy("row.doc_id").count().where("count > 1").isEmpty()
    number = [F.monotonically_increasing_id()] if repeated else []
    dealt = packed.select(
        "row",
        F.xxhash64(F.lit(options.seed), "row.doc_id", *number).alias("hash"),
        F.xxhash64(F.lit(options.seed), "row.text").alias("tie"),
        (F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1).cast("long").alias("size"),
    )
    return materialise(dealt, "numbered") if repeated else dealt


def shuffled(docs: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a random permutation of all rows, cut into shards of equal counts.

    ``shard`` is int, from 0; ``slot`` long, a row's place in its shard, from 0
    without gaps. The permutation depends on the seed, the ids and the number of
    buckets alone as long as no id occurs twice, and otherwise on the order of
    the input too; every row has a place of its own. Null ids and texts are
    values like any other. With fewer rows than shards some shards are empty,
    and an empty table gives an empty one. Of the columns of ``docs`` those that
    are named ``shard`` or ``slot`` are replaced; all others are kept.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(1, -(-size // options.bucket_bytes))
    dealt = _dealt(docs, options).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    # One number for each bucket: as many as the exchange has partitions.
    counts = np.zeros(buckets + 1, np.int64)
    for bucket, count in dealt.groupBy("bucket").count().collect():
        counts[bucket + 1] = count
    firsts = np.cumsum(counts)
    starts = shard_starts(int(firsts[-1]), options.shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        bucket = TaskContext.get().partitionId()
        order = pa.compute.sort_indices(rows, [("hash", "ascending"), ("tie", "ascending")]).to_numpy()
        order = order[fisher_yates(len(order), (options.seed, bucket))]
        place = firsts[bucket] + np.arange(len(order))
        shard = np.searchsorted(starts, place, "right") - 1
        part = np.cumsum(rows.column("size").to_numpy()[order]) // options.batch_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(order)]
        for begin, end in zip(edges, edges[1:], strict=False):
            some = rows.column("row").take(pa.array(order[begin:end]))
            added = [pa.array(shard[begin:end], pa.int32()), pa.array((place - starts[shard])[begin:end])]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(some.chunks), *added], ["row", *ADDED])

    exchanged = dealt.repartitionById(buckets, F.col("bucket")).select("row", "hash", "tie", "size")
    schema = StructType([StructField("row", docs.schema), StructField("shard", IntegerType()), StructField("slot", LongType())])
    return exchanged.mapInArrow(run, schema).select("row.*", *ADDED)


def write_shards(docs: DataFrame, path: str, options: ShardOptions = ShardOptions()) -> str:
    """Write ``shuffled(docs)`` as Parquet, a folder ``shard=<k>`` for each shard that has rows, files in order of slots."""
    shuffled(docs, options).sortWithinPartitions(*ADDED).write.partitionBy("shard").parquet(path)
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` wrote: the columns of ``docs``, ``slot`` and ``shard``."""
    kept = [f for f in docs.schema if f.name.lower() not in ADDED]
    return docs.sparkSession.read.schema(StructType([*kept, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)


def sharded(docs: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """``docs`` written to shards in the shared folder, and read back."""
    return read_shards(docs, write_shards(docs, fresh_path(docs.sparkSession, "shards"), options))
