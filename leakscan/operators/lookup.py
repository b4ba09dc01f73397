"""Joins from a large table to a keyed one, safe for hot keys.

A repository or a blob may own a third of all rows. A side is only broadcast
after its size has been measured; beyond the limit the join spreads every key,
or of stored tables only the hot ones, over salt buckets, so no single task
receives a whole key. Spark takes copies for no larger than what they are made
of and would broadcast them through the driver, so such joins ask for a merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.options import ScanOptions
from leakscan.sources.workspace import materialise


HOT_BYTES = 8 * 1024 * 1024  # of hot keys that may be sent to all tasks in any case: there are at most rows / hot_rows of them


def fits_broadcast(dim: DataFrame, limit_bytes: int) -> bool:
    """Measure ``dim`` with one aggregate: serialised bytes against the limit."""
    size = dim.agg(F.sum(F.octet_length(F.to_json(F.struct(*dim.columns)))).alias("b")).first()["b"]
    return (size or 0) <= limit_bytes


def salted_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], spread: Sequence[str], buckets: int, how: str = "left"
) -> DataFrame:
    """Equi-join on ``keys`` with each key split over ``buckets`` tasks.

    ``dim`` is copied once per bucket, so it should be the small side; the copies are
    never broadcast. ``spread`` names fact columns that vary within a key.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_salted_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    options: ScanOptions,
    how: str = "left",
    large: bool = False,
) -> DataFrame:
    """Join where only the keys that need it are spread over buckets; a ``large`` ``dim`` is never broadcast.

    Keys with at least ``hot_rows`` facts are found with one pre-aggregated
    count and written down; there are at most rows / hot_rows of them. Their
    facts are salted and only their ``dim`` rows are copied, so ``dim`` may be
    as large as its keys. ``facts`` is read twice and should be a stored table.
    """
    hot = materialise(
        facts.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= options.hot_rows).select(*keys), "hot"
    )
    if not fits_broadcast(hot, max(options.broadcast_limit_bytes, HOT_BYTES)):
        return salted_join(facts, dim, keys, spread, options.salt_buckets, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    buckets = options.salt_buckets
    # A null key meets nothing, so it may be anywhere.
    spare = reduce(or_, [F.col("_hot").isNotNull(), *(F.col(k).isNull() for k in keys)])
    salt = F.when(spare, F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    salted = facts.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_hot")
    copied = dim.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied.hint("merge") if large else copied, [*keys, "_salt"], how).drop("_salt")


def attach(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    options: ScanOptions,
    how: str = "left",
    stored: bool = False,
) -> DataFrame:
    """Join ``dim`` (unique on ``keys``) to ``facts``: broadcast if measured small, else salted.

    Of ``stored`` facts, tables that may be read twice, only the hot keys are
    salted, so that what is exchanged of ``dim`` is little more than itself.
    """
    if fits_broadcast(dim, options.broadcast_limit_bytes):
        return facts.join(F.broadcast(dim), list(keys), how)
    if stored:
        return hot_salted_join(facts, dim, keys, spread, options, how, large=True)
    return salted_join(facts, dim, keys, spread, options.salt_buckets, how)


SMALL_INPUT_BYTES = 256 * 1024 * 1024


def spread_small_input(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give every core work when a small input arrives in a few splits.

    A single small file is one split whatever the split size. Inputs that the
    planner takes for larger than ``SMALL_INPUT_BYTES`` are returned as they
    are, however many cores there are: their content is never shuffled just to
    be scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SMALL_INPUT_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *by) if by else df.repartition(cores)
