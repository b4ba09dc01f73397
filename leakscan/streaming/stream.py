"""The same scans over arriving change sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from leakscan.operators.allowlist import apply_allowlist
from leakscan.operators.history import NULL_BLOB, SCANNABLE_MODES, SCANNABLE_STATUSES, VERSION
from leakscan.operators.scan import CustomRule, scan_files
from leakscan.options import ScanOptions
from leakscan.operators.xref import xref_matches
from leakscan.plans.change_set import decide_by_count


def stream_scan(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
) -> DataFrame:
    """Findings of each arriving ``files(repo, path, content)`` row; append, nothing is kept from batch to batch.

    ``secrets`` may be of any size; those known when the stream begins count.
    """
    return scan_files(files, options, rules, secrets)


def _introducing(changes: DataFrame) -> DataFrame:
    """The changes that bring a version: no deletions, no null blobs, only modes with content."""
    return changes.where(
        (F.col("status") != "D") & (F.col("blob") != NULL_BLOB) & F.col("new_mode").isin(*SCANNABLE_MODES)
    )


def first_seen(changes: DataFrame, delay: str, arrival: str = "arrived") -> DataFrame:
    """Each introduced (repo, blob, path) once within ``delay`` of its arrival.

    Time is when a row arrives, put into the column ``arrival``: clocks of
    commits are not to be trusted, and a late one would be dropped. State is
    kept for the delay; a version that returns after it is listed again.
    """
    arriving = _introducing(changes).select(*VERSION, F.current_timestamp().alias(arrival))
    return arriving.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(VERSION)


def introduced_so_far(changes: DataFrame) -> DataFrame:
    """The earliest known introduction per version, for update mode.

    Arrival order is not ancestry, so a later batch may still lower the index.
    State grows with the versions of the repositories, as the answer does.
    """
    kept = _introducing(changes)
    return kept.groupBy(*VERSION).agg(F.min("commit_index").alias("commit_index"))


def stream_gate(
    changes: DataFrame,
    decide: Callable[[DataFrame, int], None],
    key: str = "change_set",
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
    allowlist: DataFrame | None = None,
    keep_ms: int | None = None,
) -> DataStreamWriter:
    """Judge every change set of ``changes(<key>, repo, path, status, content)`` as it arrives.

    ``decide`` receives one row per change set of the batch (finding count,
    blocked, exit status). ``secrets`` and ``allowlist`` are per repository, as
    in a scan. A change set may arrive over several batches: the count of what
    it has brought so far is kept as its state, so the last decision of a change
    set is the one that holds and no later one is milder. A batch costs what it
    brings, however many came before it. State is versioned by batch in the
    query's checkpoint: a batch that is run again, after a restart too, starts
    from the same counts and decides the same. A change set that has brought
    nothing for ``keep_ms`` is forgotten; without a time it is kept. A change set
    without a name is judged too.
    """
    counted = _count_by_change_set(changes, key, options, rules, secrets, allowlist)
    kind = changes.schema[key].dataType.simpleString()

    def add(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, holders = state.get[0] if state.exists else 0, set()
        for rows in parts:
            total += int(rows["findings"].sum())
            holders.update(rows["holder"].dropna())
        total += len(holders)
        state.update((total,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"name": list(name), "findings": [total]})

    timeout = "NoTimeout" if keep_ms is None else "ProcessingTimeTimeout"
    totals = counted.groupBy("name").applyInPandasWithState(add, f"name {kind}, findings long", "findings long", "append", timeout)
    return decide_by_count(totals.withColumnRenamed("name", key), [key]).writeStream.foreachBatch(decide)


def _count_by_change_set(
    changes: DataFrame,
    key: str,
    options: ScanOptions,
    rules: Sequence[CustomRule],
    secrets: DataFrame | None,
    allowlist: DataFrame | None,
) -> DataFrame:
    """``name, holder, findings``: rows whose findings, and distinct holders, add up to the findings of each change set.

    One without findings has a row too. A holder is a file with an env value,
    which is one finding however many places and values there are.

    Two change sets may touch the same path, so the pair of change set and
    repository stands for the repository while files are scanned. Allowlists
    are applied before. Rows are added up where they are found, before they
    are exchanged.
    """
    kind = changes.schema[key].dataType.simpleString()
    pair = F.to_json(F.struct(F.col(key).alias("k"), F.col("repo").alias("r")), {"ignoreNullFields": "false"})
    files = changes.where(F.col("status").isin(*SCANNABLE_STATUSES))
    if allowlist is not None:
        files = apply_allowlist(files, allowlist, options)
    files = files.select(pair.alias("pair"), "repo", "path", "content")
    found = scan_files(files.select(F.col("pair").alias("repo"), "path", "content"), options, rules).select(F.col("repo").alias("pair"))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = changes.select(F.col(key).alias("name"), F.lit(None).cast("string").alias("holder"), none.alias("findings"))
    name = F.from_json("pair", f"k {kind}")["k"].alias("name")
    rows = rows.unionByName(found.select(name, F.lit(None).cast("string").alias("holder"), one.alias("findings")))
    if secrets is not None:
        held = xref_matches(files, secrets, ["pair", "repo", "path"], options)
        rows = rows.unionByName(held.select(name, F.to_json(F.struct("repo", "path")).alias("holder"), none.alias("findings")))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = pa.Table.from_batches([batch]).group_by(["name", "holder"]).aggregate([("findings", "sum")])
            yield from added.select(["name", "holder", "findings_sum"]).rename_columns(["name", "holder", "findings"]).combine_chunks().to_batches()

    return rows.mapInArrow(add_up, f"name {kind}, holder string, findings long")
