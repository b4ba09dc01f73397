"""File versions: which commit introduced them, and what a scan may read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.operators.lookup import hot_salted_join
from leakscan.options import ScanOptions

# File modes with content (regular, executable, symlink), the
# statuses a change set is scanned for, and the null blob.
SCANNABLE_MODES = ("100644", "100755", "120000")
SCANNABLE_STATUSES = ("A", "C", "M", "R", "T")
NULL_BLOB = "0" * 40

VERSION = ["repo", "blob", "path"]


def introduce_versions(changes: DataFrame) -> DataFrame:
    """One row per (repo, blob, path) with the change that introduced it.

    First means first in walk order, never by clock. The aggregate combines
    before the shuffle, so a version touched by every commit costs one row per
    input split.
    """
    kept = changes.where(
        (F.col("status") != "D") & (F.col("blob") != NULL_BLOB) & F.col("new_mode").isin(*SCANNABLE_MODES)
    )
    first = F.min(F.struct("commit_index", "seq", "commit_sha", "commit_time")).alias("c")
    # Rows are sorted for this aggregate: a hash in front settles almost all comparisons, the strings begin alike.
    return kept.groupBy(F.xxhash64(*VERSION), *VERSION).agg(first).select(*VERSION, "c.commit_index", "c.commit_sha", "c.commit_time")


def distinct_blobs(versions: DataFrame) -> DataFrame:
    """``repo, blob, paths``: each content once, with how many paths carry it."""
    return versions.groupBy("repo", "blob").agg(F.count("*").alias("paths"))


def unscannable_blobs(versions: DataFrame, blobs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``repo, blob, state, size`` for referenced blobs that are missing, or too large for a wanted limit.

    Only blob sizes are read, and only the exceptions come out.
    """
    sizes = blobs.select("repo", "blob", "size")
    state = F.when(F.col("size").isNull(), "unavailable")
    if options.max_blob_bytes is not None:
        state = state.when(F.col("size") > options.max_blob_bytes, "oversized")
    return (
        distinct_blobs(versions)
        .join(sizes, ["repo", "blob"], "left")
        .withColumn("state", state)
        .where(F.col("state").isNotNull())
        .select("repo", "blob", "state", "size")
    )


def classify_versions(
    versions: DataFrame, blobs: DataFrame, allowlist: DataFrame | None = None, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """``versions`` with ``status``: allowlisted, unavailable, oversized or scan.

    A version is counted once, in that order of precedence. A blob carried by
    a third of all paths is spread over salt buckets; the joined side holds
    only the exceptional blobs. ``versions`` should be a stored table.
    """
    from leakscan.operators.allowlist import flag_allowlisted

    flagged = (
        flag_allowlisted(versions, allowlist, options)
        if allowlist is not None
        else versions.withColumn("allowlisted", F.lit(False))
    )
    exceptions = unscannable_blobs(versions, blobs, options)
    joined = hot_salted_join(flagged, exceptions, ["repo", "blob"], ["path"], options)
    status = F.when(F.col("allowlisted"), "allowlisted").otherwise(F.coalesce("state", F.lit("scan")))
    return joined.withColumn("status", status).drop("state", "allowlisted")


def fetch_contents(classified: DataFrame, blobs: DataFrame) -> DataFrame:
    """``repo, blob, content, state`` once per blob that has a version to scan.

    ``state`` is 'scan', or 'unavailable' when the content is missing after all.
    """
    wanted = classified.where(F.col("status") == "scan").groupBy("repo", "blob").agg(F.count("*").alias("paths"))
    return wanted.join(blobs.select("repo", "blob", "content"), ["repo", "blob"], "left").withColumn(
        "state", F.when(F.col("content").isNull(), "unavailable").otherwise("scan")
    )


def flag_in_head(findings: DataFrame, head_tree: DataFrame) -> DataFrame:
    """``findings`` with ``in_head``: whether that version is in the current tree."""
    present = head_tree.select(*VERSION).distinct().withColumn("_present", F.lit(True))
    return findings.join(present, VERSION, "left").withColumn("in_head", F.col("_present").isNotNull()).drop("_present")
