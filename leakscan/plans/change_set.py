"""Scanning one or many change sets, as a commit gate does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.operators.allowlist import apply_allowlist
from leakscan.operators.history import SCANNABLE_STATUSES
from leakscan.operators.scan import CustomRule, scan_files
from leakscan.options import ScanOptions


def scan_change_set(
    changed: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
    allowlist: DataFrame | None = None,
) -> DataFrame:
    """Findings of ``changed(repo, path, status, content)``.

    Deleted and unmerged paths bring no content to judge. Allowlisted paths are
    left out before their content is looked at.
    """
    files = changed.where(F.col("status").isin(*SCANNABLE_STATUSES)).select("repo", "path", "content")
    if allowlist is not None:
        files = apply_allowlist(files, allowlist, options)
    return scan_files(files, options, rules, secrets)


def gate_decision(change_sets: DataFrame, findings: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Per change set: finding count, whether it is blocked, and the exit status."""
    counts = findings.groupBy(*keys).agg(F.count("*").alias("findings"))
    return decide_by_count(change_sets.select(*keys).distinct().join(counts, list(keys), "left"), keys)


def decide_by_count(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The decision for rows of ``keys, findings``; a null count is none."""
    total = F.coalesce("findings", F.lit(0)).cast("bigint")
    return counts.select(
        *keys, total.alias("findings"), (total > 0).alias("blocked"), F.when(total > 0, 1).otherwise(0).alias("exit_code")
    )
