"""Writing findings. Only a fixed set of columns ever leaves a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

REPORT_COLUMNS = (
    "repo", "path", "line", "rule_id", "description", "rule_ord",
    "commit_sha", "commit_index", "commit_time", "in_head",
)


def report_columns(findings: DataFrame) -> DataFrame:
    """Locations, rules and commits; any other column is dropped."""
    return findings.select(*[c for c in REPORT_COLUMNS if c in findings.columns])


def write_findings(findings: DataFrame, location: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a report as parquet, json, csv or orc, partitioned by repository."""
    report_columns(findings).write.format(fmt).mode(mode).partitionBy("repo").save(location)
