"""Reports over findings. Locations and rule ids only, never a matched value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions.rules import built_in_catalogue

# Fixed value: how many oversized versions a short report lists.
OVERSIZED_SHOWN = 10


def coverage_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: files, files without content, findings, files with findings.

    Repositories without findings are listed too: a clean result must be
    distinguishable from one that was never scanned.
    """
    scanned = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.count_if(F.col("content").isNull()).alias("unavailable")
    )
    per_file = findings.groupBy("repo", "path").agg(F.count("*").alias("n"))
    found = per_file.groupBy("repo").agg(F.sum("n").alias("findings"), F.count("*").alias("files_with_findings"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("findings", "files_with_findings")]
    return scanned.join(found, "repo", "left").select("repo", "files", "unavailable", *zero)


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Per file: count, first line and the distinct rules (at most one per rule id)."""
    return findings.groupBy("repo", "path").agg(
        F.count("*").alias("findings"),
        F.min("line").alias("first_line"),
        F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"),
    )


def finding_lines(findings: DataFrame) -> DataFrame:
    """One report line per finding: ``[rule] description (line n | file)``."""
    place = F.when(F.col("line") > 0, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("file")
    text = F.concat(F.lit("["), "rule_id", F.lit("] "), "description", F.lit(" ("), place, F.lit(")"))
    return findings.select("repo", "path", "line", "rule_ord", text.alias("text"))


def findings_by_commit(findings: DataFrame) -> DataFrame:
    """Per commit: short id, UTC date, findings, files, and how many are still in HEAD."""
    per_file = findings.groupBy("repo", "commit_index", "commit_sha", "commit_time", "path").agg(
        F.count("*").alias("n"), F.count_if("in_head").alias("live")
    )
    return per_file.groupBy("repo", "commit_index", "commit_sha", "commit_time").agg(
        F.sum("n").alias("findings"), F.count("*").alias("files"), F.sum("live").alias("still_in_head")
    ).select(
        "repo",
        "commit_index",
        F.substring("commit_sha", 1, 12).alias("commit"),
        utc_date(F.col("commit_time")).alias("date"),
        "findings",
        "files",
        "still_in_head",
    )


def utc_date(time: Column) -> Column:
    """ISO date of a timestamp in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd")


def commit_lines(findings: DataFrame) -> DataFrame:
    """One history report line per finding under its commit."""
    place = F.when(F.col("line") > 0, F.concat("path", F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("path"))
    live = F.when(F.col("in_head"), "  (still in HEAD)").otherwise("")
    return findings.select(
        "repo",
        "commit_index",
        F.substring("commit_sha", 1, 12).alias("commit"),
        utc_date(F.col("commit_time")).alias("date"),
        "path",
        "line",
        "rule_ord",
        F.concat(place, F.lit("  ["), "rule_id", F.lit("] "), "description", live).alias("text"),
    )


def findings_by_rule(findings: DataFrame) -> DataFrame:
    """Count per rule id."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("findings"))


def findings_by_repo_rule(findings: DataFrame) -> DataFrame:
    """Counts per repository and rule with subtotals (null marks a total)."""
    return findings.rollup("repo", "rule_id").agg(F.count("*").alias("findings"))


def findings_by_layer(findings: DataFrame) -> DataFrame:
    """Count per rule layer; rules outside the built-in catalogue are 'custom'."""
    layers: dict[str, list[int]] = {}
    for order, _, _, layer in built_in_catalogue():
        layers.setdefault(layer, []).append(order)
    (first, orders), *rest = layers.items()
    layer = F.when(F.col("rule_ord").isin(*orders), first)
    for name, orders in rest:
        layer = layer.when(F.col("rule_ord").isin(*orders), name)
    return findings.groupBy(layer.otherwise("custom").alias("layer")).agg(F.count("*").alias("findings"))


def order_findings(findings: DataFrame) -> DataFrame:
    """History order: commit, file in locale order, line, then listing order."""
    return findings.orderBy("repo", "commit_index", F.collate("path", "UNICODE"), "line", "rule_ord", "path")


def top_oversized(scanned: DataFrame, shown: int | None = None) -> DataFrame:
    """The oversized versions per repository in walk order; with ``shown`` the first ones, and how many more."""
    large = scanned.where(F.col("status") == "oversized")
    first = Window.partitionBy("repo").orderBy("commit_index", "path", "blob")
    listed = large.withColumn("position", F.row_number().over(first))
    if shown is not None:
        listed = listed.where(F.col("position") <= shown)
    totals = large.groupBy("repo").agg(F.count("*").alias("total"))
    size = F.format_number(F.col("size") / (1024 * 1024), 1)
    label = F.concat("path", F.lit(" @ "), F.substring("commit_sha", 1, 12), F.lit(" ("), F.replace(size, F.lit(",")), F.lit(" MB)"))
    return listed.join(totals, "repo").select(
        "repo", "position", label.alias("label"), F.greatest(F.col("total") - (F.col("total") if shown is None else shown), F.lit(0)).cast("bigint").alias("more")
    )


def caveats(coverage: DataFrame, rule_errors: DataFrame | None = None, shallow: DataFrame | None = None) -> DataFrame:
    """``repo, caveat, n`` for everything that was not scanned, and nothing else."""
    listed = coverage.select(
        "repo",
        F.expr(
            "stack(3, 'allowlisted', allowlisted, 'oversized', oversized, 'unavailable', unavailable) AS (caveat, n)"
        ),
    ).where(F.col("n") > 0)
    if shallow is not None:
        listed = listed.unionByName(
            shallow.where("shallow").select("repo", F.lit("shallow").alias("caveat"), F.lit(1).cast("bigint").alias("n"))
        )
    if rule_errors is not None:
        invalid = rule_errors.agg(F.count("*").alias("n")).where(F.col("n") > 0)
        listed = listed.unionByName(invalid.select(F.lit(None).cast("string").alias("repo"), F.lit("invalid rules").alias("caveat"), "n"))
    return listed


def merge_findings(findings: DataFrame, *external: DataFrame) -> DataFrame:
    """Findings of other scanners appended as they are (no de-duplication)."""
    columns: Sequence[str] = findings.columns
    for other in external:
        findings = findings.unionByName(other.select(*[c for c in columns if c in other.columns]), allowMissingColumns=True)
    return findings
