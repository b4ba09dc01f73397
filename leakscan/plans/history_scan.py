"""Scanning a repository's history: every version of every file, once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions import paths
from leakscan.functions.rules import DOTENV_ORD, ENTROPY_ORD, GENERIC_ORD
from leakscan.functions.text import decode_blob
from leakscan.operators import history, report
from leakscan.operators.allowlist import flag_allowlisted
from leakscan.operators.lookup import fits_broadcast, hot_salted_join
from leakscan.operators.scan import GENERIC_CODE_ORD, HITS, CustomRule, name_rules, text_hits
from leakscan.operators.xref import xref_lines
from leakscan.options import ScanOptions
from leakscan.sources.workspace import materialise

FINDING = ["repo", "path", "line", "rule_id", "description", "rule_ord", "blob", "commit_sha", "commit_index", "commit_time"]


@dataclass(frozen=True)
class HistoryScan:
    """Tables of one history scan. ``versions`` has a status and hits per version.

    ``versions`` is written out once; findings and coverage only read it.
    ``rule_errors`` and ``shallow`` are what the caller knows of refused rules
    and cut-off histories, so that ``caveats`` is complete without more input.
    """

    commits: DataFrame
    versions: DataFrame
    findings: DataFrame
    coverage: DataFrame
    rule_errors: DataFrame | None = None
    shallow: DataFrame | None = None

    @property
    def caveats(self) -> DataFrame:
        """``repo, caveat, n`` for everything that was not scanned."""
        return report.caveats(self.coverage, self.rule_errors, self.shallow)

    @property
    def oversized(self) -> DataFrame:
        """Every version left out for its size, in walk order per repository."""
        return report.top_oversized(self.versions)


def blob_hits(
    blobs: DataFrame,
    options: ScanOptions,
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
) -> DataFrame:
    """``repo, blob, line, rule_ord`` of every blob, whatever paths carry it.

    Blob content is read where it lies; what depends on the path (exemptions,
    code or not) is decided later, per version. Rule order -1 marks a blob
    whose content is missing.
    """
    if options.max_blob_bytes is not None:
        blobs = blobs.where(F.col("size") <= options.max_blob_bytes)
    units = blobs.select(
        "repo",
        "blob",
        F.when(F.col("content").isNotNull(), decode_blob(F.col("content"))).alias("content"),
        F.when(F.col("content").isNull(), -1).alias("_absent"),
    )
    keys = ["repo", "blob"]
    hits = text_hits(units, keys, options, rules=rules, both_verdicts=True, note=F.col("_absent"))
    if secrets is None:
        return hits
    return hits.unionByName(xref_lines(units, secrets, keys, options).withColumn("rule_ord", F.lit(DOTENV_ORD)))


def wanted_blobs(flagged: DataFrame, blobs: DataFrame, options: ScanOptions) -> DataFrame:
    """The rows of ``blobs`` that some version of ``flagged`` is to be scanned for.

    The keys are sent to every task when they measure small enough, so content
    stays where it lies; beyond that the content is joined to them.
    """
    keys = materialise(flagged.where(~F.col("allowlisted")).select("repo", "blob").distinct(), "wanted")
    small = fits_broadcast(keys, options.broadcast_limit_bytes)
    return blobs.join(F.broadcast(keys) if small else keys, ["repo", "blob"], "left_semi")


def _applies(hit: Column, heuristics: Column, code: Column) -> Column:
    order = hit.getField("ord")
    return (
        F.when(order == GENERIC_ORD, heuristics & ~code)
        .when(order == GENERIC_CODE_ORD, heuristics & code)
        .when(order == ENTROPY_ORD, heuristics)
        .otherwise(F.lit(True))
    )


def scan_versions(
    versions: DataFrame,
    blobs: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
    allowlist: DataFrame | None = None,
) -> DataFrame:
    """``versions`` with ``status``, blob ``size`` and the array of ``hits``.

    Which blobs a version needs is settled first: blobs that no version refers
    to, or only versions on allowlisted paths, are neither decoded nor scanned.
    Blob hits are written out once (they hold line numbers and rule orders, no
    text). Blobs with hits, and blobs that cannot be scanned, are joined back to
    the versions; a blob carried by very many paths is salted.
    """
    flagged = (
        materialise(flag_allowlisted(versions, allowlist, options), "flagged")
        if allowlist is not None
        else versions.withColumn("allowlisted", F.lit(False))
    )
    found = blob_hits(wanted_blobs(flagged, blobs, options), options, rules, secrets)
    # A blob's hits come from one text; its row is assembled here, not scanned again.
    per_blob = materialise(found, "hits").groupBy("repo", "blob").agg(
        F.collect_list(F.struct("line", F.col("rule_ord").alias("ord"))).alias("_hits")
    )
    per_blob = per_blob.select(
        "repo",
        "blob",
        F.when(F.exists("_hits", lambda h: h.getField("ord") == -1), "unavailable").alias("state"),
        F.lit(None).cast("bigint").alias("size"),
        F.filter("_hits", lambda h: h.getField("ord") >= 0).alias("_hits"),
    )
    exceptional = history.unscannable_blobs(versions, blobs, options).select(
        "repo", "blob", "state", F.col("size").cast("bigint").alias("size"), F.array().cast(HITS).alias("_hits")
    )
    joined = hot_salted_join(flagged, per_blob.unionByName(exceptional), ["repo", "blob"], ["path"], options)
    path = F.col("path")
    status = F.when(F.col("allowlisted"), "allowlisted").otherwise(F.coalesce("state", F.lit("scan")))
    heuristics = paths.heuristic_exempt(path, options.default_excludes).isNull() & ~paths.is_env_template(path)
    file_ord = paths.filename_rule_ord(path)
    none = F.array().cast(HITS)
    named = F.when(file_ord.isNotNull(), F.array(F.struct(F.lit(0).alias("line"), file_ord.alias("ord")))).otherwise(none)
    kept = F.coalesce(
        F.filter("_hits", lambda h: _applies(h, F.col("_heuristics"), F.col("_code"))), none
    )
    folded = F.transform(
        kept,
        lambda h: F.struct(
            h.getField("line").alias("line"),
            F.when(h.getField("ord") == GENERIC_CODE_ORD, GENERIC_ORD).otherwise(h.getField("ord")).alias("ord"),
        ),
    )
    return (
        joined.withColumns({"status": status, "_heuristics": heuristics, "_code": paths.is_code_file(path)})
        .withColumn("hits", F.when(F.col("status") == "scan", F.concat(named.cast(HITS), folded.cast(HITS))).otherwise(none))
        .drop("_hits", "_heuristics", "_code", "state", "allowlisted")
    )


def version_findings(scanned: DataFrame, rules: Sequence[CustomRule] = ()) -> DataFrame:
    """One row per finding, with the commit that introduced the version."""
    hits = scanned.withColumn("_hit", F.explode("hits")).withColumns(
        {"line": F.col("_hit.line"), "rule_ord": F.col("_hit.ord")}
    )
    return name_rules(hits, rules).select(*FINDING)


def history_coverage(commits: DataFrame, scanned: DataFrame) -> DataFrame:
    """Per repository: commits, versions by status, findings, commits with findings."""
    is_status = lambda s: F.count_if(F.col("status") == s).alias(s if s != "scan" else "scanned")
    # Commits are counted from one pre-aggregated row per commit, so a commit
    # that touches everything is not one task's problem.
    per_commit = scanned.groupBy("repo", "commit_index").agg(
        F.count("*").alias("versions"),
        *[is_status(s) for s in ("scan", "allowlisted", "oversized", "unavailable")],
        F.sum(F.size("hits")).alias("findings"),
    )
    totals = per_commit.groupBy("repo").agg(
        *[F.sum(c).alias(c) for c in ("versions", "scanned", "allowlisted", "oversized", "unavailable", "findings")],
        F.count_if(F.col("findings") > 0).alias("commits_with_findings"),
    )
    walked = commits.groupBy("repo").agg(F.count("*").alias("commits"))
    zero = [
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        for c in ("versions", "scanned", "allowlisted", "oversized", "unavailable", "findings", "commits_with_findings")
    ]
    return walked.join(totals, "repo", "left").select("repo", "commits", *zero)


def scan_history(
    changes: DataFrame,
    blobs: DataFrame,
    head_tree: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
    allowlist: DataFrame | None = None,
    use_allowlist: bool = True,
    commits: DataFrame | None = None,
    rule_errors: DataFrame | None = None,
    shallow: DataFrame | None = None,
) -> HistoryScan:
    """Scan every version in ``changes`` and say what was not scanned.

    ``use_allowlist=False`` audits the repository against its own wishes:
    neither its allowlist nor inline markers count. ``commits`` is the list of
    walked commits; commits without any change row are otherwise unknown.
    ``rule_errors`` (refused rules) and ``shallow(repo, shallow)`` are passed on
    into the caveats.
    """
    if not use_allowlist:
        allowlist, options = None, replace(options, ignore_inline_allow=True)
    walked = commits if commits is not None else changes.select("repo", "commit_index").distinct()
    versions = materialise(history.introduce_versions(changes), "versions")
    scanned = materialise(scan_versions(versions, blobs, options, rules, secrets, allowlist), "scanned")
    findings = history.flag_in_head(version_findings(scanned, rules), head_tree)
    return HistoryScan(walked, scanned, findings, history_coverage(walked, scanned), rule_errors, shallow)
