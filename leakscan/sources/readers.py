"""Reading what a scan needs into its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions import paths
from leakscan.functions.text import decode_blob
from leakscan.operators.history import SCANNABLE_STATUSES
from leakscan.sources.tree import list_tree, read_contents, resolve_root

# Allowlist files at the top of a repository, in reading order.
ALLOWLIST_FILES = (".leakscanignore", ".gitleaksignore")


def read_file_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """``files(repo, path, content)`` of every file under ``root``, decoded; dot files are included."""
    return read_contents(list_tree(spark, root), root).select(
        F.lit(repo).alias("repo"), "path", F.when(F.col("content").isNotNull(), decode_blob(F.col("content"))).alias("content")
    )


def changed_files(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """``repo, path, status, content`` of the changes worth scanning.

    ``changes(repo, path, status)`` without a row in ``contents(repo, path,
    content)`` keep a null content: their name still counts.
    """
    kept = changes.where(F.col("status").isin(*SCANNABLE_STATUSES))
    return kept.join(contents, ["repo", "path"], "left").select("repo", "path", "status", "content")


def select_dotenv_files(files: DataFrame, max_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """The env files of ``files(repo, path, length, content)`` whose values are cross-referenced.

    Only path and length decide, so content is read for the kept rows alone.
    Limits are opt-in; ``skipped_dotenv_files`` lists what they leave out.
    """
    kept = files.where(paths.is_dotenv_file(F.col("path")) & paths.is_searched_for_env(F.col("path")))
    return kept.where(_env_limit(max_bytes, max_depth).isNull())


def skipped_dotenv_files(files: DataFrame, max_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """``repo, caveat, n``: the env files that a limit leaves out, for the caveats of a report."""
    kept = files.where(paths.is_dotenv_file(F.col("path")) & paths.is_searched_for_env(F.col("path")))
    left = kept.withColumn("caveat", _env_limit(max_bytes, max_depth)).where(F.col("caveat").isNotNull())
    return left.groupBy("repo", "caveat").agg(F.count("*").alias("n"))


def _env_limit(max_bytes: int | None, max_depth: int | None) -> Column:
    """Which limit leaves an env file out; null for none."""
    reason = F.lit(None).cast("string")
    if max_bytes is not None:
        reason = F.when(F.col("length") > max_bytes, "env file too large").otherwise(reason)
    if max_depth is not None:
        depth = F.size(F.filter(F.split("path", "/", -1), lambda s: s != "")) - 1
        reason = F.when(depth > max_depth, "env file too deep").otherwise(reason)
    return reason


def read_dotenv_files(
    spark: SparkSession, root: str, repo: str, max_bytes: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """``repo, path, content`` of the env files under ``root``.

    Generated and vendored directories are not even listed.
    """
    listed = list_tree(spark, root, skip=paths.ENV_SKIP_DIRECTORIES)
    kept = select_dotenv_files(listed.withColumn("repo", F.lit(repo)), max_bytes, max_depth)
    return read_contents(kept, root).where(F.col("content").isNotNull()).select(
        F.lit(repo).alias("repo"), "path", decode_blob(F.col("content")).alias("content")
    )


def select_allowlist_texts(
    working: DataFrame, staged: DataFrame | None = None, names: tuple[str, ...] = ALLOWLIST_FILES
) -> DataFrame:
    """``repo, ord, text`` of the allowlist files among ``files(repo, path, content)``.

    A staged version takes precedence over the working copy.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))

    def pick(files: DataFrame, rank: int) -> DataFrame:
        named = files.where(F.col("path").isin(*names) & F.col("content").isNotNull())
        return named.select("repo", order.alias("ord"), F.lit(rank).alias("rank"), F.col("content").alias("text"))

    found = pick(working, 1)
    if staged is not None:
        found = found.unionByName(pick(staged, 0))
    best = found.groupBy("repo", "ord").agg(F.min_by("text", "rank").alias("text"))
    return best.where(F.col("text") != "").select("repo", F.col("ord").cast("int").alias("ord"), "text")


def read_rule_packs(spark: SparkSession, location: str) -> DataFrame:
    """``rule_packs(pack, text)``, one row per JSON file in or below a trusted folder.

    A pack is named by its path below the folder, so no two share a name. A
    folder that is missing raises.
    """
    root = resolve_root(spark, location).rstrip("/") + "/"
    raw = spark.read.text(location, wholetext=True, recursiveFileLookup=True).select("value", "_metadata.file_path")
    place = F.regexp_replace("file_path", "^file:/+", "file:///")
    return raw.select(F.replace(place, F.lit(root), F.lit("")).alias("pack"), F.col("value").alias("text"))
