"""Cross-reference of file content against the values held in env files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from leakscan.functions.dotenv import WORD, is_dotenv_secret, parse_assignment
from leakscan.functions.text import split_lines
from leakscan.operators.anchors import anchor_places, anchored, build_filter, gram_bytes
from leakscan.operators.lookup import attach
from leakscan.options import ScanOptions


def dotenv_assignments(env_files: DataFrame) -> DataFrame:
    """``repo, path, line, key, value`` of every assignment in ``env_files``."""
    lines = env_files.select("repo", "path", F.posexplode(split_lines(F.col("content"))).alias("n", "text"))
    parsed = lines.select("repo", "path", (F.col("n") + 1).alias("line"), parse_assignment(F.col("text")).alias("a"))
    return parsed.where(F.col("a").isNotNull()).select("repo", "path", "line", "a.key", "a.value")


def dotenv_secrets(env_files: DataFrame) -> DataFrame:
    """``repo, ord, value``: distinct secret values per repository.

    Values are held for matching only. They must not be written to a sink.
    Order is by file depth, path and line; the first one listed is reported.
    """
    found = dotenv_assignments(env_files).where(is_dotenv_secret(F.col("key"), F.col("value")))
    place = F.concat(
        F.lpad(F.size(F.split("path", "/")).cast("string"), 3, "0"),
        F.lit("/"),
        F.col("path"),
        F.lit("\x00"),
        F.lpad(F.col("line").cast("string"), 10, "0"),
    )
    return found.groupBy("repo", "value").agg(F.min(place).alias("ord"))


def _standing(places: DataFrame) -> DataFrame:
    """``places`` with before and size of a value: the text that would be it, where it is no part of a longer word."""
    start = F.col("at") - F.col("before")
    byte = lambda at: F.rlike(F.substring("around", at, F.lit(1)).cast("string"), F.lit(f"^[{WORD}]$"))
    inner = (start > 0) & byte(start) & byte(start + 1)
    behind = start + F.col("size")
    inner = inner | (behind < F.octet_length("around")) & byte(behind) & byte(behind + 1)
    whole = places.where((start >= 0) & (behind <= F.octet_length("around"))).where(~inner)
    ahead = F.substring("around", F.lit(1), start).cast("string")
    return whole.withColumns({
        "line": F.col("line") + F.regexp_count(ahead, F.lit("\n")),
        "value": F.substring("around", start + 1, F.col("size")).cast("string"),
    })


def xref_matches(units: DataFrame, secrets: DataFrame, keys: Sequence[str], options: ScanOptions) -> DataFrame:
    """``keys, ord, line`` of every place in a unit where a secret value of its repository stands.

    One way for value sets of any size, batch and stream (``anchors``). Places
    of anchors meet the sizes of the values they may stand for, then the values
    themselves, both by equality; values that share an anchor are never
    paired with all its places. A stream knows the values that there were when
    it began. Rows without a repository and empty values match nothing.
    """
    secrets = secrets.where("repo IS NOT NULL AND value <> ''")
    gram = gram_bytes(secrets)
    known = anchored(secrets, gram)
    places = anchor_places(units, keys, build_filter(known, gram)).where("repo IS NOT NULL")
    spread = [*(k for k in keys if k != "repo"), "at", "line"]
    # Anchors stand for values of a few sizes each; what lies there is then looked up as a whole.
    sizes = known.groupBy("repo", "hash").agg(F.collect_set(F.struct("before", "size")).alias("sizes"))
    sized = attach(places, sizes, ["repo", "hash"], spread, options, "inner")
    read = _standing(sized.select("*", F.inline("sizes")))
    return attach(read, secrets.select("repo", "value", "ord"), ["repo", "value"], spread, options, "inner").select(*keys, "ord", "line")


def xref_lines(units: DataFrame, secrets: DataFrame, keys: Sequence[str], options: ScanOptions) -> DataFrame:
    """``keys, line`` of each unit that holds a secret value of its repository.

    The earliest listed secret that stands in a unit decides its line. Units
    with the same keys count as one, of a stream: in one batch.
    """
    met = xref_matches(units, secrets, keys, options)
    if not met.isStreaming:
        return met.groupBy(*keys).agg(F.min(F.struct("ord", "line")).alias("m")).select(*keys, F.col("m.line").alias("line"))
    # Rows of one unit arrive together: each group is whole within its batch, and nothing is kept of it.
    schema = met.select(*keys, "line").schema

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        best = rows.sort_values(["ord", "line"], kind="stable").iloc[0]
        yield pd.DataFrame([[*key, best["line"]]], columns=schema.names).astype({"line": "int32"})

    return met.groupBy(*keys).applyInPandasWithState(first, schema, "none int", "append", "NoTimeout")


def dotenv_coverage(env_files: DataFrame, shown: int | None = None) -> DataFrame:
    """What the cross-reference can see per repository: files (with ``shown`` the first names only) and value counts."""
    files = env_files.select("repo", "path").distinct()
    counts = files.groupBy("repo").agg(F.count("*").alias("file_count"))
    # With a limit only the first few names are kept, already before the shuffle.
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    named = files if shown is None else files.withColumn("_n", rank).where(F.col("_n") <= shown)
    names = named.groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("files"))
    values = dotenv_secrets(env_files).groupBy("repo").agg(F.count("*").alias("secret_count"))
    return (
        counts.join(names, "repo")
        .join(values, "repo", "left")
        .select(
            "repo",
            "files",
            "file_count",
            F.coalesce("secret_count", F.lit(0)).cast("bigint").alias("secret_count"),
            F.when(F.col("secret_count") > 0, "PASS").otherwise("WARN").alias("status"),
        )
    )
