"""Path allowlists: parsing entries and leaving out the paths they match."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.functions.dialect import WS, to_java_pattern, trim_ws, utf16_length
from leakscan.functions.text import split_lines
from leakscan.operators.lookup import attach, fits_broadcast
from leakscan.operators.path_index import flag_by_automata, flag_by_joins
from leakscan.options import ScanOptions

# Longest pattern that is run, and the nested-repeat shape that
# backtracks without end.
MAX_PATTERN = 200
NESTED_REPEAT = rf"\([^)]*[+*][^)]*\)[{WS}]*(?:[+*]|\{{[0-9]+,[{WS}]*\}})"

# A reference to a group, or a group with a name.
_REFERS = r"\\[1-9k]|\(\?<[A-Za-z]"


def is_risky_pattern(pattern: Column) -> Column:
    return (utf16_length(pattern) > MAX_PATTERN) | F.rlike(pattern, F.lit(NESTED_REPEAT))


@F.pandas_udf(T.StringType())
def _java_spelling(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Java spelling of each pattern, null where it does not compile."""

    def spell(pattern: str | None) -> str | None:
        try:
            return None if pattern is None else to_java_pattern(pattern)
        except ValueError:
            return None

    for series in patterns:
        yield series.map(spell)


def parse_allowlist(texts: DataFrame) -> DataFrame:
    """``repo, ord, pattern, is_regex, matcher`` for every entry of
    ``texts(repo, ord, text)``.

    Entries that are risky or do not compile stay in force as plain substrings
    of the path, so a bad entry can never hide more than it spells out.
    """
    lines = texts.select("repo", F.col("ord").alias("file_ord"), F.posexplode(split_lines(F.col("text"))).alias("n", "line"))
    entries = lines.select("repo", "file_ord", "n", trim_ws(F.col("line")).alias("pattern")).where(
        (F.col("pattern") != "") & ~F.startswith(F.col("pattern"), F.lit("#"))
    )
    spelled = entries.withColumn(
        "_java", _java_spelling(F.when(~is_risky_pattern(F.col("pattern")), F.col("pattern")))
    )
    return spelled.select(
        "repo",
        (F.col("file_ord") * 1_000_000 + F.col("n")).cast("bigint").alias("ord"),
        "pattern",
        F.col("_java").isNotNull().alias("is_regex"),
        F.coalesce("_java", "pattern").alias("matcher"),
    )


def matchers_by_repo(entries: DataFrame) -> DataFrame:
    """One row per repository with its distinct matchers, for lists of a bounded size.

    Its regular expressions become one alternation, which the engine compiles
    once for a run of rows of the repository. Those with groups that are
    referred to or named stay apart, as joining would renumber them.
    """
    kind = (
        F.when(~F.col("is_regex"), "literal")
        .when(F.rlike("matcher", F.lit(_REFERS)), "apart")
        .otherwise("joined")
    )
    sets = [F.sort_array(F.collect_set(F.when(kind == k, F.col("matcher")))).alias(k) for k in ("literal", "apart", "joined")]
    lists = entries.groupBy("repo").agg(*sets)
    joined = F.when(F.size("joined") > 0, F.array_join(F.transform("joined", lambda m: F.concat(F.lit("(?:"), m, F.lit(")"))), "|"))
    return lists.select("repo", F.struct("literal", "apart", joined.alias("joined")).alias("_allow"))


def path_allowlisted(path: Column, matchers: Column) -> Column:
    """Whether any matcher of a repository's list applies; false for a missing list."""
    by_literal = F.exists(matchers.getField("literal"), lambda m: F.contains(path, m))
    by_joined = F.coalesce(F.rlike(path, matchers.getField("joined")), F.lit(False))
    by_apart = F.exists(matchers.getField("apart"), lambda m: F.rlike(path, m))
    return F.coalesce(by_literal | by_joined | by_apart, F.lit(False))


def flag_allowlisted(rows: DataFrame, entries: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``rows(repo, path, …)`` with a boolean ``allowlisted``.

    Lists of up to ``joined_entries`` entries are one alternation for each
    repository; longer ones are looked up by the literals they require, and
    those beyond the broadcast limit in joins, which a stream cannot.
    """
    most = entries.groupBy("repo").count().agg(F.max("count")).first()[0] or 0
    if most <= options.joined_entries:
        joined = attach(rows, matchers_by_repo(entries), ["repo"], ["path"], options)
        return joined.withColumn("allowlisted", path_allowlisted(F.col("path"), F.col("_allow"))).drop("_allow")
    if fits_broadcast(entries, options.broadcast_limit_bytes):
        return flag_by_automata(rows, entries)
    return flag_by_joins(rows, entries, options)


def apply_allowlist(rows: DataFrame, entries: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``rows`` whose path no entry of the repository matches."""
    return flag_allowlisted(rows, entries, options).where(~F.col("allowlisted")).drop("allowlisted")
