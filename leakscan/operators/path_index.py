"""Allowlists of any size: which entries a path could match at all, by literals that they require.

An entry that is a literal matches paths that contain it; most regular
expressions too have a run of characters that each of their matches holds. So a
path meets only the entries whose literal it contains. Up to a measured size the
literals of all repositories are sent to the tasks, as automata that are built
once per worker and read a path once, however many entries there are. Beyond it,
paths and entries meet in joins over trigrams, each entry by its rarest one.
Entries without a literal of three characters are tried on all paths of their
repository, a bounded number at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.operators.lookup import attach, fits_broadcast
from leakscan.operators.membership import build_filters
from leakscan.options import ScanOptions
from leakscan.sources.workspace import materialise

GRAM = 3
_REPEATS = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")


def _runs(tree: parser.SubPattern) -> Iterator[str]:
    """Runs of characters that every match of a sequence holds."""
    run = ""
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # without width
            continue
        inner = ()
        if name in _REPEATS and value[0] >= 1:
            inner = value[2]
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            inner = value[3]
        if name in _REPEATS and len(inner) == 1 and str(inner[0][0]) == "LITERAL":
            run, inner = run + chr(inner[0][1]), ()
        yield run
        run = ""
        if len(inner):
            yield from _runs(inner)
    yield run


def required_literal(matcher: str, is_regex: bool) -> str | None:
    """The longest run of characters that every path an entry matches holds; null if none of ``GRAM`` characters is sure."""
    if not is_regex:
        return matcher if len(matcher) >= GRAM else None
    spelled = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", matcher).replace("\\z", "\\Z")
    try:
        tree = parser.parse(spelled)
    except (re.error, ValueError, OverflowError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    longest = max(_runs(tree), key=len)
    return longest if len(longest) >= GRAM else None


def with_literals(entries: DataFrame) -> DataFrame:
    """``repo, is_regex, matcher, literal`` of every distinct entry."""

    @F.pandas_udf("string")
    def literal(matchers: pd.Series, regexes: pd.Series) -> pd.Series:
        return pd.Series([required_literal(m, r) for m, r in zip(matchers, regexes, strict=True)], dtype=object)

    distinct = entries.select("repo", "is_regex", "matcher").distinct()
    return distinct.withColumn("literal", literal("matcher", "is_regex"))


def _holds(path: Column, matcher: Column, is_regex: Column) -> Column:
    return F.when(is_regex, F.rlike(path, matcher)).otherwise(F.contains(path, matcher))


def flag_by_automata(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows(repo, path, …)`` with ``allowlisted``; entries of a measured size are sent to all tasks. A map over the rows."""
    listed = [tuple(r) for r in with_literals(entries.where("repo IS NOT NULL")).select("repo", "matcher", "is_regex", "literal").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(listed)
    built: dict = {}

    def index() -> dict:
        if not built:
            for repo, matcher, is_regex, literal in shared.value:
                automaton, always = built.setdefault(repo, (ahocorasick.Automaton(), []))
                if literal is None:
                    always.append((matcher, is_regex))
                else:
                    automaton.get(literal, None) or automaton.add_word(literal, [])
                    automaton.get(literal).append((matcher, is_regex))
            for automaton, _ in built.values():
                automaton.make_automaton()
        return built

    @F.pandas_udf("array<struct<matcher:string,is_regex:boolean>>")
    def possible(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = index()
        for repos, paths in batches:
            out = []
            for repo, path in zip(repos, paths, strict=True):
                automaton, always = known.get(repo, (None, ()))
                found = set(always)
                if path and automaton:
                    for _, those in automaton.iter(path):
                        found.update(those)
                out.append([{"matcher": m, "is_regex": r} for m, r in found])
            yield pd.Series(out, dtype=object)

    matched = F.exists(possible("repo", "path"), lambda m: _holds(F.col("path"), m["matcher"], m["is_regex"]))
    return rows.withColumn("allowlisted", F.coalesce(matched, F.lit(False)))


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda k: F.substring(text, k, F.lit(GRAM))))


def flag_by_joins(rows: DataFrame, entries: DataFrame, options: ScanOptions = ScanOptions(), at_once: int = 200) -> DataFrame:
    """``rows(repo, path, …)`` with ``allowlisted``, for entries of any size: paths and entries meet by trigram."""
    known = materialise(with_literals(entries).where("repo IS NOT NULL").withColumn("entry", F.monotonically_increasing_id()), "entries")
    paths = materialise(rows.select("repo", "path").where("repo IS NOT NULL AND path IS NOT NULL").distinct(), "paths")
    own = known.where("literal IS NOT NULL").select("entry", "repo", F.explode(_grams(F.col("literal"))).alias("gram"))
    own = own.withColumn("hash", F.xxhash64("repo", "gram"))
    filters = build_filters(own.select(F.lit(0).alias("kind"), "hash").distinct(), {0: own.select("hash").distinct().count()})
    held = paths.where(F.length("path") >= GRAM).select("repo", "path", F.explode(_grams(F.col("path"))).alias("gram"))
    if filters:
        shared = rows.sparkSession.sparkContext.broadcast(filters[0])

        @F.pandas_udf("boolean")
        def may_hold(hashes: pd.Series) -> pd.Series:
            return pd.Series(shared.value.may_hold(hashes.to_numpy().view("uint64")))

        held = held.where(may_hold(F.xxhash64("repo", "gram")))
    held = materialise(held, "grams")
    # An entry is looked up by the trigram that the fewest paths have; one that no path has can't match.
    counts = held.groupBy("repo", "gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, ["repo", "gram"], "left").groupBy("entry").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    sought = known.join(rarest.where("least.n > 0"), "entry").select("repo", F.col("least.gram").alias("gram"), "matcher", "is_regex", "literal")
    # Entries of one trigram stay apart, so that many of them are no single row.
    sought = sought.withColumn("part", F.pmod(F.xxhash64("matcher"), F.lit(1 << 20)))
    listed = sought.groupBy("repo", "gram", F.expr(f"part div {(1 << 20) // options.salt_buckets}")).agg(F.collect_list(F.struct("literal", "matcher", "is_regex")).alias("those"))
    pairs = attach(held, listed, ["repo", "gram"], ["path"], options, "inner", stored=True)
    path = F.col("path")
    hits = pairs.where(F.exists("those", lambda e: F.contains(path, e["literal"]) & _holds(path, e["matcher"], e["is_regex"]))).select("repo", "path")
    rest = known.where("literal IS NULL").withColumn("part", F.expr(f"cast(entry % 1000000007 as bigint) div {at_once}"))
    rest = rest.groupBy("repo", "part").agg(F.collect_list(F.struct("matcher", "is_regex")).alias("those"))
    tried = attach(paths, rest, ["repo"], ["path"], options, "inner", stored=True)
    hits = hits.unionByName(tried.where(F.exists("those", lambda e: _holds(path, e["matcher"], e["is_regex"]))).select("repo", "path")).distinct()
    flagged = materialise(hits.withColumn("allowlisted", F.lit(True)), "hits")
    # Salting by path would part no rows of one key.
    flagged = F.broadcast(flagged) if fits_broadcast(flagged, options.broadcast_limit_bytes) else flagged.hint("merge")
    return rows.join(flagged, ["repo", "path"], "left").withColumn("allowlisted", F.coalesce("allowlisted", F.lit(False)))
