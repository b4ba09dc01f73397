"""Raw history logs: NUL-separated commit headers and change records, cut into parts anywhere.

A log is a row of tokens. A token that begins with ``\\x01`` is a commit header,
one that begins with ``:`` a change record, whose path is the next token,
whatever that holds. So what a token is depends on those before it: it is a path
if an odd number of tokens with a colon stand right before it, in a row. Behind
any other token the count begins anew, and a part that has one can be read from
there without the parts before.

Every part is read by itself: what lies behind its first token without a colon
becomes records at once. What lies before it stays loose, a few tokens. One small row
per part says how it begins and ends: open token, colons in a row, headers.
Such rows are put together in order of the parts by running sums, which tell the
loose tokens apart and number the commits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.operators.lookup import attach
from leakscan.options import ScanOptions
from leakscan.sources.workspace import STORED_CODEC, materialise

_EPOCH = re.compile("[0-9]{1,18}")
_EVENT = [("seq", pa.int64()), ("local", pa.int64()), ("sha", pa.string()), ("epoch", pa.int64())]
_EVENT += [(name, pa.string()) for name in ("new_mode", "blob", "status", "path")]
_PART = [("head", pa.string()), ("tail", pa.string()), ("loose", pa.list_(pa.string())), ("tokens", pa.int64()), ("synced", pa.bool_()), ("trail", pa.int64())]
_PART += [("last_token", pa.string()), ("headers", pa.int64()), ("first_sha", pa.string())]
_SCHEMA = pa.schema([("repo", pa.string()), ("part", pa.int64()), *_EVENT, *_PART])
_DDL = (
    "repo string, part long, seq long, local long, sha string, epoch long, new_mode string, blob string, status string, path string, "
    "head string, tail string, loose array<string>, tokens long, synced boolean, trail long, last_token string, headers long, first_sha string"
)


def _header(entry: str) -> tuple[str, int | None]:
    words = entry[1:].split(" ")
    time = words[1].strip(" ") if len(words) > 1 else ""
    return words[0], int(time) if _EPOCH.fullmatch(time) else None


def _meta(entry: str) -> tuple[str | None, str | None, str | None]:
    """New mode, blob and status of a record's token."""
    words = entry[1:].split(" ")
    return tuple(words[k] if len(words) > k else None for k in (1, 3, 4))


def read_part(log: str) -> tuple[list[tuple], tuple]:
    """Events (seq, local, sha, epoch, new_mode, blob, status, path) of one part, and what it says of itself.

    ``local`` numbers the commits of the part's own headers; it is -1 before
    the first of them. A header comes out once for each commit, without a path.
    """
    pieces = log.split("\0")
    last = len(pieces) - 2  # of the tokens that end here; the first one begins further up
    begin = next((k for k in range(1, last + 1) if not pieces[k].lstrip("\n").startswith(":")), None)
    events, local, commit, first = [], -1, (None, None), None
    k = last + 1 if begin is None else begin + 1
    while k <= last:
        entry = pieces[k].lstrip("\n")
        if entry.startswith("\x01"):
            found = _header(entry)
            if local < 0 or found[0] != commit[0]:
                local, commit, first = local + 1, found, first if local >= 0 else found[0]
                events.append((k, local, *commit, None, None, None, None))
        elif entry.startswith(":"):
            if k < last:
                events.append((k, local, *commit, *_meta(entry), pieces[k + 1]))
            k += 1
        k += 1
    trail = next((n for n in range(max(last, 0)) if not pieces[last - n].lstrip("\n").startswith(":")), max(last, 0))
    loose = pieces[1 : (last if begin is None else begin) + 1]
    part = (pieces[0] if last >= 0 else None, pieces[-1], loose, max(last, 0), begin is not None, trail, pieces[last] if last > 0 else None, local + 1, first)
    return events, (*commit, part)


def read_parts(raw_logs: DataFrame) -> DataFrame:
    """The events of every part of ``raw_logs(repo, part, log)``, and a row without ``seq`` that describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                repo, part, log = (batch.column(k)[row].as_py() for k in range(3))
                events, (sha, epoch, own) = read_part(log or "")
                rows = [(repo, part, *e, *[None] * len(_PART)) for e in events]
                rows.append((repo, part, None, None, sha, epoch, *[None] * 4, *own))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return raw_logs.select("repo", F.col("part").cast("long").alias("part"), "log").mapInArrow(run, _DDL)


def _entry(token: str | Column) -> Column:
    """A token as a header or record would have it: without the newlines before it."""
    return F.ltrim(token, F.lit("\n"))


def _stitched(parts: DataFrame) -> DataFrame:
    """``parts`` that end a token, with the whole of that token; and a last one for what the log ends with."""
    before = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("head").isNotNull()
    counted = parts.withColumn("open", F.coalesce(F.sum(closes.cast("long")).over(before), F.lit(0)))
    # What a part leaves open, or adds to what is open, in order.
    left = counted.select("repo", (F.col("open") + closes.cast("long")).alias("open"), "part", "tail")
    grown = left.groupBy("repo", "open").agg(
        F.max("part").alias("until"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "tail"))), lambda x: x["tail"]), "").alias("so_far")
    )
    ended = counted.where(closes).join(grown.drop("until"), ["repo", "open"], "left")
    ended = ended.withColumns({"token": F.concat(F.coalesce("so_far", F.lit("")), "head"), "end": F.lit(0)})
    ends = grown.groupBy("repo").agg(F.max_by(F.struct("until", "so_far"), "open").alias("at"))
    rest = {"head": "''", "tail": "''", "loose": "array()", "tokens": "0L", "synced": "false", "trail": "0L", "last_token": "null", "headers": "0L", "first_sha": "null", "sha": "null", "epoch": "null"}
    ends = ends.select("repo", F.col("at.until").alias("part"), F.col("at.so_far").alias("token"), F.lit(1).alias("end"), *[F.expr(v).alias(k) for k, v in rest.items()])
    columns = ["repo", "part", "end", "token", *rest]
    return ended.select(*columns).unionByName(ends.select(*[F.col(c).cast(ended.schema[c].dataType).alias(c) for c in columns]))


def _loose_events(ended: DataFrame) -> DataFrame:
    """Headers and records among the tokens that no part could tell by itself."""
    order = Window.partitionBy("repo").orderBy("part", "end")
    colon = F.startswith(_entry("token"), F.lit(":"))
    synced = F.col("synced") | ~colon
    own = F.when(F.col("synced"), F.col("trail")).otherwise(F.col("tokens"))
    ended = ended.withColumns({"colon": colon, "ended_by": F.coalesce("last_token", "token"), "more": F.when(synced, 0).otherwise(F.col("tokens") + 1).cast("long")})
    ended = ended.withColumn("sum", F.sum("more").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(synced, F.struct(own.alias("run"), "sum")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ended = ended.withColumns({"known": known, "before": F.lag("ended_by").over(order)})
    # Colons in a row before the part's first token.
    run = F.coalesce(F.col("known.run") - F.col("known.sum"), F.lit(0)) + F.col("sum") - F.col("more")
    ended = ended.withColumns({"run": run, "all": F.concat(F.array("token"), "loose")})
    tokens = ended.select("repo", "part", "end", "run", "colon", "before", "all", F.posexplode("all").alias("seq", "text"))
    run = F.when(F.col("seq") == 0, F.col("run")).otherwise(F.col("seq") - 1 + F.when(F.col("colon"), F.col("run") + 1).otherwise(0))
    path = run % 2 == 1
    meta = F.split(F.substring(_entry(F.when(F.col("seq") == 0, F.col("before")).otherwise(F.get("all", F.col("seq") - 1))), 2, 1 << 30), " ", -1)
    words = F.split(F.substring(_entry("text"), 2, 1 << 30), " ", -1)
    header = ~path & F.startswith(_entry("text"), F.lit("\x01"))
    time = F.trim(F.get(words, F.lit(1)))
    return tokens.where(path | header).select(
        "repo", "part", "end", F.col("seq").cast("long").alias("seq"),
        F.when(header, F.struct(F.get(words, F.lit(0)).alias("sha"), F.when(F.rlike(time, F.lit("^[0-9]{1,18}$")), time.cast("long")).alias("epoch"))).alias("commit"),
        *[F.when(path, F.get(meta, F.lit(k))).alias(name) for name, k in (("new_mode", 1), ("blob", 3), ("status", 4))],
        F.when(path, F.col("text")).alias("path"),
    )


def parse_raw_log(raw_logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commits`` and ``changes`` of ``raw_logs(repo, part, log)``: the log of a repository is its parts one behind the other.

    Parts may be cut anywhere, inside a header, a record, a path or between; one
    may be empty, and a token may span several. ``commit_index`` is the order of
    first appearance; a header that repeats the commit before it, as merges do,
    goes on with that commit, also across parts. A record before the first
    header of its log raises: nothing says whose change it is.
    """
    read = materialise(read_parts(raw_logs), "log", STORED_CODEC)
    parts = read.where("seq IS NULL")
    ended = materialise(_stitched(parts), "parts")
    loose = materialise(_loose_events(ended), "loose")

    # Loose tokens stand before the others of their part: two stretches a part, each with commits of its own.
    so_far = Window.partitionBy("repo", "part", "end").orderBy("seq")
    previous = F.last("commit.sha", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("commit").isNotNull() & ~F.col("commit.sha").eqNullSafe(previous)
    walked = loose.withColumn("fresh", fresh).where(F.col("fresh") | F.col("commit").isNull())
    walked = walked.withColumn("local", F.sum(F.col("fresh").cast("long")).over(so_far) - 1)
    walked = walked.withColumn("commit", F.last("commit", ignorenulls=True).over(so_far))
    walked = materialise(walked.select("repo", "part", "end", F.lit(0).alias("late"), "seq", "local", "commit.sha", "commit.epoch", "new_mode", "blob", "status", "path"), "loose")
    early = walked.groupBy("repo", "part", "end", "late").agg(
        F.max(F.col("local") + 1).alias("headers"), F.min_by("sha", F.when(F.col("local") >= 0, F.col("seq"))).alias("first_sha"),
        F.max_by("sha", "seq").alias("sha"), F.max_by("epoch", "seq").alias("epoch"),
    )
    late = parts.select("repo", "part", F.lit(0).alias("end"), F.lit(1).alias("late"), "headers", "first_sha", "sha", "epoch")
    order = Window.partitionBy("repo").orderBy("part", "end", "late")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stretches = early.unionByName(late).withColumn("carried", F.last(F.when(F.col("headers") > 0, F.struct("sha", "epoch")), ignorenulls=True).over(before))
    stretches = stretches.withColumn("shared", F.coalesce(F.col("first_sha") == F.col("carried.sha"), F.lit(False)).cast("long"))
    stretches = stretches.withColumn("commits", F.coalesce(F.sum(F.col("headers") - F.col("shared")).over(before), F.lit(0)))
    stretches = stretches.select("repo", "part", "end", "late", "carried", "commits", (F.col("commits") - F.col("shared")).alias("offset"))

    told = read.where("seq IS NOT NULL").select("repo", "part", F.lit(0).alias("end"), F.lit(1).alias("late"), "seq", "local", "sha", "epoch", "new_mode", "blob", "status", "path")
    placed = attach(told.unionByName(walked), materialise(stretches, "stretches"), ["repo", "part", "end", "late"], ["seq"], ScanOptions(), stored=True)
    own = F.col("local") >= 0
    stray = F.raise_error(F.concat(F.lit("a log does not begin with a commit header: "), F.coalesce(F.col("repo"), F.lit("")), F.lit(" "), F.col("part").cast("string")))
    placed = placed.select(
        "repo",
        F.when(own, F.col("offset") + F.col("local")).otherwise(F.col("commits") - 1).alias("commit_index"),
        F.when(own, F.col("sha")).when(F.col("carried").isNull(), stray.cast("string")).otherwise(F.col("carried.sha")).alias("commit_sha"),
        F.timestamp_seconds(F.when(own, F.col("epoch")).otherwise(F.col("carried.epoch"))).alias("commit_time"),
        # Within a commit, records keep their place by part and position.
        (F.col("part") * F.lit(1 << 40) + F.col("end") * F.lit(1 << 39) + F.col("seq")).alias("seq"),
        "new_mode", "blob", "status", "path",
    )
    commits = placed.where(F.col("path").isNull()).groupBy("repo", "commit_index", "commit_sha").agg(F.min("commit_time").alias("commit_time"))
    return commits, placed.where(F.col("path").isNotNull())
