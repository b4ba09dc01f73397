"""Every operator as a query over the given tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame. Inputs are the
raw tables or corpora derived from them; results hold locations, ids and
digests, never a matched value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan import corpora
from leakscan.functions import context, dotenv, entropy, generic, paths, text
from leakscan.operators import allowlist, history, packs, report, scan, xref, yaml_windows
from leakscan.operators.lookup import spread_small_input
from leakscan.options import MAX_BLOB_BYTES, MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH, ScanOptions
from leakscan.plans import change_set
from leakscan.plans.history_scan import HistoryScan, scan_history
from leakscan.sources import raw_log, readers, tree, writers
from leakscan.sources.workspace import STORED_CODEC, fresh_path, materialise
from leakscan.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@cache
def _stored(spark: SparkSession, sf_dir: str, corpus: str) -> str:
    """Where a derived corpus is kept for the session, as a real table would be."""
    path = fresh_path(spark, corpus)
    derived = getattr(corpora, corpus)
    table = spread_small_input(_table(spark, sf_dir, derived.table), [])
    derived.of(table).write.option("compression", STORED_CODEC).parquet(path)
    return path


def stored_corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_stored(spark, sf_dir, name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: one repository per source."""
    docs = _table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    return spread_small_input(docs, ["path"])


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files: one repository per host."""
    pages = _table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("repo"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )
    return spread_small_input(pages, ["path"])


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("role").alias("repo"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"),
        F.col("text").alias("content"),
    )


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("repo", "path", F.posexplode(text.split_lines(F.col("content"))).alias("n", "text"))
    return lines.select("repo", "path", (F.col("n") + 1).alias("line"), "text")


def _places(findings: DataFrame) -> DataFrame:
    return findings.select("repo", "path", F.col("line").cast("bigint").alias("line"), "rule_id")


def entropy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = stored_corpus(spark, sf_dir, "planted_entropy")
    return tokens.select("repo", "path", F.concat(F.lit("x = '"), "token", F.lit("'")).alias("content"))


# --- sources -----------------------------------------------------------------


@query
def read_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01: changed files joined to their content; some have none."""
    changes = stored_corpus(spark, sf_dir, "planted_paths").withColumn(
        "status", F.substring(F.lit("ACMRTDUX"), (F.col("k") % 8 + 1).cast("int"), F.lit(1))
    )
    contents = changes.where(F.col("k") % 3 != 0).select("repo", "path", F.concat(F.lit("c"), "path").alias("content"))
    files = readers.changed_files(changes.select("repo", "path", "status"), contents)
    return files.select("repo", "path", "status", F.col("content").isNotNull().alias("has_content"))


@query
def decode_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-02: every document in one of six encodings, decoded."""
    docs = _table(spark, sf_dir, "documents")
    body, mark = F.col("text"), lambda h: F.unhex(F.lit(h))
    blob = (
        F.when(F.col("doc_id") % 6 == 0, F.encode(body, "UTF-8"))
        .when(F.col("doc_id") % 6 == 1, F.concat(mark("FFFE"), F.encode(body, "UTF-16LE")))
        .when(F.col("doc_id") % 6 == 2, F.concat(mark("FEFF"), F.encode(body, "UTF-16BE")))
        .when(F.col("doc_id") % 6 == 3, F.concat(mark("EFBBBF"), F.encode(body, "UTF-8")))
        .when(F.col("doc_id") % 6 == 4, F.encode(body, "UTF-16LE"))
        .otherwise(F.concat(mark("FEFF"), F.encode(body, "UTF-16BE"), mark("00")))
    )
    decoded = docs.select("doc_id", text.decode_blob(blob).alias("t"))
    return decoded.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("bigint").alias("chars"))


@query
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-03: numbered lines of every document."""
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(text.split_lines(F.col("text"))).alias("n", "t"))
    return lines.select("doc_id", (F.col("n") + 1).cast("bigint").alias("line"), F.length("t").cast("bigint").alias("chars"))


def _raw_logs(changes: DataFrame) -> DataFrame:
    """Logs written from the derived changes, in parts of 1000 order keys."""
    nul = F.lit("\0")
    record = F.concat(
        F.lit(":100644 "), "new_mode", F.lit(" "), F.lit("1" * 40), F.lit(" "), "blob", F.lit(" "), "status", nul,
        F.when(F.col("pick") % 7 == 0, F.lit("\x01")).when(F.col("pick") % 7 == 1, F.lit(":x\n")).otherwise(""), "path", nul,
    )
    header = F.concat(F.lit("\x01"), "commit_sha", F.lit(" "), F.col("epoch").cast("string"), nul)
    # All changes of a part go to one place once, their hashes as bytes; commits and parts are put together there.
    part = F.floor(F.col("commit_index") / 1000).cast("int").alias("part")
    bytes_of = lambda name: F.unhex(name).alias(name)
    dealt = changes.select(
        "repo", part, "commit_index", bytes_of("commit_sha"), "epoch", "seq", "new_mode", bytes_of("blob"), "status", "pick", "path"
    ).repartition("repo", "part")
    dealt = dealt.withColumns({name: F.lower(F.hex(name)) for name in ("commit_sha", "blob")})
    # Every other record repeats its commit's header, as merges do.
    per_commit = dealt.groupBy("repo", "part", "commit_index", "commit_sha", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("seq", record.alias("r")))).alias("rs")
    )
    body = F.array_join(
        F.transform(
            "rs",
            lambda r, i: F.concat(F.when(i % 2 == 1, F.concat(F.lit("\n"), header)).otherwise(F.lit("\n")), r.getField("r")),
        ),
        "",
    )
    logs = per_commit.select("repo", "part", "commit_index", F.concat(header, body).alias("log"))
    return logs.groupBy("repo", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("commit_index", "log"))), lambda c: c.getField("log")), "").alias("log")
    )


@cache
def _log_path(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "raw_logs")
    changes = corpora.planted_changes.of(spread_small_input(_table(spark, sf_dir, corpora.planted_changes.table), []))
    _raw_logs(changes).write.option("compression", STORED_CODEC).parquet(path)
    return path


def _stored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_log_path(spark, sf_dir))


@query
def parse_raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04: raw log text to numbered commits and change records."""
    return _parsed(spread_small_input(_stored_logs(spark, sf_dir), ["repo", "part"]))


def _parsed(logs: DataFrame) -> DataFrame:
    _, changes = raw_log.parse_raw_log(logs)
    return changes.select(
        "repo", F.col("commit_index").cast("bigint").alias("commit_index"), "commit_sha",
        F.unix_seconds("commit_time").alias("epoch"), "new_mode", "blob", "status", "path",
    )


@query
def parse_cut_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04: the same logs cut every 4999 characters, wherever that is."""
    logs = _stored_logs(spark, sf_dir)
    cut = logs.select("repo", "part", "log", F.explode(F.sequence(F.lit(0), F.expr("length(log) div 4999"))).alias("k"))
    part = F.col("part").cast("bigint") * 4096 + F.col("k")
    return _parsed(cut.select("repo", part.alias("part"), F.substring("log", F.col("k") * 4999 + 1, F.lit(4999)).alias("log")))


@query
def load_dotenv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05: env files worth cross-referencing, by path and within limits on size and depth."""
    files = stored_corpus(spark, sf_dir, "planted_paths")
    return readers.select_dotenv_files(files, MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH).select("repo", "path")


@query
def skipped_dotenv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05: what the limits on size and depth leave out, by reason."""
    files = stored_corpus(spark, sf_dir, "planted_paths")
    return readers.skipped_dotenv_files(files, MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH)


def _allow_files(spark: SparkSession, sf_dir: str, staged: bool) -> DataFrame:
    base = _table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    rows = base.where(F.col("k") % 3 == 0) if staged else base
    name = F.when(F.col("k") % 2 == 0, ".leakscanignore").when(F.col("k") % 5 == 0, "sub/.gitleaksignore").otherwise(".gitleaksignore")
    content = F.concat(F.lit("staged " if staged else "working "), "s_name")
    return rows.select(F.concat(F.lit("nation"), F.col("s_suppkey").cast("string")).alias("repo"), name.alias("path"), content.alias("content"))


@query
def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01: files written to a directory tree, listed and read back."""
    root = fresh_path(spark, "tree")
    of = lambda name: F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    folder = F.concat(of("repo"), F.lit("/"), of("k")).alias("folder")
    tree.write_tree(stored_corpus(spark, sf_dir, "planted_paths").select(folder, F.concat(F.lit("content of "), "path").alias("line")), root)
    files = readers.read_file_tree(spark, root, "tree").where(F.col("path").endswith(".txt"))
    part = lambda name: F.regexp_extract("path", f"(?:^|/){name}=([^/]*)/", 1)
    return files.select(
        part("repo").alias("repo"), part("k").cast("bigint").alias("k"), F.md5(F.rtrim("content", F.lit("\n")).cast("binary")).alias("digest")
    )


@query
def load_rule_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: pack files at a trusted location, read and judged; how often each reason occurs over all packs.

    Equal packs are one file, which counts as often as there are of them.
    """
    root = fresh_path(spark, "packs")
    texts = _rule_packs(spark, sf_dir).where(F.trim("text") != "").groupBy("text").agg(F.min("pack").alias("name"), F.count("*").alias("copies"))
    texts = materialise(texts, "packs")
    texts.select("text", "name").write.partitionBy("name").text(root)
    parsed = packs.parse_rule_packs(readers.read_rule_packs(spark, root))
    named = parsed.withColumn("name", F.regexp_extract("pack", "name=([^/]*)/", 1))
    return named.join(texts.select("name", "copies"), "name").groupBy("reason").agg(F.sum("copies").alias("n"))


@query
def write_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-08: findings written as a report and read back; only its columns are there."""
    out = fresh_path(spark, "report")
    findings = scan.scan_texts(stored_corpus(spark, sf_dir, "planted_lines")).where(F.col("rule_ord").between(101, 140))
    writers.write_findings(findings.withColumn("value", F.lit("matched")), out)
    back = spark.read.parquet(out)
    return _places(back).withColumn("columns", F.lit(",".join(sorted(back.columns))))


@query
def load_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07: allowlist files per repository, the staged version first."""
    texts = readers.select_allowlist_texts(_allow_files(spark, sf_dir, False), _allow_files(spark, sf_dir, True))
    return texts.select("repo", F.col("ord").cast("bigint").alias("ord"), "text")


# --- paths -------------------------------------------------------------------


def _path_query(value) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path", value(F.col("path")).alias("value"))

    return run


QUERIES["heuristic_exempt"] = _path_query(paths.heuristic_exempt)
QUERIES["is_code_file"] = _path_query(paths.is_code_file)
QUERIES["is_env_template"] = _path_query(paths.is_env_template)
QUERIES["is_dotenv_file"] = _path_query(paths.is_dotenv_file)
QUERIES["filename_rule"] = _path_query(lambda p: paths.filename_rule_ord(p).cast("bigint"))


@query
def looks_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15 over whole documents, some with NULs or control characters put in."""
    docs = _table(spark, sf_dir, "documents")
    content = (
        F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\0")))
        .when(F.col("doc_id") % 4 == 2, F.translate("text", "aeiou ", "\x01\x02\x03\x0e\x1f\x08"))
        .when(F.col("doc_id") % 4 == 3, F.translate("text", "aeiou ", "\t\n\x0b\f\r\x01"))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", text.looks_binary(content).alias("is_binary"))


def _allow_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "part").select("p_size").distinct()
    entries = (
        F.when(F.col("p_size") % 5 == 0, "^docs/\n# note\n[.]env")
        .when(F.col("p_size") % 5 == 1, "README\n\n ^client.*json$ ")
        .when(F.col("p_size") % 5 == 2, "([unclosed\n(a+)+$\nsecrets/")
        .when(F.col("p_size") % 5 == 3, r"\.(rs|go|PY)$")
        .otherwise("b.c\n^x")
    )
    return sizes.select(F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("repo"), F.lit(1).alias("ord"), entries.alias("text"))


@query
def path_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-16: each path against the entries of its repository."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path")
    return allowlist.flag_allowlisted(files, allowlist.parse_allowlist(_allow_texts(spark, sf_dir)))


@query
def path_allowlisted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-16 for long lists: entries looked up by the literals they require."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path")
    return allowlist.flag_allowlisted(files, allowlist.parse_allowlist(_allow_texts(spark, sf_dir)), ScanOptions(joined_entries=0))


@query
def path_allowlisted_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-16 for lists beyond the broadcast limit: paths and entries meet by trigram."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path")
    options = ScanOptions(joined_entries=0, broadcast_limit_bytes=0)
    return allowlist.flag_allowlisted(files, allowlist.parse_allowlist(_allow_texts(spark, sf_dir)), options)


@query
def apply_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47: the paths left after the allowlist."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path")
    return allowlist.apply_allowlist(files, allowlist.parse_allowlist(_allow_texts(spark, sf_dir)))


@query
def inline_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17: which lines carry a marker."""
    lines = _lines(stored_corpus(spark, sf_dir, "planted_generic"))
    allowed = text.inline_allowed(F.col("text"), ScanOptions().inline_markers)
    return lines.select("repo", "path", F.col("line").cast("bigint").alias("line"), allowed.alias("allowed"))


_PATTERNS = ["^src/.*[.]lock$", "(a+)+$", "test/fixtures/", "([a-z]+)*x", "(x*){2,}", "([unclosed", "*bad", "a{2,1}", "docs/**", "^(src|test)/x"]


def _pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    pattern = F.get(F.array(*[F.lit(p) for p in _PATTERNS]), (F.col("p_partkey") % len(_PATTERNS)).cast("int"))
    long_one = F.when(F.col("p_partkey") % 7 == 0, F.concat(pattern, F.repeat(F.lit("x"), 195))).otherwise(pattern)
    return part.select(F.col("p_partkey").alias("k"), long_one.alias("pattern"))


@query
def is_risky_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-19 over patterns of every shape."""
    return _pattern_rows(spark, sf_dir).select("k", allowlist.is_risky_pattern(F.col("pattern")).alias("risky"))


@query
def parse_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-18: allowlist texts to entries; which run as patterns, which as plain text."""
    rows = _pattern_rows(spark, sf_dir)
    texts = rows.select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("repo"),
        F.lit(1).alias("ord"),
        F.concat(F.lit("# c\r\n  "), "pattern", F.lit("\t\n\n#x\nplain"), F.col("k").cast("string")).alias("text"),
    )
    return allowlist.parse_allowlist(texts).select("repo", "ord", "pattern", "is_regex")


def _rule_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON pack per part, with a different flaw in each."""
    k = F.col("p_partkey").cast("string")
    entries = [
        '{"id": "good-rule", "description": " fine ", "regex": "\\\\bzz_[0-9]{4}\\\\b"}',
        '{"id": "BadCase", "description": "x", "regex": "x"}',
        '{"id": "github-pat", "description": "x", "regex": "x"}',
        '{"id": "good-rule", "description": "again", "regex": "y"}',
        '{"id": "no-regex", "description": "x"}',
        '{"id": "bad-regex", "description": "x", "regex": "([unclosed"}',
        '{"id": "risky", "description": "x", "regex": "(a+)+$"}',
        '{"id": "flagged", "description": "x", "regex": "x", "flags": "gi"}',
        '{"id": "no-text", "description": "  ", "regex": "x"}',
        '{"id": "two-lines", "description": "a\\nb", "regex": "x"}',
        "17",
        '{"id": 5, "description": "x", "regex": "x"}',
        '{"id": "null-flags", "description": "x", "regex": "x", "flags": null}',
    ]
    listed = F.array(*[F.lit(e) for e in entries])
    start = (F.col("p_partkey") % len(entries) + 1).cast("int")
    chosen = F.array_join(F.concat(F.slice(listed, start, F.lit(4)), F.slice(listed, F.lit(1), (F.col("p_size") % 3).cast("int"))), ", ")
    pack = (
        F.when(F.col("p_partkey") % 29 == 0, F.lit("{ not json"))
        .when(F.col("p_partkey") % 31 == 0, F.lit('{"rules": "nope"}'))
        .when(F.col("p_partkey") % 37 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit('{"rules": ['), chosen, F.lit("]}")))
    )
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("pack"), k).alias("pack"), pack.alias("text"))


@query
def parse_rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-20: every entry of every pack with its verdict."""
    parsed = packs.parse_rule_packs(_rule_packs(spark, sf_dir))
    return parsed.select("pack", F.col("pos").cast("bigint").alias("pos"), F.col("where").alias("place"), "reason")


# --- line and context rules --------------------------------------------------


def _layer(findings: DataFrame, *orders: int) -> DataFrame:
    return _places(findings.where(F.col("rule_ord").isin(*orders)))


@query
def scan_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-21: token shapes over planted lines, hits and near misses."""
    findings = scan.scan_texts(stored_corpus(spark, sf_dir, "planted_lines"))
    return _places(findings.where(F.col("rule_ord").between(101, 140)))


_PACK = (
    '{"rules": ['
    '{"id": "team-name", "description": "customer id", "regex": "\\\\bcustomer#0+[1-9]\\\\d*$", "flags": "i"},'
    '{"id": "quoted-run", "description": "long quoted run", "regex": "\\"[A-Z]{4}\\\\w{16,}\\""},'
    '{"id": "spaced", "description": "value after v", "regex": "^v\\\\s=\\\\s\\\\S+$"}]}'
)


@query
def scan_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-22: the rules of a user pack, next to the built-in ones."""
    pack = _table(spark, sf_dir, "region").limit(1).select(F.lit("team").alias("pack"), F.lit(_PACK).alias("text"))
    rules = packs.accepted_rules(packs.parse_rule_packs(pack), "team")
    findings = scan.scan_texts(stored_corpus(spark, sf_dir, "planted_lines"), rules=rules)
    return _places(findings.where(F.col("rule_ord").between(1001, 1999)))


@query
def scan_gcp_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23 over configuration files."""
    return _layer(scan.scan_texts(stored_corpus(spark, sf_dir, "planted_context")), 2001)


@query
def scan_k8s_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-24 over manifests, in row."""
    return _layer(scan.scan_texts(stored_corpus(spark, sf_dir, "planted_k8s")), 2002)


@query
def yaml_secret_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W3: the same manifests as a table of lines, with windows."""
    lines = _lines(stored_corpus(spark, sf_dir, "planted_k8s"))
    found = yaml_windows.secret_data_lines(lines, ["repo", "path"])
    return found.select("repo", "path", F.col("line").cast("bigint").alias("line"))


@query
def scan_twilio_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-25 over configuration files."""
    return _layer(scan.scan_texts(stored_corpus(spark, sf_dir, "planted_context")), 2003)


# --- heuristic layer ---------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(stored_corpus(spark, sf_dir, "planted_generic"))
    return lines.select("repo", "path", F.col("line").cast("bigint").alias("line"), F.explode(generic.generic_candidates(F.col("text"))).alias("c"))


@query
def generic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30: where each keyword value starts, and a digest of it."""
    digest = F.md5(F.col("c.value").cast("binary")).alias("digest")
    return _candidates(spark, sf_dir).select("repo", "path", "line", F.length("c.key_context").cast("bigint").alias("starts"), digest)


@query
def is_hardcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-31: the verdict on each candidate, as code and as configuration."""
    value, key = F.col("c.value"), F.col("c.key_context")
    return _candidates(spark, sf_dir).select(
        "repo", "path", "line", F.length(key).cast("bigint").alias("starts"),
        generic.is_hardcoded(value, F.lit(True), key).alias("in_code"),
        generic.is_hardcoded(value, F.lit(False), key).alias("in_config"),
    )


def _value_query(verdict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = stored_corpus(spark, sf_dir, "planted_values")
        return values.select("k", verdict(F.col("value"), F.col("key_context")).alias("verdict"))

    return run


QUERIES["is_placeholder"] = _value_query(lambda v, c: generic.is_placeholder(v))
QUERIES["is_route_template"] = _value_query(lambda v, c: generic.is_route_template(v))
QUERIES["echoes_key"] = _value_query(lambda v, c: generic.echoes_key(v, c))


@query
def scan_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-35 over planted assignments."""
    return _layer(scan.scan_texts(stored_corpus(spark, sf_dir, "planted_generic")), 2004)


@query
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36 in micro-bits per character."""
    tokens = stored_corpus(spark, sf_dir, "planted_entropy")
    return tokens.select("path", F.round(entropy.shannon_entropy(F.col("token")) * 1000000).cast("bigint").alias("microbits"))


@query
def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37: how many strings a token is scored as, and the longest."""
    tokens = stored_corpus(spark, sf_dir, "planted_entropy")
    parts = entropy.entropy_candidates(F.col("token"))
    return tokens.select(
        "path", F.size(parts).cast("bigint").alias("parts"),
        F.array_max(F.transform(parts, F.length)).cast("bigint").alias("longest"),
    )


@query
def looks_like_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-38 over the planted tokens."""
    tokens = stored_corpus(spark, sf_dir, "planted_entropy")
    return tokens.select("path", entropy.looks_like_identifier(F.col("token")).alias("verdict"))


@query
def scan_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-39 over the planted tokens in a line of code."""
    return _layer(scan.scan_texts(entropy_files(spark, sf_dir)), 2005)


# --- env files ---------------------------------------------------------------


@query
def parse_dotenv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: keys and digests of the values of every env file."""
    pairs = xref.dotenv_assignments(stored_corpus(spark, sf_dir, "planted_env"))
    return pairs.select("repo", "path", F.col("line").cast("bigint").alias("line"), "key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query
def is_dotenv_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41: which of those assignments hold a secret."""
    pairs = xref.dotenv_assignments(stored_corpus(spark, sf_dir, "planted_env"))
    verdict = dotenv.is_dotenv_secret(F.col("key"), F.col("value"))
    return pairs.select("repo", "path", F.col("line").cast("bigint").alias("line"), verdict.alias("verdict"))


@query
def word_boundary_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42: the line where a file first holds its service's value, if it does."""
    users = stored_corpus(spark, sf_dir, "planted_users")
    pairs = xref.dotenv_assignments(stored_corpus(spark, sf_dir, "planted_env")).where(F.col("value") != "")
    service = F.regexp_extract("path", "^[^/]*", 0)
    joined = users.withColumn("service", service).join(
        pairs.select("repo", service.alias("service"), "key", "value"), ["repo", "service"]
    )
    return joined.select("repo", "path", "key", dotenv.boundary_line(F.col("content"), F.col("value")).cast("bigint").alias("line"))


@query
def xref_dotenv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: files that hold a secret value of their repository."""
    secrets = xref.dotenv_secrets(stored_corpus(spark, sf_dir, "planted_env"))
    return _layer(scan.scan_files(stored_corpus(spark, sf_dir, "planted_users"), secrets=secrets), 10)


@query
def xref_dotenv_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43 the way it runs when the values are too many to broadcast."""
    secrets = xref.dotenv_secrets(stored_corpus(spark, sf_dir, "planted_env"))
    found = xref.xref_lines(stored_corpus(spark, sf_dir, "planted_users"), secrets, ["repo", "path"], ScanOptions(broadcast_limit_bytes=0))
    return found.select("repo", "path", F.col("line").cast("bigint").alias("line"))


@query
def dotenv_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-56: env files and value counts per repository."""
    rows = xref.dotenv_coverage(stored_corpus(spark, sf_dir, "planted_env"), shown=4)
    return rows.select("repo", F.array_join("files", ",").alias("files"), "file_count", "secret_count", "status")


# --- history -----------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stored_corpus(spark, sf_dir, "planted_changes")
    return changes.withColumn("commit_time", F.timestamp_seconds("epoch"))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(stored_corpus(spark, sf_dir, "planted_blobs").where(F.col("kind") != 5).distinct(), "blobs")
    return rows.select("repo", "blob", "size", F.encode("content", "UTF-8").alias("content"))


def _head(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("commit_index") % 3 == 0) & (F.col("status") != "D")).select("repo", "blob", "path").distinct()


def _history_allow(changes: DataFrame) -> DataFrame:
    return changes.select("repo").distinct().where(F.col("repo").endswith("4")).select(
        "repo", F.lit(1).cast("bigint").alias("ord"), F.lit("docs/").alias("pattern"), F.lit(True).alias("is_regex"),
        F.explode(F.array(F.lit("docs/"), F.lit("^f7[.]"))).alias("matcher"),
    )


def _history(spark: SparkSession, sf_dir: str, use_allowlist: bool = True, limit: int | None = None) -> HistoryScan:
    changes = _changes(spark, sf_dir)
    return scan_history(
        changes,
        _blobs(spark, sf_dir),
        _head(changes),
        ScanOptions(max_blob_bytes=limit),
        allowlist=_history_allow(changes),
        use_allowlist=use_allowlist,
    )


@query
def introduce_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48: the change that introduced each version."""
    versions = history.introduce_versions(_changes(spark, sf_dir))
    return versions.select("repo", "blob", "path", "commit_index", "commit_sha", F.unix_seconds("commit_time").alias("epoch"))


@query
def distinct_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-49: each content once."""
    return history.distinct_blobs(history.introduce_versions(_changes(spark, sf_dir)))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    versions = materialise(history.introduce_versions(changes))
    limited = ScanOptions(max_blob_bytes=MAX_BLOB_BYTES)
    return history.classify_versions(versions, _blobs(spark, sf_dir), _history_allow(changes), limited)


@query
def classify_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44: what happens to each version."""
    return _classified(spark, sf_dir).select("repo", "blob", "path", "status")


@query
def fetch_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45: contents of the blobs to scan; some turn out to be missing."""
    fetched = history.fetch_contents(_classified(spark, sf_dir), _blobs(spark, sf_dir))
    return fetched.select("repo", "blob", "state", F.md5("content").alias("digest"))


@query
def flag_in_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-46: which versions are still in the current tree."""
    changes = _changes(spark, sf_dir)
    return history.flag_in_head(history.introduce_versions(changes).select("repo", "blob", "path"), _head(changes))


def _history_places(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo", "blob", "path", F.col("line").cast("bigint").alias("line"), "rule_id", "commit_index", "in_head"
    )


@query
def scan_whole_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-73: every version scanned once, attributed and flagged."""
    return _history_places(_history(spark, sf_dir).findings)


@query
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-73 without the repository's own allowlist and markers."""
    return _history_places(_history(spark, sf_dir, use_allowlist=False).findings)


@query
def history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50 over history: what was and was not scanned."""
    return _history(spark, sf_dir, limit=MAX_BLOB_BYTES).coverage


@query
def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-54: findings in report order."""
    return _history_places(report.order_findings(_history(spark, sf_dir).findings))


@query
def findings_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52: totals per commit."""
    rows = report.findings_by_commit(_history(spark, sf_dir).findings)
    return rows.select("repo", "commit_index", "commit", "date", "findings", "files", "still_in_head")


@query
def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52: one report line per finding."""
    return report.commit_lines(_history(spark, sf_dir).findings).select("repo", "commit", "date", "text")


@query
def top_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55: the first oversized versions of each repository."""
    rows = report.top_oversized(_history(spark, sf_dir, limit=MAX_BLOB_BYTES).versions, report.OVERSIZED_SHOWN)
    return rows.select("repo", F.col("position").cast("bigint").alias("position"), "label", "more")


@query
def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-59: everything that was not scanned."""
    scanned = _history(spark, sf_dir, limit=MAX_BLOB_BYTES)
    shallow = scanned.commits.select("repo").distinct().withColumn("shallow", F.col("repo").endswith("7"))
    errors = packs.rule_errors(packs.parse_rule_packs(_rule_packs(spark, sf_dir)))
    return report.caveats(scanned.coverage, errors, shallow)


# --- reports over scans of files ---------------------------------------------


@query
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50, flagship: findings per document source, clean sources included."""
    return scan.scan_coverage(document_files(spark, sf_dir))


@query
def coverage_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50 from stored findings: files without content and clean repositories included."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select(
        "repo", "path", F.when(F.col("k") % 3 != 0, "password: 'orange7secret'").alias("content")
    )
    return report.coverage_summary(files, scan.scan_files(files))


@query
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-51 over the planted lines."""
    rows = report.findings_by_file(scan.scan_files(stored_corpus(spark, sf_dir, "planted_lines")))
    return rows.select("repo", "path", "findings", F.col("first_line").cast("bigint").alias("first_line"), "rules")


@query
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-51: one report line per finding."""
    files = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path", F.lit("k = 'x'").alias("content"))
    lines = report.finding_lines(scan.scan_files(files.unionByName(stored_corpus(spark, sf_dir, "planted_context"))))
    return lines.select("repo", "path", "text")


@query
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53 over the planted lines."""
    return report.findings_by_rule(scan.scan_files(stored_corpus(spark, sf_dir, "planted_lines")))


def _every_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted content and names of every kind; repositories named after their kind, but those with env values."""
    own = lambda files, kind: files.select(F.concat(F.lit(f"{kind}/"), "repo").alias("repo"), "path", "content")
    files = own(entropy_files(spark, sf_dir), "entropy")
    for kind in ("lines", "context", "k8s", "generic"):
        files = files.unionByName(own(stored_corpus(spark, sf_dir, f"planted_{kind}"), kind))
    names = stored_corpus(spark, sf_dir, "planted_paths").withColumn("content", F.lit(None).cast("string"))
    users = stored_corpus(spark, sf_dir, "planted_users").select("repo", "path", "content")
    return files.unionByName(own(names, "paths")).unionByName(users)


@query
def findings_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53 by layer, over planted content for every layer and planted file names."""
    files = _every_layer(spark, sf_dir)
    return report.findings_by_layer(scan.scan_files(files, secrets=xref.dotenv_secrets(stored_corpus(spark, sf_dir, "planted_env"))))


@query
def findings_by_repo_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53 with subtotals per repository."""
    return report.findings_by_repo_rule(scan.scan_files(stored_corpus(spark, sf_dir, "planted_lines")))


@query
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-57: per repository, blocked or not."""
    files = stored_corpus(spark, sf_dir, "planted_generic")
    rows = change_set.gate_decision(files, scan.scan_files(files))
    return rows.select("repo", "findings", "blocked", F.col("exit_code").cast("bigint").alias("exit_code"))


@query
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58: findings of all layers, plus those of another scanner."""
    findings = scan.scan_files(stored_corpus(spark, sf_dir, "planted_context"))
    other = stored_corpus(spark, sf_dir, "planted_k8s").select(
        "repo", "path", F.lit(1).alias("line"), F.lit("external-rule").alias("rule_id")
    )
    return _places(report.merge_findings(findings, other))


@query
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-70 over every document."""
    return _places(scan.scan_texts(document_files(spark, sf_dir)))


@query
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-70 over every page."""
    return _places(scan.scan_texts(page_files(spark, sf_dir)))


@query
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-70 over every conversation turn, a third of them with a planted assignment, per-rule counts by role."""
    planted = F.when(F.pmod(F.regexp_extract("path", "[0-9]+", 0).cast("bigint"), F.lit(3)) == 0, F.concat(F.lit("\nDB_PASS=z"), F.substring(F.md5("content"), 1, 12))).otherwise("")
    findings = scan.scan_texts(conversation_files(spark, sf_dir).withColumn("content", F.concat("content", planted)))
    return findings.groupBy("repo", "rule_id").agg(F.count("*").alias("findings"))


@query
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the documents by quality label, unlabelled ones included."""
    findings = scan.scan_texts(document_files(spark, sf_dir))
    per_doc = findings.groupBy(F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return per_doc.join(labels, "doc_id", "left").groupBy("quality").agg(F.sum("n").alias("findings"))


@query
def scan_file_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-71: names, env values and content together; some files have no content."""
    secrets = xref.dotenv_secrets(stored_corpus(spark, sf_dir, "planted_env"))
    env = stored_corpus(spark, sf_dir, "planted_env").select("repo", "path", "content")
    templates = env.select("repo", F.concat("path", F.lit(".example")).alias("path"), "content")
    unread = stored_corpus(spark, sf_dir, "planted_paths").select("repo", "path", F.lit(None).cast("string").alias("content"))
    files = stored_corpus(spark, sf_dir, "planted_users").unionByName(env).unionByName(templates).unionByName(unread)
    return _places(scan.scan_files(files, secrets=secrets))


@query
def scan_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-72: the scannable, not allowlisted files of each change set."""
    files = stored_corpus(spark, sf_dir, "planted_generic").withColumn(
        "status", F.substring(F.lit("ACMRTDUX"), (F.length("content") % 8 + 1).cast("int"), F.lit(1))
    )
    entries = allowlist.parse_allowlist(
        _table(spark, sf_dir, "part").select("p_size").distinct().select(
            F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("repo"), F.lit(1).alias("ord"), F.lit("m1[0-9]*[.]js$\n9.py").alias("text")
        )
    )
    return _places(change_set.scan_change_set(files, allowlist=entries))


# --- streaming ---------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = _table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _drain(spark: SparkSession, arriving: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and read back what it wrote."""
    out = fresh_path(spark, "stream")
    writer = arriving.writeStream.outputMode(mode).option("checkpointLocation", f"{out}.checkpoint")
    if mode == "append":
        running = writer.trigger(availableNow=True).format("parquet").start(out)
    else:
        running = writer.trigger(availableNow=True).foreachBatch(
            lambda batch, n: batch.write.mode("append").parquet(out)
        ).start()
    running.awaitTermination()
    return spark.read.schema(arriving.schema).parquet(out)


@query
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-60: planted lines scanned as they arrive."""
    arriving = corpora.planted_lines.of(_stream(spark, sf_dir, "customer"))
    return _places(_drain(spark, stream.stream_scan(arriving)))


@query
def stream_env_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-60: env values looked up in files as they arrive, by joins alone."""
    secrets = xref.dotenv_secrets(stored_corpus(spark, sf_dir, "planted_env"))
    arriving = corpora.planted_users.of(_stream(spark, sf_dir, "supplier"))
    found = stream.stream_scan(arriving, ScanOptions(broadcast_limit_bytes=0), secrets=secrets)
    return _layer(_drain(spark, found), 10)


@query
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61: each version once, however often it arrives."""
    arriving = corpora.planted_changes.of(_stream(spark, sf_dir, "lineitem"))
    once = stream.first_seen(arriving, "1 day")
    return _drain(spark, once).select("repo", "blob", "path")


@query
def stream_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61: the earliest introduction known so far, settled by the last update."""
    arriving = corpora.planted_changes.of(_stream(spark, sf_dir, "lineitem"))
    updates = _drain(spark, stream.introduced_so_far(arriving), mode="update")
    return updates.groupBy("repo", "blob", "path").agg(F.min("commit_index").alias("commit_index"))


@query
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-62: a decision per arriving change set."""
    out = fresh_path(spark, "gate")
    arriving = corpora.planted_generic.of(_stream(spark, sf_dir, "part")).select(
        F.col("repo").alias("change_set"), "repo", "path", F.lit("M").alias("status"), "content"
    )
    running = (
        stream.stream_gate(arriving, lambda rows, n: rows.write.mode("append").parquet(out))
        .option("checkpointLocation", f"{out}.checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("change_set", "findings", "blocked", F.col("exit_code").cast("bigint").alias("exit_code"))
