"""The queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm import collocations, decontamination, fingerprints, language_id, packing, periodic_runs, pitman_yor, quality_crf, sharding, simhash_dedup, substring_dedup, token_count, warc
from leakscan.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC records and read back as chunks; the last chunk of each stands for its record."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("key"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")
    )
    options = warc.WarcOptions(keep_data=False)
    archives = warc.write_archives(pages, warc.archive_folder(spark), options)
    last = warc.read_archives(spark, archives, options).where("last")
    return last.select(
        warc.record_key("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.record_key("refers_to").alias("refers_to"),
        (F.col("chunk") + 1).alias("n_chunks"),
    )


SQL["op1_warc_chunks"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM hashed GROUP BY html
)
SELECT h.page_id, CAST(strlen(h.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h.hex, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN h.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> f.first THEN f.first END AS refers_to,
  CAST(greatest((strlen(h.html) + 65535) // 65536, 1) AS INTEGER) AS n_chunks
FROM hashed h JOIN firsts f ON h.html = f.html
"""


@query
def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents`` under a public byte-level vocabulary."""
    options = token_count.TokenCountOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), options)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text of ``documents`` and of its edited form, with their likeness."""
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.hexadecimal("fp").alias("fingerprint"),
        fingerprints.hexadecimal("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness("fp", "edited_fp").alias("near_edited"),
        fingerprints.likeness("fp", "next_fp").alias("near_next"),
    )


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where windows of ten words of ``benchmark`` occur in ``documents``."""
    found = decontamination.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op4_decontaminate"] = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, size, array_to_string(words[k : k + size - 1], ' ') AS phrase
  FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM items WHERE len(words) > 0)
), places AS (
  SELECT row, size, k, array_to_string(words[k : k + size - 1], ' ') AS phrase
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM lowered, (SELECT DISTINCT size FROM phrases) WHERE len(words) >= size)
), found AS (
  SELECT row, p.size, k, item_id FROM places p JOIN phrases q ON p.phrase = q.phrase AND p.size = q.size
), hits AS (
  SELECT row, count(DISTINCT w) AS n FROM (SELECT row, unnest(range(k, k + size)) AS w FROM found) GROUP BY row
), listed AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits h USING (row) LEFT JOIN listed l USING (row)
"""


@query
def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_crf.score(docs, quality_crf.fit(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines"
    )


@query
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` whose fingerprints chain by two or fewer differing bits."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")).select("lang", "text"))
    found = language_id.identify(docs.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of ``documents`` that repeat in another one; a row for each, in the later document."""
    found = substring_dedup.grouped_passages(substring_dedup.repeated_passages(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("b").alias("doc_id"),
        F.col("a").alias("other_doc_id"),
        F.col("begin_b").alias("begin_word"),
        F.col("end_b").alias("end_word"),
        F.col("begin_a").alias("other_begin_word"),
        F.col("end_a").alias("other_end_word"),
        "identity",
        "group_id",
    )


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    options = packing.PackingOptions(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), options)


@query
def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all ``documents``, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return pitman_yor.score_texts(docs)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words that repeat four times or more in every text of ``documents``, repeats planted in a tenth of them."""
    found = periodic_runs.periodic_runs(periodic_runs.plant_repeats(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` shuffled into 16 written shards of equal counts, and read back."""
    found = sharding.sharded(table(spark, sf_dir, "documents"), sharding.ShardOptions(shards=16))
    return found.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language of ``documents`` that most exceed what their parts would have."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM pieces)
), grams AS (
  SELECT lang, m, array_to_string(words[k : k + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS k FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m)
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang
), often AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f FROM grams WHERE f >= 30
), inside AS (
  SELECT lang, array_to_string(w[k : k + s - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, s, unnest(range(1, m - s + 2)) AS k FROM often, (SELECT unnest([2, 3]) AS s) WHERE m > s)
  GROUP BY ALL
), kept AS (
  SELECT o.* FROM often o LEFT JOIN inside i ON o.lang = i.lang AND o.phrase = i.phrase
  WHERE m >= 2 AND (i.longer IS NULL OR CAST(100 AS HUGEINT) * i.longer < CAST(80 AS HUGEINT) * o.f)
), cuts AS (
  SELECT lang, m, phrase, f, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), priced AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, k, CAST(CAST(2000000 AS HUGEINT) * c.f // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN often h ON c.lang = h.lang AND c.head = h.phrase JOIN often t ON c.lang = t.lang AND c.tail = t.phrase
), lowest AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
