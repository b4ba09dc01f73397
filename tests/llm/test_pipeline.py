"""The queries and the pipeline over one small set of tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leakscan.llm import simhash_dedup
from tests.llm.helpers import ODD, upper, words
from tests.llm.test_counts_and_packing import check_packing
from tests.llm.test_dedup import brute_fingerprint

PASSAGE = words(900, 60)
ITEM = words(901, 30)
COPY = words(902, 300)


def corpus():
    clean = [(100 + k, words(k, 40 + k % 60)) for k in range(60)]
    planted = [
        (200, f"{words(70, 80)} {PASSAGE} {words(71, 40)}"),
        (201, f"{words(72, 50)} {upper(PASSAGE)} {words(73, 90)}"),
        (210, f"{words(74, 80)}, {ITEM.replace(' ', ', ')}. {words(75, 20)}"),
        (220, COPY),
        (221, COPY.replace(" ", "  ")),
        (222, COPY),
    ]
    return clean + planted + [(i, t) for i, t in ODD if i is not None and i != 8]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, ["aa", "bb"][i % 2], f"src{i % 3}", len(t or "")) for i, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, words(902_000, 12)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in corpus()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in corpus()], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


CONTRACT = {
    "op1_warc_chunks": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_token_count": "doc_id n_bytes n_tokens over_limit",
    "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_quality_crf": "doc_id held_out score predicted",
    "op6_simhash_dedup": "doc_id fingerprint component_id",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op10_pitman_yor": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_a_row_per_input_row(spark, tables, name):
    found = entry.queries()[name](spark, tables)
    assert set(CONTRACT[name].split()) <= set(found.columns)
    key = found.columns[0]
    assert sorted(r[key] for r in found.select(key).collect()) == sorted(i for i, _ in corpus())


@pytest.mark.parametrize("name,folds,left", [("op5_quality_crf", 5, 0), ("op7_language_id", 3, 1), ("op10_pitman_yor", 7, 2)])
def test_held_out_rows(spark, tables, name, folds, left):
    for r in entry.queries()[name](spark, tables).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == left)


def test_packing_query(spark, tables):
    check_packing(entry.queries()["op9_best_fit_packing"](spark, tables).collect(), corpus(), 2048)


def test_passage_query(spark, tables):
    found = entry.queries()["op8_substring_dedup"](spark, tables).collect()
    assert {(r["other_doc_id"], r["doc_id"]) for r in found} >= {(200, 201), (220, 221), (220, 222)}
    assert {r["doc_id"] for r in found} <= {201, 9, 221, 222}


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, own, seen = docs.columns, {i: t for i, t in corpus()}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tables}/stage-{name}"
        stage(spark, docs, tables).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in seen.items()}
    assert set(own) - set(ids["language_id"]) >= {2, 3, 4, 5}
    assert set(own) - set(ids["language_id"]) <= {2, 3, 4, 5, 7, 10, 1}

    prints = {i: brute_fingerprint(own[i]) for i in ids["language_id"]}
    dropped = {i for i in prints for j in prints if j < i and (prints[i] ^ prints[j]).bit_count() <= 2}
    assert ids["simhash_dedup"] == sorted(set(prints) - dropped)

    cut = {r["doc_id"]: r for r in seen["substring_dedup"].collect()}
    assert set(cut) == set(ids["simhash_dedup"])
    assert PASSAGE in cut[200]["text"] and upper(PASSAGE) not in cut[201]["text"] and cut[201]["text"].startswith(words(72, 50))
    assert all(cut[i]["text"] == own[i] for i in cut if i != 201)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())

    assert ids["decontamination"] == sorted(set(cut) - {210})
    kept = [(r["doc_id"], r["text"]) for r in seen["decontamination"].collect()]
    check_packing(seen["best_fit_packing"].collect(), kept, 2048)


def test_run_equals_its_stages(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    check = found.groupBy().agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
    last = spark.read.parquet(f"{tables}/stage-best_fit_packing").groupBy().agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
    assert tuple(check) == tuple(last) and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in [n for n in entry.queries() if n.startswith("op") and "_" in n and n[2].isdigit()] + ["pipeline"]:
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_fingerprints_are_the_operator_s(spark, tables):
    found = {r["doc_id"]: r["fingerprint"] for r in entry.queries()["op6_simhash_dedup"](spark, tables).collect()}
    assert found == {i: f"{brute_fingerprint(t):016x}" for i, t in corpus()}
    assert simhash_dedup.majority(simhash_dedup.shingle_hashes(b"")) == 0
