"""Shards: all rows once, equal counts, gapless slots, a uniform order that a seed fixes."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leakscan.llm import sharding
from tests.llm.helpers import ODD, documents, words

SMALL = sharding.ShardOptions(shards=5, bucket_bytes=4000, batch_bytes=900)
TEXTS = [(k, words(k, 1 + k % 40)) for k in range(400)]


def check(rows, texts, shards):
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(texts)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


@pytest.mark.parametrize(
    "texts",
    [TEXTS, ODD, [], TEXTS[:3], [(7, "copy")] * 300 + TEXTS[:100], [(None, None)] * 40, [(1, "x" * 100_000), *TEXTS[:50]]],
)
def test_every_row_has_a_place(spark, texts):
    docs = documents(spark, texts, shard="mine", slot="own", bucket="b", tie=1, size=None, **{"a.b`c": 5})
    found = sharding.sharded(docs, SMALL)
    assert set(found.columns) == set(docs.columns)
    rows = found.collect()
    check(rows, texts, SMALL.shards)
    assert all(r["bucket"] == "b" and r["hash"] == 2 and r["a.b`c"] == 5 for r in rows)


def places(df):
    return {r["doc_id"]: (r["shard"], r["slot"]) for r in df.collect()}


def test_the_seed_and_the_ids_fix_the_order(spark):
    docs = documents(spark, TEXTS)
    found = places(sharding.shuffled(docs, SMALL))
    assert found == places(sharding.shuffled(docs.repartition(7, F.rand(3)), SMALL))
    assert found != places(sharding.shuffled(docs, sharding.ShardOptions(5, 2, 4000, 900)))


def test_files_are_in_order_of_slots(spark, tmp_path):
    path = sharding.write_shards(documents(spark, TEXTS), f"{tmp_path}/shards", SMALL)
    rows = spark.read.parquet(path).select("shard", "slot", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at")).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append((r["at"], r["slot"], r["shard"]))
    assert len(by_file) > SMALL.shards
    for found in by_file.values():
        slots = [s for _, s, _ in sorted(found)]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len({k for *_, k in found}) == 1


def test_fisher_yates_is_uniform():
    found = Counter(tuple(sharding.fisher_yates(4, (1, k)).tolist()) for k in range(24_000))
    assert len(found) == 24
    assert sum((n - 1000) ** 2 / 1000 for n in found.values()) < 60  # 23 degrees of freedom
    assert sharding.fisher_yates(0, (1,)).tolist() == [] and sharding.fisher_yates(1, (1,)).tolist() == [0]


def test_the_whole_order_is_uniform(spark):
    """Neither ids nor equal texts stay together, and every id is as likely in any fifth."""
    docs = documents(spark, [(k, "same") for k in range(2000)])
    seen = np.zeros((2, 5))
    for seed in range(4):
        for doc, (shard, _) in places(sharding.shuffled(docs, sharding.ShardOptions(5, seed, 1500, 900))).items():
            seen[doc % 1000 // 500, shard] += 1
    assert abs(seen - 800).max() < 110


def test_query(spark, tmp_path):
    documents(spark, [*TEXTS, *ODD]).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["op12_shards"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [*TEXTS, *ODD])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
