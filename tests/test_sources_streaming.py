import os
import time

import pytest
from pyspark.sql import functions as F

from leakscan.operators import allowlist, packs, xref
from leakscan.operators.scan import scan_files
from leakscan.options import MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH, ScanOptions
from leakscan.sources import readers, tree, workspace, writers
from leakscan.streaming import stream

LEAK = "DB_PASS=qwspl@558x"


def _tree(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())


def test_file_tree(spark, tmp_path):
    _tree(tmp_path, {"a/b.txt": LEAK, "win.txt": b"\xff\xfe" + LEAK.encode("utf-16-le"), "big.txt": "x" * 100 + "\n" + LEAK, ".env": "A=1", ".git/x": LEAK, "a/.npmrc": LEAK})
    os.symlink(tmp_path / "win.txt", tmp_path / "link.txt")
    files = readers.read_file_tree(spark, str(tmp_path), "r")
    listed = [".env", "a/.npmrc", "a/b.txt", "big.txt", "win.txt"]
    assert sorted(r["path"] for r in files.collect()) == listed
    assert sorted(r["path"] for r in scan_files(files).collect()) == listed


def test_missing_root_is_an_error(spark, tmp_path):
    _tree(tmp_path, {"file.txt": LEAK})
    for root in ("gone", "file.txt"):
        with pytest.raises(Exception, match="gone|file.txt"):
            readers.read_file_tree(spark, str(tmp_path / root), "r").collect()


def test_reads_are_balanced_by_bytes(spark, tmp_path):
    _tree(tmp_path, {f"d{n % 3}/f{n}.txt": "x" * 1000 for n in range(60)})
    listed = tree.list_tree(spark, str(tmp_path))
    dealt = tree.balanced_by_bytes(listed, 5000)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == 60_000 and len(sizes) >= 6 and max(sizes) <= 20_000


def test_env_files(spark, tmp_path):
    _tree(
        tmp_path,
        {
            "server/.env": "DB_PASSWORD=Sup3rOrangeMonoValue\n",
            "server/.env.example": "DB_PASSWORD=your_db_password\n",
            "node_modules/p/.env": "PKG_SECRET=vendoredOrange1234\n",
            "a/b/c/d/e/.env": "DEEP_TOKEN=deepOrange12345678\n",
            "a/b/c/d/e/f/.env": "TOO_DEEP_TOKEN=tooDeepOrange12345\n",
            "Dist/.env": "X_SECRET=generatedOrange1234\n",
            "big/.env": "X_SECRET=" + "y" * (1024 * 1024) + "\n",
        },
    )
    env = readers.read_dotenv_files(spark, str(tmp_path), "r", MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH)
    assert sorted(r["path"] for r in env.collect()) == ["a/b/c/d/e/.env", "server/.env"]
    assert xref.dotenv_secrets(env).count() == 2
    everything = readers.read_dotenv_files(spark, str(tmp_path), "r")
    assert sorted(r["path"] for r in everything.collect()) == ["a/b/c/d/e/.env", "a/b/c/d/e/f/.env", "big/.env", "server/.env"]
    listed = tree.list_tree(spark, str(tmp_path)).withColumn("repo", F.lit("r"))
    skipped = readers.skipped_dotenv_files(listed, MAX_ENV_FILE_BYTES, MAX_ENV_FILE_DEPTH)
    assert {r["caveat"]: r["n"] for r in skipped.collect()} == {"env file too deep": 1, "env file too large": 1}
    assert readers.skipped_dotenv_files(listed).count() == 0


def test_allowlist_files(spark):
    working = spark.createDataFrame(
        [("r", ".gitleaksignore", "w2"), ("r", ".leakscanignore", "w1"), ("s", ".leakscanignore", "w"), ("r", "sub/.leakscanignore", "no")],
        "repo string, path string, content string",
    )
    staged = spark.createDataFrame([("r", ".leakscanignore", "s1"), ("s", ".leakscanignore", "")], "repo string, path string, content string")
    found = sorted(tuple(r) for r in readers.select_allowlist_texts(working, staged).collect())
    assert found == [("r", 1, "s1"), ("r", 2, "w2")]


def test_rule_packs_from_disk(spark, tmp_path):
    _tree(tmp_path, {"team.json": '{"rules": [\n{"id": "ab", "description": "x", "regex": "x"}]}'})
    loaded = packs.parse_rule_packs(readers.read_rule_packs(spark, str(tmp_path)))
    assert [r.id for r in packs.accepted_rules(loaded, "team.json")] == ["ab"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_writer_lets_no_value_through(spark, tmp_path, fmt):
    findings = scan_files(spark.createDataFrame([("r", "a", LEAK)], "repo string, path string, content string"))
    out = str(tmp_path / fmt)
    writers.write_findings(findings.withColumn("value", F.lit(LEAK)), out, fmt)
    raw = b"".join(p.read_bytes() for p in (tmp_path / fmt).rglob("part-*"))
    assert b"qwspl" not in raw
    back = spark.read.format(fmt).load(out)
    assert back.count() == 1 and "value" not in back.columns


def test_scratch_tables_are_deleted(spark):
    kept = workspace.materialise(spark.range(3))
    with workspace.scratch(spark):
        gone = workspace.materialise(spark.range(4))
        assert gone.count() == 4
        (path,) = {os.path.dirname(f).removeprefix("file://") for f in gone.inputFiles()}
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_checkpoint_folder_comes_from_the_session(spark):
    assert workspace.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _arriving(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_scan_and_gate(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "change_set string, repo string, path string, status string, content string"
    _arriving(spark, folder, [("c1", "r", "a.txt", "A", LEAK), ("c1", "r", "b.txt", "D", LEAK), ("c2", "r", "a.txt", "M", "x")], schema)
    source = spark.readStream.schema(schema).parquet(folder)
    out = str(tmp_path / "out")
    running = stream.stream_scan(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    running.awaitTermination()
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["a.txt", "b.txt"]

    decided = str(tmp_path / "decided")

    def run():
        writer = stream.stream_gate(source, lambda rows, n: rows.write.mode("append").parquet(decided))
        writer.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()

    run()
    _arriving(spark, folder, [("c3", "r", ".env", "A", None)], schema)
    run()
    found = {r["change_set"]: (r["findings"], r["exit_code"]) for r in spark.read.parquet(decided).collect()}
    assert found == {"c1": (1, 1), "c2": (0, 0), "c3": (1, 1)}


def test_gate_with_allowlist_and_env_values_over_batches(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "change_set string, repo string, path string, status string, content string"
    value = "Sup3rOrangeMonoValue"
    parts = [
        [("c1", "r", "a.txt", "A", "x"), ("c2", "r", "fixtures/a.txt", "A", LEAK), ("c2", "s", "b.txt", "A", f"k={value}")],
        [("c1", "r", "b.txt", "A", f"it is '{value}'"), ("c3", "s", "fixtures/a.txt", "A", LEAK)],
        [("c1", "r", "c.txt", "A", "clean after all"), (None, "r", "c.txt", "A", "x")],
    ]
    secrets = spark.createDataFrame([("r", "1", value)], "repo string, ord string, value string")
    entries = allowlist.parse_allowlist(spark.createDataFrame([("r", 1, "^fixtures/")], "repo string, ord int, text string"))
    decisions = {}
    for part in parts:
        _arriving(spark, folder, part, schema)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        writer = stream.stream_gate(
            source, lambda rows, n: decisions.update({(n, r["change_set"]): r["findings"] for r in rows.collect()}),
            secrets=secrets, allowlist=entries,
        )
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert decisions == {(0, "c1"): 0, (0, "c2"): 0, (1, "c1"): 1, (1, "c3"): 1, (2, "c1"): 1, (2, None): 0}


def test_gate_decides_again_alike_and_forgets(spark, tmp_path):
    """A batch whose commit is lost is run again with the counts before it; its cost doesn't depend on earlier ones."""
    folder, schema = str(tmp_path / "in"), "change_set long, repo string, path string, status string, content string"
    seen = []

    def run(checkpoint, **more):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        writer = stream.stream_gate(source, lambda rows, n: seen.append((n, sorted((r["change_set"], r["findings"]) for r in rows.collect()))), **more)
        query = writer.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    for n in range(3):
        _arriving(spark, folder, [(7, "r", f"f{n}.txt", "A", LEAK), (n, "r", "x", "A", "clean")], schema)
        query = run("cp")
    assert seen == [(0, [(0, 0), (7, 1)]), (1, [(1, 0), (7, 2)]), (2, [(2, 0), (7, 3)])]
    assert query.lastProgress["numInputRows"] == 4  # two rows, read for their names and for their content
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "cp" / "commits" / name)
    seen.clear()
    run("cp")
    assert seen == [(2, [(2, 0), (7, 3)])]


def test_gate_forgets_change_sets_that_bring_nothing(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "change_set long, repo string, path string, status string, content string"
    seen = {}
    _arriving(spark, folder, [(7, "r", "f.txt", "A", LEAK)], schema)
    source = spark.readStream.schema(schema).parquet(folder)
    writer = stream.stream_gate(source, lambda rows, n: seen.update({(n, r["change_set"]): r["findings"] for r in rows.collect()}), keep_ms=1)
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for wanted in (1, 2):
            until = time.time() + 60
            while len(seen) < wanted and time.time() < until:
                time.sleep(0.5)
            time.sleep(3)  # batches without rows, in which the time runs out
            _arriving(spark, folder, [(7, "r", f"g{wanted}.txt", "A", LEAK)], schema)
    finally:
        query.stop()
    assert list(seen.values())[:2] == [1, 1]


def test_stream_with_more_values_than_are_sent_to_tasks(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "repo string, path string, content string"
    value = "Sup3rOrangeMonoValue"
    secrets = spark.createDataFrame([("r", f"{k:05}", f"{value}{k}") for k in range(500)], "repo string, ord string, value string")
    options = ScanOptions(broadcast_limit_bytes=0)
    for n in range(2):
        _arriving(spark, folder, [("r", f"a{n}", f"x\n{value}{n + 3} {value}{n + 1}"), ("s", f"a{n}", f"{value}3"), ("r", f"b{n}", f"{value}{n}0000")], schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    found = stream.stream_scan(source, options, secrets=secrets)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r["path"], r["line"]) for r in spark.read.parquet(out).where("rule_ord = 10").collect()) == [("a0", 2), ("a1", 2)]


def test_stream_first_seen_and_introduced(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "repo string, blob string, path string, seen timestamp, commit_index long, status string, new_mode string"
    rows = spark.range(40).select(
        F.lit("r").alias("repo"), F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("blob"), F.lit("p").alias("path"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id")).alias("seen"), (100 - F.col("id")).alias("commit_index"),
        F.lit("M").alias("status"), F.lit("100644").alias("new_mode"),
    )
    deleted = rows.limit(1).withColumns({"blob": F.lit("gone"), "status": F.lit("D")})
    rows = rows.unionByName(deleted)
    for part in range(2):
        rows.where(F.col("commit_index") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    once = stream.first_seen(source, "1 day").select("repo", "blob", "path")
    once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 4

    updates = str(tmp_path / "updates")
    stream.introduced_so_far(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(
        availableNow=True
    ).foreachBatch(lambda batch, n: batch.write.mode("append").parquet(updates)).start().awaitTermination()
    first = spark.read.parquet(updates).groupBy("blob").agg(F.min("commit_index").alias("c"))
    assert {r["blob"]: r["c"] for r in first.collect()} == {"b0": 64, "b1": 63, "b2": 62, "b3": 61}


def test_tasks_write_a_tree_in_place(spark, tmp_path):
    """Each task writes one file for each folder of which it has lines; nothing is left to move or to clean up."""
    from leakscan.sources.tree import list_tree, write_tree

    lines = [(f"r=a b/k={k % 30}", None if k == 7 else f"é{k}") for k in range(90)]
    write_tree(spark.createDataFrame(lines, "folder string, line string").coalesce(1), f"{tmp_path}/tree")
    found = {p.parent.relative_to(tmp_path / "tree").as_posix(): p.read_text() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
    assert found == {f"r=a b/k={k}": "".join(f"{'' if n == 7 else f'é{n}'}\n" for n in range(k, 90, 30)) for k in range(30)}
    write_tree(spark.createDataFrame(lines, "folder string, line string").repartition(3), f"{tmp_path}/more")
    several = list_tree(spark, f"{tmp_path}/more").collect()
    assert len(several) == len({r["path"] for r in several}) > 30 and sum(r["length"] for r in several) == sum(len(t.encode()) for t in found.values())


def test_logs_are_built_in_one_exchange(spark):
    """All changes of a part are put together where they are dealt to, with their hashes as bytes."""
    from leakscan import queries

    rows = [("r", 5, "ab" * 20, 9, k, "100644", "0c" * 20, "M", k, f"p{k}") for k in range(3)]
    logs = queries._raw_logs(spark.createDataFrame(rows, "repo string, commit_index long, commit_sha string, epoch long, seq long, new_mode string, blob string, status string, pick long, path string"))
    assert logs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    (row,) = logs.collect()
    assert row["part"] == 0 and row["log"].count("ab" * 20) == 2 and row["log"].count("0c" * 20) == 3
