import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leakscan.operators import allowlist, history, report
from leakscan.options import MAX_BLOB_BYTES, ScanOptions
from leakscan.plans.history_scan import blob_hits, scan_history, wanted_blobs
from leakscan.sources.raw_log import parse_raw_log

LEAK = b"DB_PASS=qwspl@558x\n"
CHANGES = (
    "repo string, commit_index long, commit_sha string, commit_time timestamp, seq long, status string, "
    "new_mode string, blob string, path string"
)
BLOBS = "repo string, blob string, size long, content binary"


def _time(year):
    return dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc)


def _change(index, path, blob, year=2020, status="A", mode="100644", seq=0, repo="r"):
    return (repo, index, f"{index:040d}", _time(year), seq, status, mode, blob, path)


def _tables(spark, changes, blobs, head=()):
    return (
        spark.createDataFrame(changes, CHANGES),
        spark.createDataFrame([(b[0] if len(b) == 4 else "r", *b[-3:]) for b in blobs], BLOBS),
        spark.createDataFrame(list(head), "repo string, blob string, path string"),
    )


def _ids(result):
    return sorted((r["path"], r["line"], r["rule_id"], r["commit_index"], r["in_head"]) for r in result.findings.collect())


def test_versions_follow_ancestry_not_clocks(spark):
    changes, blobs, head = _tables(
        spark,
        [
            _change(0, "cfg.txt", "b1", 2020),
            _change(1, "cfg.txt", "b1", 2030, status="D"),
            _change(2, "cfg.txt", "b1", 2001),
            _change(2, "link", "b1", 2001, mode="120000", seq=1),
            _change(2, "sub", "b9", 2001, mode="160000", seq=2),
            _change(3, "cfg.txt", "0" * 40, 2002),
        ],
        [("b1", len(LEAK), LEAK)],
        [("r", "b1", "link")],
    )
    result = scan_history(changes, blobs, head)
    rule = "generic-secret-assignment"
    assert _ids(result) == [("cfg.txt", 1, rule, 0, False), ("link", 1, rule, 2, True)]
    row = result.coverage.first()
    assert (row["commits"], row["versions"], row["scanned"], row["findings"], row["commits_with_findings"]) == (4, 2, 2, 2, 2)


def test_one_content_at_many_paths_is_judged_by_each_path(spark):
    text = b"password = hunter_value\nk = 'Yx8Lq3nVcM6qKwS5uXbTeGhIkMlQpJvZ'\n"
    paths = ["a.py", "a.yml", "docs/a.yml", ".env.example", ".env"]
    changes, blobs, head = _tables(spark, [_change(n, p, "b") for n, p in enumerate(paths)], [("b", len(text), text)])
    found = {}
    for path, line, rule, _, _ in _ids(scan_history(changes, blobs, head)):
        found.setdefault(path, []).append((line, rule))
    generic, entropy = (1, "generic-secret-assignment"), (2, "high-entropy-string")
    assert found == {"a.py": [entropy], "a.yml": [generic, entropy], ".env": [(0, "secret-file-env"), generic, entropy]}


def test_nothing_is_skipped_silently(spark):
    cap = MAX_BLOB_BYTES
    limited = ScanOptions(max_blob_bytes=cap)
    changes, blobs, head = _tables(
        spark,
        [_change(0, "dump.sql", "big"), _change(0, "a", "ok"), _change(1, "gone", "missing"), _change(1, "unread", "null"),
         _change(2, "fixtures/x", "big2"), _change(3, ".env", "missing")],
        [("big", cap + 1, None), ("ok", cap, b"x"), ("null", 5, None), ("big2", cap + 1, None)],
    )
    entries = allowlist.parse_allowlist(spark.createDataFrame([("r", 1, "^fixtures/")], "repo string, ord int, text string"))
    result = scan_history(changes, blobs, head, limited, allowlist=entries)
    status = {r["path"]: r["status"] for r in result.versions.collect()}
    assert status == {"dump.sql": "oversized", "a": "scan", "gone": "unavailable", "unread": "unavailable",
                      "fixtures/x": "allowlisted", ".env": "unavailable"}
    assert result.findings.count() == 0
    shallow = spark.createDataFrame([("r", True)], "repo string, shallow boolean")
    caveats = {r["caveat"]: r["n"] for r in report.caveats(result.coverage, shallow=shallow).collect()}
    assert caveats == {"allowlisted": 1, "oversized": 1, "unavailable": 3, "shallow": 1}
    errors = spark.createDataFrame([("p", "rule 1", "not an object")], "pack string, where string, reason string")
    known = scan_history(changes, blobs, head, limited, allowlist=entries, rule_errors=errors, shallow=shallow)
    assert {r["caveat"]: r["n"] for r in known.caveats.collect()} == {**caveats, "invalid rules": 1}
    assert [r["position"] for r in known.oversized.collect()] == [1]
    label = report.top_oversized(result.versions).first()
    assert label["label"] == f"dump.sql @ {'0' * 12} (10.0 MB)" and label["more"] == 0
    audit = scan_history(changes, blobs, head, limited, allowlist=entries, use_allowlist=False)
    assert {r["path"] for r in audit.versions.where("status = 'oversized'").collect()} == {"dump.sql", "fixtures/x"}


def test_without_a_limit_every_size_is_scanned(spark):
    changes, blobs, head = _tables(spark, [_change(0, "a.txt", "big")], [("big", MAX_BLOB_BYTES + 1, LEAK)])
    result = scan_history(changes, blobs, head)
    assert result.findings.count() == 1 and result.versions.where("status = 'oversized'").count() == 0


def test_unreferenced_blobs_are_not_scanned(spark):
    rows = [("used", 9, LEAK), ("hidden", 9, LEAK)] + [(f"free{n}", 9, LEAK) for n in range(50)]
    changes, blobs, head = _tables(spark, [_change(0, "a.txt", "used"), _change(1, "fixtures/x", "hidden")], rows)
    entries = allowlist.parse_allowlist(spark.createDataFrame([("r", 1, "^fixtures/")], "repo string, ord int, text string"))
    versions = history.introduce_versions(changes)
    flagged = allowlist.flag_allowlisted(versions, entries)
    for options in (ScanOptions(), ScanOptions(broadcast_limit_bytes=0)):
        wanted = wanted_blobs(flagged, blobs, options)
        assert [r["blob"] for r in wanted.collect()] == ["used"]
        hits = blob_hits(wanted, options)
        assert {r["blob"] for r in hits.collect()} == {"used"}
        assert scan_history(changes, blobs, head, options, allowlist=entries).findings.count() == 1


def test_audit_ignores_inline_markers(spark):
    text = LEAK.strip() + b" # leakscan:allow\n"
    changes, blobs, head = _tables(spark, [_change(0, "a.txt", "b")], [("b", len(text), text)])
    assert scan_history(changes, blobs, head).findings.count() == 0
    assert scan_history(changes, blobs, head, use_allowlist=False).findings.count() == 1


def test_a_blob_shared_by_most_paths_is_complete(spark):
    paths = [(n, f"d{n}/x.txt", "hot" if n % 3 else f"b{n}") for n in range(600)]
    blobs = [("hot", len(LEAK), LEAK)] + [(f"b{n}", 1, b"x") for n in range(0, 600, 3)]
    changes, blobs, head = _tables(spark, [_change(n, p, b) for n, p, b in paths], blobs)
    result = scan_history(changes, blobs, head, ScanOptions(hot_rows=20, salt_buckets=5))
    assert result.findings.count() == 400
    assert result.versions.count() == 600


def test_env_values_in_history(spark):
    text = b'x\nk = "Sup3rOrangeMonoValue"'
    changes, blobs, head = _tables(spark, [_change(0, "a.txt", "b")], [("b", len(text), text)])
    secrets = spark.createDataFrame([("r", "1", "Sup3rOrangeMonoValue")], "repo string, ord string, value string")
    for options in (ScanOptions(), ScanOptions(broadcast_limit_bytes=0)):
        assert _ids(scan_history(changes, blobs, head, options, secrets=secrets)) == [("a.txt", 2, "hardcoded-dotenv-secret", 0, False)]


def test_reports_by_commit(spark):
    changes, blobs, head = _tables(
        spark, [_change(0, "a.txt", "b", 2021), _change(1, ".env", "b", 2022)], [("b", len(LEAK), LEAK)], [("r", "b", ".env")]
    )
    findings = scan_history(changes, blobs, head).findings
    rows = {r["commit_index"]: r for r in report.findings_by_commit(findings).collect()}
    assert (rows[0]["date"], rows[0]["findings"], rows[0]["still_in_head"]) == ("2021-01-01", 1, 0)
    assert (rows[1]["date"], rows[1]["findings"], rows[1]["files"], rows[1]["still_in_head"]) == ("2022-01-01", 2, 1, 2)
    texts = [r["text"] for r in report.commit_lines(report.order_findings(findings)).collect()]
    assert texts[0].startswith("a.txt:1  [generic-secret-assignment]")
    assert texts[1] == ".env  [secret-file-env] .env file (may contain secrets)  (still in HEAD)"


def test_order_is_by_commit_then_locale_then_line(spark):
    rows = [("r", 0, "B.txt", 1, 1), ("r", 0, "a.txt", 2, 1), ("r", 0, "a.txt", 1, 9), ("r", 0, "a.txt", 1, 2), ("r", 1, "A.txt", 1, 1)]
    df = spark.createDataFrame(rows, "repo string, commit_index long, path string, line int, rule_ord int")
    ordered = [tuple(r)[1:] for r in report.order_findings(df).collect()]
    assert ordered == [(0, "a.txt", 1, 2), (0, "a.txt", 1, 9), (0, "a.txt", 2, 1), (0, "B.txt", 1, 1), (1, "A.txt", 1, 1)]


def _log(*items):
    return "\0".join(items) + "\0"


def _meta(blob, status="A", mode="100644"):
    return f":000000 {mode} {'0' * 40} {blob} {status}"


def test_raw_log_paths_and_merges(spark):
    crafted = "we\x01ird\nname ünïcode.txt"
    parts = [
        ("r", 0, _log("junk", "\x01s1 1600000000", "\n" + _meta("b1"), crafted, _meta("b2"), ":colon", "\x01s2 1500000000",
                      _meta("b3"), "\x01like-a-header 5")),
        ("r", 1, _log("\x01s2 1500000000", _meta("b4"), "after", "\x01s3 1700000000", "\x01s1 1600000000", _meta("b5"), "again")),
        ("q", 0, _log("\x01s9 1", _meta("b9"), "p") + ":dangling"),
    ]
    commits, changes = parse_raw_log(spark.createDataFrame(parts, "repo string, part int, log string"))
    found = sorted((r["repo"], r["commit_index"], r["commit_sha"], r["blob"], r["path"]) for r in changes.collect())
    assert found == [
        ("q", 0, "s9", "b9", "p"),
        ("r", 0, "s1", "b1", crafted),
        ("r", 0, "s1", "b2", ":colon"),
        ("r", 1, "s2", "b3", "\x01like-a-header 5"),
        ("r", 1, "s2", "b4", "after"),
        ("r", 3, "s1", "b5", "again"),
    ]
    listed = sorted((r["repo"], r["commit_index"], r["commit_sha"]) for r in commits.collect())
    assert listed == [("q", 0, "s9"), ("r", 0, "s1"), ("r", 1, "s2"), ("r", 2, "s3"), ("r", 3, "s1")]
    versions = history.introduce_versions(changes).where("repo = 'r'")
    assert versions.count() == 5


def test_records_before_a_header_are_an_error(spark):
    parts = [("r", 0, _log(_meta("x"), "whose?")), ("r", 1, _log("\x01s1 1", _meta("b1"), "a"))]
    with pytest.raises(Exception, match="does not begin with a commit header: r 0"):
        parse_raw_log(spark.createDataFrame(parts, "repo string, part int, log string"))[1].collect()


def _walk(log):
    """One log, token by token: (commit number, sha, epoch, new mode, blob, status, path) of each change, and the commits."""
    tokens, commits, changes, k = log.split("\0"), [], [], 0
    while k < len(tokens):
        entry = tokens[k].lstrip("\n")
        if entry.startswith("\x01"):
            words = entry[1:].split(" ")
            if not commits or commits[-1][0] != words[0]:
                commits.append((words[0], int(words[1])))
        elif entry.startswith(":") and k + 1 < len(tokens):
            words = entry[1:].split(" ")
            changes.append((len(commits) - 1, *commits[-1], words[1], words[3], words[4], tokens[k + 1]))
            k += 1
        k += 1
    return commits, changes


def _any_log(rng):
    log = "\x01first 1\0"
    for n in range(rng.randrange(1, 25)):
        kind = rng.randrange(6)
        if kind == 0:
            log += f"\n\x01s{(sha := rng.randrange(4))} {sha * 10**8}\0"  # a commit has one time
        elif kind == 1:
            log += rng.choice(["", "\n", "junk", "é漢\n"]) + "\0"
        else:
            log += "\n" * rng.randrange(2) + f":100644 100755 aa b{n} {rng.choice('AMD')}\0"
            log += rng.choice(["p", "dir/x.txt", ":100644 1 2 3 4", "\n:y", "\x01s1 5", "", "😀 q", "\n"]) + "\0"
    return log if rng.randrange(3) else log + rng.choice([":1 2 3 4 5", "tail", ":1 2 3 4 5\0", ":1 2 3 4 5\0open"])


@pytest.mark.parametrize("longest", [1, 3, 40])
def test_logs_may_be_cut_anywhere(spark, longest):
    rng = random.Random(longest)
    rows, expected, listed = [], [], []
    for repo in range(60):
        log, at, part = _any_log(rng), 0, 0
        commits, changes = _walk(log)
        expected += [(f"r{repo}", *c) for c in changes]
        listed += [(f"r{repo}", k, sha) for k, (sha, _) in enumerate(commits)]
        while at < len(log):
            size = rng.randrange(0, longest + 1)
            rows.append((f"r{repo}", part, log[at : at + size]))
            at, part = at + size, part + rng.randrange(1, 3)
    frame = spark.createDataFrame(rows, "repo string, part int, log string").repartition(5)
    commits, changes = parse_raw_log(frame)
    found = changes.select("repo", "commit_index", "commit_sha", F.unix_seconds("commit_time"), "new_mode", "blob", "status", "path", "seq").collect()
    assert sorted(tuple(r)[:8] for r in found) == sorted(expected)
    # In order of place they are as they stand in the log.
    assert [tuple(r)[:8] for r in sorted(found, key=lambda r: (int(r["repo"][1:]), r["seq"]))] == expected
    assert sorted(map(tuple, commits.select("repo", "commit_index", "commit_sha").collect())) == sorted(listed)


def test_an_empty_table_of_logs(spark):
    commits, changes = parse_raw_log(spark.createDataFrame([], "repo string, part int, log string"))
    assert commits.count() == changes.count() == 0
    commits, changes = parse_raw_log(spark.createDataFrame([("r", 0, ""), ("s", 0, None)], "repo string, part int, log string"))
    assert commits.count() == changes.count() == 0


def test_unchanged_file_is_one_version(spark):
    changes = spark.createDataFrame(
        [_change(0, "constant", "c")] + [_change(n, "counter", f"b{n}") for n in range(5)] + [_change(4, "constant", "c")], CHANGES
    )
    versions = history.introduce_versions(changes)
    assert versions.count() == 6
    assert history.distinct_blobs(versions).agg(F.sum("paths")).first()[0] == 6


def test_derived_blobs_are_hashed_late_and_made_distinct_once(spark, tmp_path):
    from dataclasses import replace

    from leakscan import corpora, queries

    rows = [(k % 45, k % 7, k % 60, float(k % 50 + 1)) for k in range(600)] + [(None, 1, None, 2.0), (3, None, 5, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double")
    late = corpora.planted_blobs.of(lines)
    early = replace(corpora.planted_blobs, lazy=()).of(lines)
    assert late.schema == early.schema and late.exceptAll(early).isEmpty() and early.exceptAll(late).isEmpty()
    # A hash of each row for its name; those of its content stand inside the cases only.
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert all(" AS h#" not in line and " AS a#" not in line for line in plan.splitlines())
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    blobs = queries._blobs(spark, str(tmp_path))
    assert "Aggregate" not in blobs._jdf.queryExecution().optimizedPlan().toString()
    assert blobs.count() == early.where("kind <> 5").distinct().count()


def test_versions_are_grouped_by_a_hash_first(spark):
    schema = "repo string, blob string, path string, commit_index long, seq long, commit_sha string, commit_time timestamp, status string, new_mode string"
    rows = [("r", "b", f"p{k % 3}", 9 - k, k, f"c{k}", None, "M", "100644") for k in range(9)] + [(None, "b", None, 1, 1, "x", None, "A", "100644")] * 2
    versions = history.introduce_versions(spark.createDataFrame(rows, schema))
    assert sorted((r["path"], r["commit_index"], r["commit_sha"]) for r in versions.where("repo = 'r'").collect()) == [("p0", 3, "c6"), ("p1", 2, "c7"), ("p2", 1, "c8")]
    assert versions.count() == 4
    plan = versions._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64" in plan or "hashpartitioning(_groupingexpression" in plan
