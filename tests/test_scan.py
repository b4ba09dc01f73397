import pytest
from pyspark.sql import functions as F

from leakscan.operators.scan import scan_files, scan_texts
from leakscan.operators.yaml_windows import secret_data_lines
from leakscan.functions.text import split_lines
from leakscan.options import ScanOptions
from scan_cases import CASES, GENERIC, MANIFESTS


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


@pytest.fixture(scope="module")
def case_findings(spark):
    rows = [(str(n), path, text) for n, (path, text, _, _) in enumerate(CASES)]
    found = {}
    for r in scan_texts(_files(spark, rows)).collect():
        found.setdefault(int(r["repo"]), []).append(r["rule_id"])
    return found


@pytest.mark.parametrize("n", range(len(CASES)), ids=lambda n: f"{n}:{CASES[n][0]}")
def test_case(case_findings, n):
    _, text, must, must_not = CASES[n]
    found = case_findings.get(n, [])
    if must is None:
        assert found == [], text
    else:
        assert must <= set(found), text
        assert not must_not & set(found), text
    assert found.count(GENERIC) <= 1


def test_manifest_lines(spark):
    rows = [(str(n), "m.yaml", text) for n, (text, _) in enumerate(MANIFESTS)]
    findings = scan_texts(_files(spark, rows)).where("rule_id = 'k8s-secret-data'")
    found = {}
    for r in findings.collect():
        found.setdefault(int(r["repo"]), []).append(r["line"])
    for n, (text, lines) in enumerate(MANIFESTS):
        assert sorted(found.get(n, [])) == lines, text


def test_manifest_windows_agree(spark):
    rows = [(str(n), "m.yaml", text) for n, (text, _) in enumerate(MANIFESTS)]
    lines = _files(spark, rows).select("repo", F.posexplode(split_lines(F.col("content"))).alias("n", "text"))
    lines = lines.select("repo", (F.col("n") + 1).alias("line"), "text")
    found = {}
    for r in secret_data_lines(lines, ["repo"]).collect():
        found.setdefault(int(r["repo"]), []).append(r["line"])
    for n, (text, expected) in enumerate(MANIFESTS):
        marked = [i for i, l in enumerate(text.split("\n"), 1) if "allow" in l]
        assert sorted(set(found.get(n, [])) - set(marked)) == expected, text


def test_file_rules_and_null_content(spark):
    rows = [
        ("r", ".env", None),
        ("r", "app/.env.production", "X=1"),
        ("r", ".env.local.example", "PASSWORD=hunter2secret"),
        ("r", "deploy/id_rsa", None),
        ("r", "cert.P12", "x"),
        ("r", "src/app.js", None),
    ]
    found = {(r["path"], r["line"], r["rule_id"]) for r in scan_files(_files(spark, rows)).collect()}
    assert found == {
        (".env", 0, "secret-file-env"),
        ("app/.env.production", 0, "secret-file-env"),
        ("deploy/id_rsa", 0, "secret-file"),
        ("cert.P12", 0, "secret-file"),
    }


def test_template_keeps_provider_rules(spark):
    token = "gh" + "p_" + "a" * 36
    found = scan_files(_files(spark, [("r", ".env.example", f"GITHUB_TOKEN={token}")])).collect()
    assert [r["rule_id"] for r in found] == ["github-pat"]


def test_options(spark):
    df = _files(spark, [("r", "dist/a.js", 'password = "orange7secret" // leakscan:allow')])
    assert scan_texts(df).count() == 0
    both = ScanOptions(default_excludes=False, ignore_inline_allow=True)
    assert scan_texts(df, both).count() == 1
    assert scan_texts(df, ScanOptions(default_excludes=False, ignore_inline_allow=True, generic=False)).count() == 0
    other = ScanOptions(default_excludes=False, inline_markers=("othertool",))
    assert scan_texts(df, other).count() == 1


def test_binary_text_skips_entropy_only(spark):
    token = "Yx8Lq3nVcM6qKwS5uXbTeGhIkMlQpJvZ"
    rows = [("nul", "a", f"x = '{token}'\0 password=orange7secret"), ("ctl", "a", f"{token}" + "\x01" * 20), ("ok", "a", token)]
    found = {(r["repo"], r["rule_id"]) for r in scan_texts(_files(spark, rows)).collect()}
    assert found == {("nul", GENERIC), ("ok", "high-entropy-string")}


def test_line_numbers_and_mixed_line_ends(spark):
    text = "a\r\npassword=orange7secret\n\nb\r\rpassword=orange8secret\r\npassword=orange9secret"
    lines = sorted(r["line"] for r in scan_texts(_files(spark, [("r", "a.txt", text)])).collect())
    assert lines == [2, 4, 5]


def test_result_does_not_depend_on_partitioning(spark):
    rows = [(str(n), p, t) for n, (p, t, _, _) in enumerate(CASES)]
    one = scan_texts(_files(spark, rows).coalesce(1)).collect()
    many = scan_texts(_files(spark, rows).repartition(13)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_findings_carry_no_text(spark):
    columns = scan_files(_files(spark, [("r", "a", "x")])).columns
    assert columns == ["repo", "path", "line", "rule_id", "description", "rule_ord"]
