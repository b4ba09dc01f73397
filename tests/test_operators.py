import json
import random
import re

import pytest
from pyspark.sql import functions as F

from leakscan.operators import allowlist, packs, path_index, report, xref
from leakscan.operators.lookup import attach, fits_broadcast, hot_salted_join, salted_join
from leakscan.operators.scan import scan_coverage, scan_files, scan_texts
from leakscan.options import ScanOptions
from leakscan.plans.change_set import gate_decision, scan_change_set

QUANTIFIER = "+"
RUNAWAY = f"(a{QUANTIFIER}){QUANTIFIER}$"
LEAK = "DB_PASS=qwspl@558x"


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def _pack(spark, text, name="p"):
    return packs.parse_rule_packs(spark.createDataFrame([(name, text)], "pack string, text string"))


# --- rule packs --------------------------------------------------------------


def test_good_pack_scans_next_to_built_in_rules(spark):
    text = json.dumps({"rules": [{"id": "acme-token", "description": " ACME ", "regex": "\\bacme_[A-Za-z0-9]{12}\\b"}]})
    rules = packs.accepted_rules(_pack(spark, text), "p")
    assert [(r.id, r.description, r.ord) for r in rules] == [("acme-token", "ACME", 1001)]
    token = "gh" + "p_" + "a" * 36
    rows = [("r", "docs/a.md", "t acme_A1b2C3d4E5f6;"), ("r", ".env.example", "x=acme_A1b2C3d4E5f6"), ("r", "b", token), ("r", "c", "acme_")]
    found = {(r["path"], r["rule_id"]) for r in scan_files(_files(spark, rows), rules=rules).collect()}
    assert found == {("docs/a.md", "acme-token"), (".env.example", "acme-token"), ("b", "github-pat")}


def test_rules_without_a_hint_still_see_every_line(spark):
    text = json.dumps({"rules": [{"id": "looks", "description": "x", "regex": "q(?=[0-9])"}, {"id": "plain", "description": "x", "regex": "zzz"}]})
    rules = packs.accepted_rules(_pack(spark, text), "p")
    found = scan_texts(_files(spark, [("r", "a", "one\nq1\nq\nzzz q2")]), rules=rules).collect()
    assert sorted((r["line"], r["rule_id"]) for r in found) == [(2, "looks"), (4, "looks"), (4, "plain")]


TOKEN = "gh" + "p_" + "a" * 36


@pytest.mark.parametrize(
    "regexes",
    [["(?:a{100}){100}"], [f"x{n}[0-9]{{500}}" for n in range(200)], ["(?:ab|c){2,}q", "(a{90}){90}", "z{499}"]],
)
def test_patterns_that_outgrow_the_gate_cost_no_built_in_finding(spark, regexes):
    text = json.dumps({"rules": [{"id": f"rule-{n}", "description": "x", "regex": r} for n, r in enumerate(regexes)]})
    rules = packs.accepted_rules(_pack(spark, text), "p")
    assert len(rules) == len(regexes)
    rows = [("r", "a", f"k = 1\n{TOKEN}"), ("r", "b", "z" * 600), ("r", "c", "a" * 10_000), ("r", "d", "x7" + "1" * 500), ("r", "e", "xx ababcq")]
    found = {(r["path"], r["line"], r["rule_id"]) for r in scan_texts(_files(spark, rows), rules=rules).collect()}
    assert {f for f in found if f[0] == "a"} == {("a", 2, "github-pat")}
    expected = {(p, 1, f"rule-{n}") for n, rx in enumerate(regexes) for _, p, t in rows[1:] if re.search(rx, t)}
    assert {f for f in found if f[2].startswith("rule-")} == expected


def test_a_long_line_ends_no_task(spark):
    text = json.dumps({"rules": [{"id": "loop", "description": "x", "regex": "x(?:a|b)*c"}, {"id": "start", "description": "x", "regex": "^(?:ab?|c)+$", "flags": "i"}]})
    rules = packs.accepted_rules(_pack(spark, text), "p")
    assert [r.deep for r in rules] == [True, True]
    rows = [("r", "a", "x" + "ab" * 60_000 + "c\n" + TOKEN), ("r", "b", "x" + "ab" * 60_000), ("r", "c", "no\nabACcc\nxc abd")]
    found = sorted((r["path"], r["line"], r["rule_id"]) for r in scan_texts(_files(spark, rows), rules=rules).collect())
    assert found == [("a", 1, "loop"), ("a", 2, "github-pat"), ("c", 2, "start"), ("c", 3, "loop")]


def test_deep_rules_without_a_linear_engine_are_refused(spark):
    text = json.dumps({"rules": [{"id": "back", "description": "x", "regex": "(?:(a)|b\\1)*c"}, {"id": "nested", "description": "x", "regex": "((y|z){100}){100}"}, {"id": "good", "description": "x", "regex": "(?:ab){3}(?=c)"}]})
    parsed = _pack(spark, text)
    assert [r["reason"] for r in packs.rule_errors(parsed).collect()] == ["regex repeats a group in a way that long lines cannot be matched safely"] * 2
    assert [r.id for r in packs.accepted_rules(parsed, "p")] == ["good"]


def test_joined_allowlists_match_like_single_entries(spark):
    entries = ["^a/", "b$", "(x)y\\1", "(?<n>q)7", "(?<n>w)8", "c.d", "lit[", "#no", "(u|v)w"]
    parsed = allowlist.parse_allowlist(spark.createDataFrame([("r", 1, "\n".join(entries)), ("s", 1, "only")], "repo string, ord int, text string"))
    paths = ["a/z", "za/", "xb", "bx", "xyx", "xy", "q7", "w8", "c-d", "lit[0", "uw", "xw", "only"]
    rows = spark.createDataFrame([(r, p) for r in "rst" for p in paths], "repo string, path string")
    found = {(r["repo"], r["path"]) for r in allowlist.flag_allowlisted(rows, parsed).where("allowlisted").collect()}
    assert found == {("r", p) for p in ["a/z", "xb", "xyx", "q7", "w8", "c-d", "lit[0", "uw"]} | {("s", "only")}


@pytest.mark.parametrize(
    "pattern, literal",
    [("^fixtures/", "fixtures/"), (r"docs/.*\.md$", "docs/"), ("a|bcd", None), ("(foo|bar)/x+yz", None), ("(?:test)s?/abcd", "/abcd"), (r"\.env(?=x)local$", ".envlocal"), ("[abc]def{2}gh", "def"), ("(abcd)?x", None), ("a{3}bc", None), ("été漢$", "été漢")],
)
def test_literals_that_entries_require(spark, pattern, literal):
    (entry,) = allowlist.parse_allowlist(spark.createDataFrame([("r", 1, pattern)], "repo string, ord int, text string")).collect()
    found = path_index.required_literal(entry["matcher"], entry["is_regex"])
    assert found == literal


def test_long_allowlists_match_like_short_ones(spark):
    rng = random.Random(3)
    parts = ["src", "docs", "été", "x", "fixtures", "a.b", "test_1", "{k}"]
    paths = list({"/".join(rng.choices(parts, k=rng.randrange(1, 5))).replace("{k}", str(k % 37)) + rng.choice(["", ".md", ".env"]) for k in range(500)})
    entries = ["^docs/", r"\.md$", "s|q", "x/x", "12", r"(fix)tures/.*\d\.env$", "a.b/", "src/[^/]+/été", "é"] + [f"none{k}/z" for k in range(300)] + [f"src/{k}/" for k in range(40)]
    texts = spark.createDataFrame([("r", 1, "\n".join(entries)), ("s", 1, "docs/x"), (None, 1, "x")], "repo string, ord int, text string")
    rows = spark.createDataFrame([(r, p, 1) for r in ("r", "s", "t", None) for p in [*paths, None, ""]] * 2, "repo string, path string, literal int")
    parsed = allowlist.parse_allowlist(texts)
    flags = {}
    for name, options in [("short", ScanOptions(joined_entries=1000)), ("index", ScanOptions()), ("joins", ScanOptions(broadcast_limit_bytes=0))]:
        found = allowlist.flag_allowlisted(rows, parsed, options)
        assert set(found.columns) == {"repo", "path", "literal", "allowlisted"}
        flags[name] = sorted(map(str, found.select("repo", "path", "literal", "allowlisted").collect()))
    assert flags["short"] == flags["index"] == flags["joins"]
    assert 0 < sum("allowlisted=True" in f for f in flags["short"]) < len(flags["short"])


def test_anchored_rules_match_lines_not_texts(spark):
    text = json.dumps({"rules": [{"id": "anchored", "description": "x", "regex": "^v$"}]})
    rules = packs.accepted_rules(_pack(spark, text), "p")
    found = scan_texts(_files(spark, [("r", "a", "x\r\nv\r\nvv\nv")]), rules=rules).collect()
    assert sorted(r["line"] for r in found) == [2, 4]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("{ not json", "not valid JSON"),
        ('{"rules": "nope"}', 'expected an object with a "rules" array'),
        ("[1]", 'expected an object with a "rules" array'),
        (json.dumps({"rules": [{}] * 201}), "too many rules (201, limit 200)"),
    ],
)
def test_refused_packs(spark, text, reason):
    parsed = _pack(spark, text)
    assert [r["reason"] for r in packs.rule_errors(parsed).collect()] == [reason]
    assert packs.accepted_rules(parsed, "p") == []


def test_blank_pack_is_silent(spark):
    assert _pack(spark, " \n").count() == 0


def test_one_bad_entry_does_not_discard_the_others(spark):
    entries = [
        {"id": "BadCase", "description": "x", "regex": "x"},
        {"id": "good-rule", "regex": "x"},
        {"id": "good-rule", "description": "good", "regex": "zzz_[0-9]{6}"},
        {"id": "no-regex", "description": "x"},
        {"id": "bad-regex", "description": "x", "regex": "([unclosed"},
        {"id": "good-rule", "description": "again", "regex": "x"},
        {"id": "gcp-service-account-key", "description": "x", "regex": "x"},
        {"id": "runaway", "description": "x", "regex": RUNAWAY},
        {"id": "flagged", "description": "x", "regex": "x", "flags": "g"},
        {"id": "twice", "description": "x", "regex": "x", "flags": "ii"},
        {"id": "long-text", "description": "x" * 121, "regex": "x"},
        None,
        [],
        {"id": "ci-rule", "description": "x", "regex": "\\bacme-key\\b", "flags": "i"},
    ]
    parsed = _pack(spark, json.dumps({"rules": entries}))
    verdicts = {r["pos"]: (r["where"], r["reason"]) for r in parsed.collect()}
    assert sorted(n for n, (_, reason) in verdicts.items() if reason is None) == [3, 14]
    assert verdicts[2] == ('"good-rule"', "description is required")
    assert verdicts[6] == ('"good-rule"', "duplicate id")
    assert verdicts[7][1] == "id is already used by a built-in rule"
    assert verdicts[8][1] == "regex is too long or backtracks catastrophically"
    assert verdicts[9][1] == "flags may only be i, m, s or u"
    assert verdicts[10][1] == "regex does not compile"
    assert verdicts[12] == ("rule 12", "not an object")
    assert verdicts[13][1].startswith("id must be")


# --- allowlists --------------------------------------------------------------


def _entries(spark, text, repo="r"):
    return allowlist.parse_allowlist(spark.createDataFrame([(repo, 1, text)], "repo string, ord int, text string"))


def test_risky_patterns(spark):
    risky = [RUNAWAY, "(a*)*", "(a+)*b", "([a-z]+)+$", "(x*)+", "(a+){2,}", "a" * 201]
    fine = ["test/fixtures/", "^docs/sample[.]md$", ".*\\.lock$", "^(src|test)/fixtures/", "a+", "(foo|bar)/"]
    df = spark.createDataFrame([(p,) for p in risky + fine], "p string")
    found = [r[0] for r in df.select(allowlist.is_risky_pattern(F.col("p"))).collect()]
    assert found == [True] * len(risky) + [False] * len(fine)


def test_allowlist_skips_matching_paths_only(spark):
    entries = _entries(spark, f"config.txt\n# comment\n^secrets/\n{RUNAWAY}\n([open")
    paths = ["other.txt", "config.txt", "a/configXtxt", "secrets/prod.txt", "x/secrets/a", "aaaa", "x([open", "B.txt"]
    changed = spark.createDataFrame([("r", p, "M", LEAK) for p in paths], "repo string, path string, status string, content string")
    found = {r["path"] for r in scan_change_set(changed, allowlist=entries).collect()}
    assert found == {"other.txt", "x/secrets/a", "aaaa", "B.txt"}


def test_allowlist_of_another_repository_does_not_apply(spark):
    rows = spark.createDataFrame([("r", "a"), ("s", "a")], "repo string, path string")
    left = allowlist.apply_allowlist(rows, _entries(spark, "a", "s")).collect()
    assert [tuple(r) for r in left] == [("r", "a")]


def test_change_set_statuses_and_gate(spark):
    rows = [("r", f"{s}.txt", s, LEAK) for s in "ACMRTDU"] + [("clean", "a", "M", "x"), ("gone", "b.txt", "D", LEAK)]
    changed = spark.createDataFrame(rows, "repo string, path string, status string, content string")
    findings = scan_change_set(changed)
    assert sorted(r["path"][0] for r in findings.collect()) == sorted("ACMRT")
    decided = {r["repo"]: (r["findings"], r["blocked"], r["exit_code"]) for r in gate_decision(changed, findings).collect()}
    assert decided == {"r": (5, True, 1), "clean": (0, False, 0), "gone": (0, False, 0)}


# --- env values --------------------------------------------------------------


def _secrets(spark):
    env = [
        ("r", "server/.env", "DB_PASSWORD=Sup3rOrangeMonoValue\nDEFAULT_PASSWORD=password\n"),
        ("r", "client/.env.local", "VITE_API_TOKEN=clientTok3nAbcdef-123456\n"),
    ]
    return xref.dotenv_secrets(_files(spark, env))


USERS = [
    ("r", "server/a.js", 'x\r\nconst pw = "Sup3rOrangeMonoValue";'),
    ("r", "b.js", "prefixSup3rOrangeMonoValue Sup3rOrangeMonoValue_"),
    ("r", "c.js", "a\nb\n!clientTok3nAbcdef-123456! Sup3rOrangeMonoValue"),
    ("r", "LoginForm.tsx", '<input type="password" />'),
    ("s", "d.js", "Sup3rOrangeMonoValue"),
]


def test_env_values_are_found_whichever_way_they_travel(spark):
    files, secrets = _files(spark, USERS), _secrets(spark)
    expected = {("server/a.js", 2), ("c.js", 3)}
    small = scan_files(files, secrets=secrets).where("rule_id = 'hardcoded-dotenv-secret'")
    large = scan_files(files, ScanOptions(broadcast_limit_bytes=0), secrets=secrets).where("rule_id = 'hardcoded-dotenv-secret'")
    assert {(r["path"], r["line"]) for r in small.collect()} == expected
    assert {(r["path"], r["line"]) for r in large.collect()} == expected
    assert small.columns == large.columns


def _naive_line(content, value):
    """The line of the first occurrence that is no part of a longer word."""
    word, at = re.compile("[0-9A-Za-z_]"), content.find(value)
    while at >= 0:
        left = not word.match(value[0]) or at == 0 or not word.match(content[at - 1])
        right = not word.match(value[-1]) or at + len(value) == len(content) or not word.match(content[at + len(value)])
        if left and right:
            return content[:at].count("\n") + 1
        at = content.find(value, at + 1)
    return None


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_env_values_of_any_shape_are_found(spark, limit):
    """Values that share anchors, are symbols only, reach far or overlap, against a search for each."""
    rng = random.Random(limit)
    pieces = ["abc", "key_1", "ÄÖ", "漢", "-", "--", ".", "$$", " ", "\n", "x", "production", "q" * 9, "/", "😀"]
    draw = lambda n: "".join(rng.choices(pieces, k=n))
    values = sorted({v for v in (draw(rng.randrange(1, 6)).strip() for _ in range(150)) if v and "\n" not in v})
    values += ["!#" * 300, "production-" + "z9." * 900, "é" * 40, "$", "--production--", "production"]
    secrets = [(rng.choice("rs"), f"{k:04}", v) for k, v in enumerate(dict.fromkeys(values))]
    files = [(rng.choice("rst"), f"f{k}", draw(rng.randrange(0, 60))) for k in range(300)]
    for repo, _, v in secrets[-8:]:
        files += [(repo, f"at{len(files)}", v), (repo, f"mid{len(files)}", f"a\n\n {v} b"), (repo, f"in{len(files)}", f"a\nx{v}x")]
    files += [("r", "none", None), ("r", "empty", ""), (None, "nowhere", "production")]
    expected = set()
    for repo, path, content in files:
        lines = [(k, line) for r, k, v in secrets if r == repo and content is not None and (line := _naive_line(content, v))]
        if lines:
            expected.add((repo, path, min(lines)[1]))
    frame = spark.createDataFrame(secrets, "repo string, ord string, value string")
    found = xref.xref_lines(_files(spark, files), frame, ["repo", "path"], ScanOptions(broadcast_limit_bytes=limit))
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 100


def test_no_env_values(spark):
    none = spark.createDataFrame([], "repo string, ord string, value string")
    assert xref.xref_lines(_files(spark, USERS), none, ["repo", "path"], ScanOptions()).count() == 0


def test_content_is_not_exchanged_for_env_values(spark):
    found = xref.xref_lines(_files(spark, USERS), _secrets(spark), ["repo", "path"], ScanOptions(broadcast_limit_bytes=0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Join" in above and "content" not in above


def test_env_coverage(spark):
    env = [("r", f"p{n}/.env", "API_KEY=serverOrange1234") for n in range(6)] + [("s", ".env", "A=1")]
    assert xref.dotenv_coverage(_files(spark, env)).where("repo = 'r'").first()["files"] == [f"p{n}/.env" for n in range(6)]
    rows = {r["repo"]: r for r in xref.dotenv_coverage(_files(spark, env), shown=4).collect()}
    assert (rows["r"]["files"], rows["r"]["file_count"], rows["r"]["secret_count"], rows["r"]["status"]) == (
        [f"p{n}/.env" for n in range(4)], 6, 1, "PASS")
    assert (rows["s"]["secret_count"], rows["s"]["status"]) == (0, "WARN")


# --- joins and reports -------------------------------------------------------


def test_joins_keep_every_row_of_a_hot_key(spark):
    facts = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), ("7", 2), ("absent", 3)], "k string, v int")
    expected = sorted(map(tuple, facts.join(dim, "k", "left").collect()), key=str)
    plain = salted_join(facts, dim, ["k"], ["id"], 5)
    adaptive = hot_salted_join(facts, dim, ["k"], ["id"], ScanOptions(hot_rows=50, salt_buckets=7))
    spilled = hot_salted_join(facts, dim, ["k"], ["id"], ScanOptions(hot_rows=1, salt_buckets=3, broadcast_limit_bytes=0))
    beyond = attach(facts, dim, ["k"], ["id"], ScanOptions(broadcast_limit_bytes=0))
    for joined in (plain, adaptive, spilled, beyond):
        assert sorted(map(tuple, joined.collect()), key=str) == expected


def test_salted_copies_are_not_broadcast(spark, tmp_path):
    """Copies are taken for as small as the table they are made of: many times that would pass through the driver."""
    spark.range(1000).select(F.col("id").alias("k"), F.lit("v").alias("v")).write.parquet(f"{tmp_path}/dim")
    dim, facts = spark.read.parquet(f"{tmp_path}/dim"), spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(facts.join(dim, "k", "left"))
    for how in ("left", "inner"):
        assert "Broadcast" not in plan(salted_join(facts, dim, ["k"], ["id"], 5, how))
        assert "SortMergeJoin" in plan(attach(facts, dim, ["k"], ["id"], ScanOptions(broadcast_limit_bytes=0), how, stored=True))


def test_stored_facts_are_joined_to_few_copies(spark, tmp_path):
    """Only hot keys are copied; the result is that of a plain join, null keys and keys without a match included."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    spark.range(2000).select(key.alias("k"), "id").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    dim = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("hot", -1), ("absent", -2)], "k string, v long"))
    options = ScanOptions(hot_rows=50, salt_buckets=7, broadcast_limit_bytes=0)
    for how in ("left", "inner"):
        joined = attach(facts, dim, ["k"], ["id"], options, how, stored=True)
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, facts.join(dim, "k", how).collect()), key=str)


def test_size_check(spark):
    dim = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("v"))
    assert fits_broadcast(dim, 200_000) and not fits_broadcast(dim, 50_000)
    assert fits_broadcast(dim.where("false"), 0)


def test_coverage_lists_clean_and_unread_files(spark):
    rows = [("r", "a", LEAK), ("r", "b", "x"), ("r", ".env", None), ("clean", "c", "x"), ("none", "d", None)]
    expected = {"r": (3, 1, 2, 2), "clean": (1, 0, 0, 0), "none": (1, 1, 0, 0)}
    files = _files(spark, rows)
    for summary in (scan_coverage(files), report.coverage_summary(files, scan_files(files))):
        found = {r["repo"]: (r["files"], r["unavailable"], r["findings"], r["files_with_findings"]) for r in summary.collect()}
        assert found == expected


def test_external_findings_are_appended(spark):
    findings = scan_texts(_files(spark, [("r", "a", LEAK)]))
    other = spark.createDataFrame([("r", "a", 1, "their-rule")], "repo string, path string, line int, rule_id string")
    merged = report.merge_findings(findings, other)
    assert merged.columns == findings.columns and merged.count() == 2


def test_report_lines(spark):
    rows = [("r", ".env", None), ("r", "a", LEAK)]
    lines = {r["text"] for r in report.finding_lines(scan_files(_files(spark, rows))).collect()}
    assert lines == {
        "[secret-file-env] .env file (may contain secrets) (file)",
        "[generic-secret-assignment] hardcoded value assigned to a credential keyword (line 1)",
    }
