import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leakscan.functions import dialect, dotenv, entropy, generic, paths, text
from leakscan.functions.rules import PROVIDER_RULES, RESERVED_RULE_IDS, java_shape


def _one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_rule_catalogue():
    assert len(PROVIDER_RULES) == 40
    assert len(set(RESERVED_RULE_IDS)) == len(RESERVED_RULE_IDS) == 48


def test_every_shape_compiles(spark):
    for rule in PROVIDER_RULES:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_shape(rule))


def test_hostile_key_header_does_not_exhaust_the_stack(spark):
    line = "-----BEGIN" + " A" * 200_000
    shape = java_shape(PROVIDER_RULES[0])
    assert not _one(spark, m=F.rlike(F.lit(line), F.lit(shape)))["m"]


def test_paths(spark):
    rows = [
        ("client/src/translations/hi/common.json", "i18n"),
        ("README.md", "docs"),
        ("client\\Dist\\index.html", "generated"),
        ("src/config/db.js", None),
        ("lang", None),
        ("dist", None),
        ("a/.md", None),
        ("x/go.sum", "generated"),
        ("/docs//x.c", "docs"),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "path string")
    found = [r[0] for r in df.select(paths.heuristic_exempt(F.col("path"))).collect()]
    assert found == [r[1] for r in rows]
    off = [r[0] for r in df.select(paths.heuristic_exempt(F.col("path"), default_excludes=False)).collect()]
    assert set(off) == {None}


def test_env_names(spark):
    rows = [(".env", False, True), ("a/.env.production.local", False, True), (".ENV.Local.Example", True, False),
            ("env", False, False), (".env.", False, True), ("environment.js", False, False)]
    df = spark.createDataFrame([r[:1] for r in rows], "path string")
    p = F.col("path")
    found = [tuple(r) for r in df.select(paths.is_env_template(p), paths.is_dotenv_file(p)).collect()]
    assert found == [r[1:] for r in rows]


def test_decode_blob(spark):
    line = "password=SuperOrange123\n"
    mixed = "Passwort=Größe · 口令=秘密 · пароль=ключ 😀\n"

    def odd_nuls(count):
        data = bytearray(b"A" * 20)
        for i in range(count):
            data[1 + 2 * i] = 0
        return bytes(data)

    cases = [
        (b"\xff\xfe" + mixed.encode("utf-16-le"), mixed),
        (b"\xfe\xff" + mixed.encode("utf-16-be"), mixed),
        (b"\xef\xbb\xbf" + mixed.encode(), mixed),
        (mixed.encode(), mixed.encode().decode("latin1")),
        (line.encode("utf-16-le"), line),
        (odd_nuls(7), odd_nuls(7).decode("latin1")),
        (odd_nuls(8), odd_nuls(8).decode("utf-16-le")),
        (b"A\0B", "A\0B"),
        (b"A\0B\0", "AB"),
        (b"A" * 1024 + ("B" * 2048).encode("utf-16-le"), "\u4141" * 512 + "B" * 2048),
        (b"\xfe\xff\x00\x41\x00", "A"),
        (b"\xff\xfeA\x00\x00\xd8B\x00\x00\xdc", "A�B�"),
        (b"\xef\xbb\xbfa\xffb", "a�b"),
        (b"", ""),
        (None, ""),
    ]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, data binary")
    found = {r["n"]: r["t"] for r in df.select("n", text.decode_blob(F.col("data")).alias("t")).collect()}
    assert found == {n: c[1] for n, c in enumerate(cases)}


def test_long_utf16_is_decoded_without_recursion(spark):
    body = "x😀" * 200_000
    df = spark.createDataFrame([(b"\xff\xfe" + body.encode("utf-16-le"),)], "data binary")
    assert df.select(text.decode_blob(F.col("data")) == body).first()[0]


def test_shannon_entropy(spark):
    words = ["", "aaaa", "Yx8Lq3nVcM6qKwS5uXbTeGhIkM", "héllo wörld", "😀😀ab"]

    def reference(s):
        units = len(s.encode("utf-16-le")) // 2
        return -sum((n := s.count(c)) / units * math.log2(n / units) for c in set(s)) if s else 0.0

    df = spark.createDataFrame([(w,) for w in words], "w string")
    for row in df.select("w", entropy.shannon_entropy(F.col("w")).alias("h")).collect():
        assert row["h"] == pytest.approx(reference(row["w"]), abs=1e-9)


def test_entropy_candidates(spark):
    cases = {
        "src/components/GlobalFilterSidebar/GlobalFilterSummaryTrigger": 4,
        "/documents/modules/webhook-implementation/": 3,
        "/onlyonesegmentislongenough": 1,
        "aGVsbG8=/d29ybGQ=": 1,
        "SRC/COMPONENTS/GLOBALFILTERSUMMARYTRIGGER": 3,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", F.size(entropy.entropy_candidates(F.col("t"))).alias("n")).collect()} == cases


def test_batch_scores_agree_with_the_exact_rule(spark):
    import pyarrow as pa

    from leakscan.operators.token_scores import score_lines

    rng = random.Random(7)
    alphabets = ["abcdefghij", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "0123456789abcdef",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "aeioubcdfgh/ABCD_-", "é=abcXYZ/0123 "]
    words = ["src", "components", "GlobalFilterSidebar", "BACKEND_DIR", "v2", "endpoints", "OAuth2Strategy", "x-y"]
    lines = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(250)]
    lines += ["/".join(rng.choice(words) for _ in range(rng.randint(2, 7))) for _ in range(300)]
    lines += ["/".join([rng.choice(words), "".join(rng.choice(alphabets[3]) for _ in range(25)), "é"]) for _ in range(300)]
    sure, maybe = score_lines(pa.array(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    exact = {r["n"]: r["v"] for r in df.select("n", entropy.has_high_entropy_token(F.col("line")).alias("v")).collect()}
    assert any(exact.values()) and not all(exact.values())
    for n in exact:
        assert not (sure[n] and not exact[n]), lines[n]
        assert maybe[n] or not exact[n], lines[n]


def test_dotenv_values(spark):
    cases = [
        ("export DB_PASSWORD=abc def # note", ("DB_PASSWORD", "abc def")),
        ("A = 'x y'", ("A", "x y")),
        ('A="', ("A", "")),
        ("A=#b", ("A", "#b")),
        ("A=`v` # c", ("A", "`v`")),
        ("export = x", ("export", "x")),
        ("1A=x", None),
        ("no assignment", None),
        ("A=x\r", None),
        (" A =  v  ", ("A", "v")),
    ]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, line string")
    found = {r["n"]: r["a"] for r in df.select("n", dotenv.parse_assignment(F.col("line")).alias("a")).collect()}
    for n, (line, expected) in enumerate(cases):
        assert (tuple(found[n]) if found[n] else None) == expected, line


def test_dotenv_secret_shapes(spark):
    cases = [
        ("DEFAULT_PASSWORD", "password", False),
        ("THEME_KEY", "3a86ff", False),
        ("BRAND_API_KEY", "#fff", False),
        ("COLOR_TOKEN", "a1b2c3d4", False),
        ("REAL_API_TOKEN", "aX9kQm2pLw8vRt4z", True),
        ("API_KEY", "123456789", False),
        ("HOST", "abcdefgh1234", True),
        ("HOST", "abcdefghijkl", False),
        ("DB_PASSWORD", "your_db_password", False),
    ]
    df = spark.createDataFrame(cases, "k string, v string, e boolean")
    for r in df.select("k", "v", "e", dotenv.is_dotenv_secret(F.col("k"), F.col("v")).alias("s")).collect():
        assert r["s"] == r["e"], r


def test_boundary_line(spark):
    cases = [
        ("a\nb prefixfoo1x foo1\n", "foo1", 2),
        ("xfoo1", "foo1", None),
        ("foo1_ foo1-", "foo1", 1),
        ("x+a+ +a+", "+a+", 1),
        ("😀\n\n\\Efoo\\E", "\\Efoo\\E", 3),
        ("a.c abc a.c", "a.c", 1),
        ("\nfoo", "foo", 2),
    ]
    df = spark.createDataFrame(cases, "c string, v string, e int")
    for r in df.select("c", "v", "e", dotenv.boundary_line(F.col("c"), F.col("v")).alias("n")).collect():
        assert r["n"] == r["e"], r


@pytest.mark.parametrize(
    "pattern, flags, hits, misses",
    [
        (r"\bacme_[a-z0-9]{4}\b", "", ["acme_ab12", "éacme_ab12"], ["xacme_ab12", "acme_ab123"]),
        (r"^a.c$", "", ["abc", "a\u0085c"], ["abc\n", "xabc", "a c"]),
        (r"^a.c$", "s", ["a c"], []),
        (r"^b$", "m", ["a\rb"], ["ab"]),
        (r"key\s=", "i", ["KEY =", "Key ="], ["key="]),
        (r"[\s-]x", "", ["﻿x", "-x"], ["ax"]),
        (r"[^\S\n]x", "", [" x"], ["\nx", "ax"]),
        (r"[[&&^]x", "", ["[x", "&x", "^x"], ["ax"]),
        (r"a{,2}", "", ["a{,2}"], ["aa"]),
        (r"x{2}y{", "", ["xxy{"], ["xy{"]),
        (r"\$\{v\}", "", ["${v}"], ["v"]),
        (r"(a)\1", "", ["aa"], ["ab"]),
        (r"(?<n>a)\k<n>", "", ["aa"], ["ab"]),
        (r"[]", "", [], ["a", ""]),
        (r"[^]", "", ["\n"], [""]),
        (r"A\x42\cJ", "", ["AB\n"], ["ab"]),
        (r"\p{Lu}\p{Script=Greek}", "u", ["Aα"], ["aα"]),
        (r"(?=a)ab|(?<!x)y", "", ["ab", "ay"], ["xy"]),
    ],
)
def test_pattern_dialect(spark, pattern, flags, hits, misses):
    java = dialect.to_java_pattern(pattern, flags)
    df = spark.createDataFrame([(t, True) for t in hits] + [(t, False) for t in misses], "t string, e boolean")
    for r in df.select("t", "e", F.rlike("t", F.lit(java)).alias("m")).collect():
        assert r["m"] == r["e"], (pattern, java, r)


@pytest.mark.parametrize("pattern", ["([unclosed", "*a", "a**", "a{2,1}", "(?<=a+)b", "a)", "[b-a]", "\\", "(?x)", "^*", r"\2(a)"])
def test_patterns_that_do_not_compile(pattern):
    with pytest.raises(ValueError):
        dialect.to_java_pattern(pattern)


def test_re2_hints_cover_the_pattern():
    assert dialect.to_re2_hint(r"(?=a)b") == ""
    assert dialect.to_re2_hint(r"(a)\1") == ""
    assert dialect.to_re2_hint(r"^v\s$", "i").startswith("(?i:")


# --- the keyword layer against a plain restatement --------------------------

_KEYWORD = re.compile(generic.KEYWORDS, re.I | re.A)


def _plain_candidates(line):
    values = []
    for m in _KEYWORD.finditer(line):
        before, first = line[m.start() - 1 : m.start()] if m.start() else "", line[m.start()]
        alnum = bool(re.match("[A-Za-z0-9]", before))
        if alnum and not (re.match("[a-z0-9]", before) and "A" <= first <= "Z"):
            continue
        rest = re.sub("^[A-Z][a-z0-9]*", "", line[m.end() :])
        tail = re.match("[\"'`]?[ \t]*[:=][ \t]*([^ \t].*)", rest)
        if tail:
            values.append(tail.group(1))
    return values


def test_candidates_agree_with_a_plain_restatement(spark):
    rng = random.Random(11)
    pieces = ["password", "pass", "Token", "authToken", "secret", "_KEY", "api-key", "Secret", "Value", "x", "A", "9", "_", "-",
              " ", "=", ":", '"', "'", "apiKey", "credentials", "é", "conn_str", "ing", "auth", "orization", "\t", "pwd", ".", "{"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    rows = df.select("n", generic.generic_candidates(F.col("line")).alias("c")).collect()
    for row in rows:
        assert [c["value"] for c in row["c"]] == _plain_candidates(lines[row["n"]]), lines[row["n"]]
        for c in row["c"]:
            assert c["key_context"] + c["value"] == lines[row["n"]]


def test_line_gate_covers_every_candidate(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(12)
    pieces = ["password", "Token", "Secret", "Value", "x", "9", " ", "=", ":", '"', "apiKey", " ", " ", "`", "-"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))) for _ in range(3000)]
    gated = pc.match_substring_regex(pa.array(lines), generic.LINE_GATE).to_pylist()
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    for row in df.select("n", F.size(generic.generic_candidates(F.col("line"))).alias("c")).collect():
        assert gated[row["n"]] or not row["c"], lines[row["n"]]


def test_line_verdict_agrees_with_its_candidates(spark):
    rng = random.Random(13)
    pieces = ["password", "Token", "authToken", "secret", "SESSION_KEY", "api-key", "Password", "Value", "x9", "_", " ", " = ", ": ", ":", "=",
              '"', "'", "`", "f\"", "Bearer ", "oauth:", "token ", "abcd1234", "Qw9", "your_", "process.env.X", "${v}", "{v}", ",", ";", "}", ")",
              "session-key", "secretpassword", "reset/:id/", "encrypt", "zxcvbnmkjhgf", "\r", "\u2028", "\u00a0", "ABC_DEF", "...", "<a>", "é", "пароль"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 16))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    line = F.col("line")
    for code in (True, False):
        listed = F.exists(
            generic.generic_candidates(line),
            lambda c: generic.is_hardcoded(c.getField("value"), F.lit(code), c.getField("key_context")),
        )
        rows = df.select("n", listed.alias("a"), generic.has_hardcoded_assignment(line, F.lit(code)).alias("b")).collect()
        wrong = [lines[r["n"]] for r in rows if r["a"] != r["b"]]
        assert not wrong, wrong[:5]
        assert 100 < sum(r["a"] for r in rows) < 5900


def test_very_long_line_with_many_keywords(spark):
    import time

    line = "a.token=b.token,c.password=d(e),f.secret;" * 20_000 + 'x.password="orange7secret"'
    df = spark.createDataFrame([(line,)], "line string")
    start = time.time()
    assert df.select(generic.has_hardcoded_assignment(F.col("line"), F.lit(True))).first()[0]
    assert time.time() - start < 60


def test_hostile_lines_stay_linear(spark):
    import time

    from leakscan.operators.scan import scan_texts

    lines = {
        "scheme": "a." * 400_000 + "://u:pw@",
        "echo": "A_-b" * 250_000 + ' password = "password-word"',
        "quote": "token = '" + "x" * 1_000_000,
    }
    df = spark.createDataFrame([(n, "a.js", t) for n, t in lines.items()], "repo string, path string, content string")
    start = time.time()
    scan_texts(df).collect()
    assert time.time() - start < 60


@pytest.mark.parametrize(
    "line, hit",
    [("a+b://u:pass@h", True), ("_a://u:pass@h", False), ("_a.b://u:pass@h", True), ("9://u:pass@h", False), ("9.x9://u:pass@h", True),
     ("é.A://u:pass@h", True), ("://u:pass@h", False), ("x://u:pa@h", False), ("x_y://u:pass@h", False), ("-s3://u:pass@h", True), ("x y://u:p:pass@h", False)],
)
def test_url_scheme_rule(spark, line, hit):
    plain = re.search(r"(?<![0-9A-Za-z_])[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]{3,}@", line, re.I | re.A)
    assert bool(plain) == hit
    assert _one(spark, m=F.rlike(F.lit(line), F.lit(java_shape(PROVIDER_RULES[39]))))["m"] == hit
