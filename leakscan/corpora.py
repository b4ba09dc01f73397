"""Texts derived from the given tables, with something for every rule to find.

Each corpus is a list of SQL expressions over one input table. The same
expressions run in Spark and in the checking engine; only the spelling of the
hash differs. Credential-shaped values are built from hashes at run time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Corpus:
    """``lazy``: names of ``base`` that few rows need; Spark computes them only where a column's case uses them."""

    table: str
    base: dict[str, str]
    columns: dict[str, str]
    lazy: tuple[str, ...] = ()

    def sql(self) -> str:
        """The corpus for the checking engine."""
        inner = ", ".join(f"{_spell(e, 'sha256({})')} AS {n}" for n, e in self.base.items())
        outer = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"SELECT {outer} FROM (SELECT {inner} FROM {self.table})"

    def of(self, table: DataFrame) -> DataFrame:
        """The corpus over ``table``, batch or streaming."""
        base = {n: _spell(e, "sha2({}, 256)") for n, e in self.base.items()}
        late = {n: base.pop(n) for n in self.lazy}
        columns = {n: _put_in(e, late) for n, e in self.columns.items()}
        kept = {k for e in late.values() for k in table.columns if re.search(rf"\b{k}\b", e)}  # what late ones are made of
        return table.selectExpr(*sorted(kept), *[f"{e} AS {n}" for n, e in base.items()]).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _spell(expression: str, sha: str) -> str:
    """Replace each ``#key#`` by the hex hash of that key."""
    pieces = expression.split("#")
    return "".join(p if i % 2 == 0 else sha.format(p) for i, p in enumerate(pieces))


def _put_in(expression: str, named: dict[str, str]) -> str:
    """Replace each name outside string literals by its expression."""
    pieces = expression.split("'")
    for i in range(0, len(pieces), 2):
        pieces[i] = re.sub(r"\b\w+\b", lambda m: f"({named[m[0]]})" if m[0] in named else m[0], pieces[i])
    return "'".join(pieces)


def _alnum(key: str, copies: int) -> str:
    """Letters and digits from ``copies`` hashes, about 40 characters each."""
    text = f"cast({key} AS string)"
    parts = ", ".join(f"base64(unhex(#concat({text}, '/{i}')#))" for i in range(copies))
    return f"translate(concat({parts}), '+/=', '')"


def _cycle(selector: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {selector} % {len(options)} {cases} ELSE {options[-1]} END"


NL = "chr(10)"
Q, SQ = "'\"'", "chr(39)"

# (text before, alphabet, length, text after); one per provider rule, plus a clean line.
_SHAPES = [
    ("'-----BEGIN '", "u", 3, "' PRIVATE KEY-----'"),
    ("'AKIA'", "u", 16, "''"),
    ("'ghp_'", "a", 36, "''"),
    ("'github_pat_'", "a", 22, "''"),
    ("'glpat-'", "a", 20, "''"),
    ("'xoxb-'", "a", 10, "''"),
    ("'xapp-1-'", "a", 10, "''"),
    ("'https://hooks.slack.com/services/T0/B0/'", "a", 1, "''"),
    ("'sk_live_'", "a", 16, "''"),
    ("'AIza'", "a", 35, "''"),
    ("'GOCSPX-'", "a", 20, "''"),
    ("'AccountKey='", "a", 86, "'=='"),
    ("'8Xy7Q~'", "a", 34, "''"),
    ("'SK'", "h", 32, "''"),
    ("'API_SECRET='", "a", 16, "''"),
    ("concat('SG.', substr(a, 1, 22), '.')", "a", 43, "''"),
    ("'key-'", "a", 32, "''"),
    ("''", "h", 32, "'-us1'"),
    ("'npm_'", "a", 36, "''"),
    ("'pypi-AgEIcHlwaS'", "a", 50, "''"),
    ("'sk-'", "a", 20, "''"),
    ("'sk-ant-'", "a", 20, "''"),
    ("'dop_v1_'", "h", 64, "''"),
    ("'dp.pt.'", "a", 40, "''"),
    ("'shpat_'", "h", 32, "''"),
    ("'sq0atp-'", "a", 22, "''"),
    ("'12345678:AA'", "a", 33, "''"),
    ("'hvs.'", "a", 24, "''"),
    ("'ATATT3'", "a", 20, "''"),
    ("'dapi'", "h", 32, "''"),
    ("concat('PMAK-', substr(h, 1, 24), '-')", "h", 34, "''"),
    ("concat('glsa_', substr(a, 1, 32), '_')", "h", 8, "''"),
    ("'lin_api_'", "a", 40, "''"),
    ("'sbp_'", "h", 40, "''"),
    ("'NRAK-'", "u", 27, "''"),
    ("'sntrys_'", "a", 32, "''"),
    ("'fm2_'", "a", 40, "''"),
    ("concat(substr(a, 1, 14), '.atlasv1.')", "a", 60, "''"),
    ("concat('eyJ', substr(a, 1, 10), '.eyJ', substr(a, 11, 10), '.')", "a", 10, "''"),
    ("'postgres://user:'", "a", 3, "'@db:5432/app'"),
    ("'nothing to see '", "k", 1, "''"),
]


def _shape(shorter: int) -> str:
    options = [
        f"concat({before}, substr({'cast(k AS string)' if body == 'k' else body}, 1, {length - shorter}), {after})"
        for before, body, length, after in _SHAPES
    ]
    return _cycle("k", options)


_LINE_BASE = {
    "k": "c_custkey",
    "nation": "c_nationkey",
    "name": "c_name",
    "h": "#concat(cast(c_custkey AS string), '/h')#",
    "a": _alnum("c_custkey", 6),
    "u": f"upper({_alnum('c_custkey', 6)})",
}

# One provider token per file, and the same token one character short.
planted_lines = Corpus(
    "customer",
    _LINE_BASE,
    {
        "repo": "concat('team', cast(nation AS string))",
        "path": "concat('app/', cast(k AS string), '.txt')",
        "content": (
            f"concat('# ', name, {NL}, 'k = \"', {_shape(0)}, '\"', {NL}, 'v = \"', {_shape(1)}, '\"', "
            f"CASE WHEN k % 7 = 0 THEN ' # gitleaks:allow' ELSE '' END, {NL})"
        ),
    },
)

_KEYWORDS = ["'password'", "'DB_PASS'", "'const apiSecretKey'", "'access_token'", "'Authorization'", "'client-secret'",
             "'connection_string'", "'xauthToken'", "'credentials'", "'MyPwd'", "'tokenizer'", "'SESSION_KEY'",
             "'clientSecretValue'"]
_OPERATORS = ["' = '", "': '", "'='", "'\" : '", "' -> '"]
_VALUES = [
    "substr(a, 1, 12)", "substr(a, 1, 20)", "'changeme'", "'process.env.DB_PASSWORD'",
    "concat('reset/:id/', lower(substr(a, 1, 16)))", "'api/:version/encrypt'", "concat('$', '{DB_PASS}')", "'DB_PASSWORD'",
    "'your_db_password'", "'hashedPassword'", "concat('Bearer ', substr(a, 1, 24))", "'пароль'", "'<secret>'", "'...'",
    "'abc'", "'session-key'", "'Bearer {token}'", "concat(substr(a, 1, 8), ' # note')", "'client-secret'",
    "'getSecret(k)'", "', other ?'", "concat('token ', substr(h, 1, 30))", "'$HOME'", "'media/:id/zxcvbnmlkjhg'",
    "concat(substr(a, 1, 6), '!', substr(a, 7, 3))", "'null'", "'xxxxxx'", "'replace_me_here'",
]


def _assignment(offset: str) -> str:
    quote = _cycle(f"(q + {offset})", [Q, SQ, "'`'", "''", "''"])
    open_quote = f"concat(CASE WHEN (k + {offset}) % 17 = 0 THEN 'f' ELSE '' END, {quote})"
    close_quote = f"CASE WHEN (k + {offset}) % 19 = 0 THEN '' ELSE {quote} END"
    return (
        f"concat({_cycle(f'(k + {offset})', _KEYWORDS)}, {_cycle(f'(o + {offset})', _OPERATORS)}, {open_quote}, "
        f"{_cycle(f'(v + {offset})', _VALUES)}, {close_quote})"
    )


_GENERIC_BASE = {
    "k": "p_partkey",
    "v": "(p_partkey * 5 + p_size)",
    "o": "(p_partkey * 7 + p_size)",
    "q": "(p_partkey * 3 + p_size)",
    "size": "p_size",
    "name": "p_name",
    "h": "#concat(cast(p_partkey AS string), '/h')#",
    "a": _alnum("p_partkey", 2),
}

# Keyword assignments of every kind, some lines with two of them.
planted_generic = Corpus(
    "part",
    _GENERIC_BASE,
    {
        "repo": "concat('size', cast(size AS string))",
        "path": "concat('src/m', cast(k AS string), " + _cycle("k", ["'.js'", "'.yml'", "'.txt'", "'.py'"]) + ")",
        "content": (
            f"concat(name, {NL}, {_assignment('0')}, CASE WHEN k % 5 = 0 THEN concat(', ', {_assignment('3')}) "
            f"ELSE ',' END, CASE WHEN k % 23 = 0 THEN ' // LeakScan:Allow' ELSE '' END, {NL}, name)"
        ),
    },
)

# Opaque and name-like tokens for the entropy layer.
planted_entropy = Corpus(
    "orders",
    {
        "k": "o_orderkey",
        "cust": "o_custkey",
        "priority": "o_orderpriority",
        "h": "#concat(cast(o_orderkey AS string), '/h')#",
        "b": "base64(unhex(#concat(cast(o_orderkey AS string), '/b')#))",
        "a": _alnum("o_orderkey", 2),
    },
    {
        "repo": "priority",
        "path": "concat('src/o', cast(k AS string), '.ts')",
        "token": _cycle(
            "k",
            [
                "substr(a, 1, 40)",
                "substr(h, 1, 40)",
                "'buildCustomerOrderSummaryReport'",
                "'src/components/GlobalFilterSidebar/GlobalFilterSummaryTrigger'",
                "concat('/auth/reset/', substr(a, 1, 43))",
                "'BACKEND_DIR/requirements'",
                "b",
                "concat('order-', cast(k AS string), '-', substr(a, 1, 16))",
                "concat('src/', substr(a, 1, 12), '/', substr(a, 13, 22))",
                "concat(substr(a, 1, 10), substr(a, 1, 10))",
            ],
        ),
    },
)

BACKSLASH = "chr(92)"
_PATHS = [
    "concat('client/src/translations/hi/', n, '.json')", "concat('docs/guide/', n, '.txt')",
    "concat('src/distributor/', n, '.ts')", f"concat('client', {BACKSLASH}, 'Dist', {BACKSLASH}, n, '.html')",
    "concat('m', n, '/README.MD')", "concat('a/', n, '.min.js')", "concat(n, '/package-lock.json')",
    "concat('svc', n, '/.env')", "concat('svc', n, '/.env.example')", "concat('app', n, '/.env.production')",
    "concat('x', n, '/.env.cron.Example')", "concat('deploy', n, '/id_rsa')", "concat('c', n, '.p12')",
    "concat('Makefile', n)", "concat('.hidden', n)", "concat('a', n, '/b.c/d')", "concat('lang/', n, '.py')",
    "concat('src/i18nUtils', n, '.ts')", "concat('v', n, '/go.sum')", "concat('.env.local.TEMPLATE', n)",
    "concat('a', n, '.tar.MAP')", "concat('build/', n, '.rs')", "concat('README', n)", "concat('src/', n, '.PY')",
    "concat('node_modules/x', n, '/.env')", "concat('a/b/c/d/e/', '.env.', n)", "concat('a/b/c/d/e/f/', '.env.', n)",
    "concat('VENV/', n, '/.env.local')", "concat('x', n, '/credentials')", "concat('k', n, '.KDBX')", "concat('/abs/', n, '.go')",
    "concat('secrets/', n, '.toml')",
]

# File names of every class the path rules tell apart.
planted_paths = Corpus(
    "part",
    {"k": "p_partkey", "size": "p_size", "price": "p_retailprice", "n": "cast(p_partkey AS string)"},
    {
        "repo": "concat('size', cast(size AS string))",
        "path": _cycle("k", _PATHS),
        "length": "cast(CASE WHEN k % 11 = 0 THEN 1048577 ELSE 1048576 - k END AS bigint)",
        "k": "k",
    },
)

_SUPPLIER_BASE = {
    "k": "s_suppkey",
    "nation": "s_nationkey",
    "name": "s_name",
    "h": "#concat(cast(s_suppkey AS string), '/h')#",
    "a": _alnum("s_suppkey", 2),
}
_SUPPLIER_REPO = "concat('nation', cast(nation AS string))"

# Env files with secrets, settings, placeholders and comments.
planted_env = Corpus(
    "supplier",
    _SUPPLIER_BASE,
    {
        "repo": _SUPPLIER_REPO,
        "path": "concat('svc', cast(k AS string), '/.env')",
        "length": "cast(200 AS bigint)",
        "content": (
            f"concat('# ', name, {NL}, 'export DB_PASSWORD=', "
            + _cycle("k", ["substr(a, 1, 20)", "concat('\"', substr(a, 1, 20), '\"')", "concat(substr(a, 1, 20), ' # db')",
                           "concat('p-', substr(a, 1, 12), '+')", "'changeme'"])
            + f", {NL}, 'PORT=5432', {NL}, ' THEME_KEY = #a1b2c3', {NL}, 'BUILD_ID=', substr(h, 1, 16), {NL}, "
            f"'MODE=production', {NL}, 'API_TOKEN=', substr(a, 21, CAST(6 + k % 8 AS int)), {NL}, 'QUOTE=\"', {NL}, 'no assignment')"
        ),
    },
)

# Code that repeats those values: alone, embedded in a word, punctuated, or not at all.
planted_users = Corpus(
    "supplier",
    _SUPPLIER_BASE,
    {
        "repo": _SUPPLIER_REPO,
        "path": "concat('svc', cast(k AS string), '/main.c')",
        "content": (
            f"concat('int main;', {NL}, '// x', substr(a, 1, 20), 'y', {NL}, "
            + _cycle("k", ["concat('f(\"', substr(a, 1, 20), '\")')", "concat('<', substr(a, 1, 20), '>')",
                           "concat('x', substr(a, 1, 20))", "concat('zp-', substr(a, 1, 12), '+9 p-', substr(a, 1, 12), '+9')",
                           "concat('id ', substr(h, 1, 16), '!')"])
            + f", {NL}, name)"
        ),
    },
)

_MANIFESTS = [
    f"concat('kind: Secret', {NL}, 'data:', {NL}, '  password: ', b, {NL}, '  x: {{{{ .v }}}}', {NL}, 'type: Opaque', {NL}, '  y: ', b)",
    f"concat('data:', {NL}, '  password: \"', b, '\"', {NL}, {NL}, '  n: 12', {NL}, 'kind: \"Secret\"')",
    f"concat('kind: Secret', {NL}, 'stringData:', {NL}, '  a: ', b, {NL}, '---', {NL}, 'kind: ConfigMap', {NL}, 'data:', {NL}, '  b: ', b)",
    f"concat('kind: ConfigMap', {NL}, 'data:', {NL}, '  b: ', b, {NL}, '--- ', {NL}, 'kind: Secret', {NL}, 'data:', {NL}, '  a: ', b)",
    f"concat('kind: SealedSecret', {NL}, 'spec:', {NL}, '  data:', {NL}, '    a: ', b)",
    f"concat('kind: Secret', {NL}, 'outer:', {NL}, '  data:', {NL}, '    a: ', b, {NL}, '  c: ', b, {NL}, 'data:', {NL}, ' d: ', b, ' # gitleaks:allow', {NL}, ' e: ', b)",
]

planted_k8s = Corpus(
    "supplier",
    {"k": "s_suppkey", "nation": "s_nationkey", "b": "base64(unhex(substr(#concat(cast(s_suppkey AS string), '/h')#, 1, 32)))"},
    {
        "repo": _SUPPLIER_REPO,
        "path": "concat('deploy/', cast(k AS string), '.yaml')",
        "content": _cycle("k", _MANIFESTS),
    },
)

_CONTEXTS = [
    "concat('{', chr(10), '  \"type\": \"service_account\",', chr(10), '  \"private_key_id\" : \"', substr(h, 1, 40), '\"', chr(10), '}')",
    "concat('{\"type\":\"service_account\",\"private_key_id\":\"', substr(h, 1, 12), '\"}')",
    "concat('{\"private_key_id\":\"', substr(h, 1, 40), '\"}')",
    "concat('// Twilio client', chr(10), 't = ', substr(h, 1, 32), ';')",
    "concat('etag = ', substr(h, 1, 32), ';')",
    "concat('sid = AC', substr(h, 1, 32), chr(10), 't = ', substr(h, 33, 32), ' ', substr(h, 1, 33))",
    "concat('// twilio', chr(10), 'sha = ', substr(h, 1, 40))",
]

# Service-account files and Twilio contexts, with look-alikes.
planted_context = Corpus(
    "supplier",
    _SUPPLIER_BASE,
    {
        "repo": _SUPPLIER_REPO,
        "path": "concat('cfg/', cast(k AS string), '.json')",
        "content": _cycle("k", _CONTEXTS),
    },
)

# File versions: which change introduced which content, on a clock that lies.
planted_changes = Corpus(
    "lineitem",
    {
        "repo_no": "l_suppkey % 20",
        "o": "l_orderkey",
        "part_no": "l_partkey",
        "line_no": "l_linenumber",
        "flag": "l_returnflag",
        "quantity": "cast(l_quantity AS bigint)",
        "commit_hash": "#concat('c', cast(l_suppkey % 20 AS string), '/', cast(l_orderkey AS string))#",
        "blob_hash": "#concat('b', cast(l_partkey % 37 AS string), '/', cast(l_quantity AS string))#",
    },
    {
        "repo": "concat('repo', cast(repo_no AS string))",
        "commit_index": "cast(o AS bigint)",
        "commit_sha": "substr(commit_hash, 1, 40)",
        "epoch": "cast(1600000000 + (o * 7919) % 1000003 AS bigint)",
        "seq": "cast(line_no AS bigint)",
        "new_mode": "CASE WHEN quantity % 29 = 0 THEN '160000' WHEN quantity % 13 = 0 THEN '120000' ELSE '100644' END",
        "blob": f"CASE WHEN quantity % 31 = 0 THEN repeat('0', 40) ELSE substr(blob_hash, 1, 40) END",
        "status": "CASE WHEN flag = 'R' THEN 'D' WHEN flag = 'A' THEN 'A' ELSE 'M' END",
        "path": (
            "concat('f', cast(part_no % 50 AS string), CASE part_no % 5 WHEN 0 THEN '.py' WHEN 1 THEN '/.env' "
            "WHEN 2 THEN '/docs/x.md' WHEN 3 THEN '.yml' ELSE '/.env.example' END)"
        ),
        "pick": "cast(part_no % 37 AS bigint)",
        "quantity": "quantity",
    },
)

_BLOBS = [
    "concat('DB_PASSWORD=', substr(a, 1, 14))",
    "concat('k = \"ghp_', substr(a, 1, 36), '\"')",
    "'plain text, nothing else'",
    "concat('# config', chr(10), 'password: \"', substr(a, 1, 12), '\" ', CASE WHEN quantity % 2 = 0 THEN '# leakscan:allow' ELSE '' END)",
    "concat('x = ', substr(a, 1, 40))",
    "'absent'",
    "CAST(NULL AS string)",
    "concat('// twilio', chr(10), substr(h, 1, 32))",
    "CAST(NULL AS string)",
]

# Contents of those versions, one row per change; kind 5 is missing, 6 too
# large, 8 listed but unreadable.
planted_blobs = Corpus(
    "lineitem",
    {
        "repo_no": "l_suppkey % 20",
        "quantity": "cast(l_quantity AS bigint)",
        "pick": "l_partkey % 37",
        "blob_hash": "#concat('b', cast(l_partkey % 37 AS string), '/', cast(l_quantity AS string))#",
        "h": "#concat('t', cast(l_partkey % 37 AS string), '/', cast(l_quantity AS string))#",
        "a": _alnum("concat(cast(l_partkey % 37 AS string), '/', cast(l_quantity AS string))", 2),
    },
    {
        "repo": "concat('repo', cast(repo_no AS string))",
        "blob": "substr(blob_hash, 1, 40)",
        "kind": "cast((pick + quantity) % 9 AS int)",
        "size": "cast(CASE WHEN (pick + quantity) % 9 = 6 THEN 10485761 + quantity * 99999 ELSE 64 END AS bigint)",
        "content": _cycle("(pick + quantity)", _BLOBS),
    },
    lazy=("h", "a"),
)

# Keyword values on their own, with the text they are assigned after.
planted_values = Corpus(
    "part",
    _GENERIC_BASE,
    {
        "k": "k",
        "key_context": f"concat({_cycle('k', _KEYWORDS)}, ' = ')",
        "value": _cycle("v", _VALUES),
    },
)
