"""Reference SQL for each query, by name."""

from __future__ import annotations

from leakscan import corpora
from oracles import scan_sql as s
from oracles.fixed import CYCLED_PATTERNS, NULL_BLOB
from oracles.scan_sql import matches, query, text

DOCUMENTS = "SELECT source AS repo, concat('src/', source, '/', cast(doc_id AS varchar), '.txt') AS path, text AS content FROM documents"
PAGES = "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, concat('p', cast(page_id AS varchar), '.html') AS path, html AS content FROM pages"
CONVERSATIONS = "SELECT role AS repo, concat('c', cast(conv_id AS varchar), '/', cast(turn AS varchar)) AS path, text AS content FROM conversations"
ENTROPY_FILES = f"SELECT repo, path, concat('x = ''', token, '''') AS content FROM ({corpora.planted_entropy.sql()})"

SQL: dict[str, str] = {}


def _scan(files: str, final: str, extra: list[tuple[str, str]] | None = None, **options) -> str:
    return query([("files", files), *(extra or []), *s.scan_ctes("files", **options)], final)


def _places(files: str, orders: str = "true", extra=None, **options) -> str:
    return _scan(
        files,
        f"SELECT repo, path, cast(line AS bigint) AS line, rule_id FROM findings JOIN {s.RULES} USING (rule_ord) WHERE {orders}",
        extra,
        **options,
    )


# --- sources -----------------------------------------------------------------

_STATUS = "substr('ACMRTDUX', cast(k % 8 + 1 AS int), 1)"
SQL["read_file_tree"] = (
    f"SELECT repo, path, {_STATUS} AS status, k % 3 <> 0 AS has_content FROM ({corpora.planted_paths.sql()}) "
    f"WHERE {_STATUS} IN ('A', 'C', 'M', 'R', 'T')"
)

_HEX = "hex(encode(text))"
_LATIN1 = (
    f"array_to_string(list_transform(range(octet_length(encode(text))), "
    f"lambda i: chr(cast('0x' || substr({_HEX}, cast(2 * i + 1 AS int), 2) AS int))), '')"
)
_DECODED = f"CASE WHEN doc_id % 6 = 0 AND strlen(text) <> length(text) THEN {_LATIN1} ELSE text END"
SQL["decode_blob"] = f"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, {_DECODED} AS t FROM documents)"

SQL["split_lines"] = (
    "SELECT doc_id, cast(generate_subscripts(ls, 1) AS bigint) AS line, length(unnest(ls)) AS chars "
    "FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents)"
)

SQL["parse_raw_log"] = (
    f"WITH c AS ({corpora.planted_changes.sql()}) "
    "SELECT repo, cast(dense_rank() OVER (PARTITION BY repo ORDER BY commit_index) - 1 AS bigint) AS commit_index, commit_sha, epoch, new_mode, blob, status, "
    "concat(CASE WHEN pick % 7 = 0 THEN chr(1) WHEN pick % 7 = 1 THEN concat(':x', chr(10)) ELSE '' END, path) AS path FROM c"
)

SQL["parse_cut_log"] = SQL["parse_raw_log"]

SQL["load_dotenv_files"] = (
    f"SELECT repo, path FROM ({corpora.planted_paths.sql()}) WHERE {s.is_dotenv()} AND {s.env_searched()} "
    f"AND length <= 1048576 AND {s.env_depth()} <= 5"
)

SQL["skipped_dotenv_files"] = (
    f"SELECT repo, CASE WHEN {s.env_depth()} > 5 THEN 'env file too deep' ELSE 'env file too large' END AS caveat, count(*) AS n "
    f"FROM ({corpora.planted_paths.sql()}) WHERE {s.is_dotenv()} AND {s.env_searched()} AND (length > 1048576 OR {s.env_depth()} > 5) GROUP BY ALL"
)

SQL["read_tree"] = f"SELECT repo, k, md5(concat('content of ', path)) AS digest FROM ({corpora.planted_paths.sql()})"

SQL["load_allowlist"] = (
    "SELECT concat('nation', cast(s_suppkey AS varchar)) AS repo, cast(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS bigint) AS ord, "
    "concat(CASE WHEN s_suppkey % 3 = 0 THEN 'staged ' ELSE 'working ' END, s_name) AS text "
    "FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 <> 0"
)

# --- paths -------------------------------------------------------------------

for _name, _value in {
    "heuristic_exempt": s.exempt(),
    "is_code_file": s.is_code(),
    "is_env_template": s.is_template(),
    "is_dotenv_file": s.is_dotenv(),
    "filename_rule": f"cast({s.filename_ord()} AS bigint)",
}.items():
    SQL[_name] = f"SELECT repo, path, {_value} AS value FROM ({corpora.planted_paths.sql()})"

SQL["looks_binary"] = (
    "SELECT doc_id, " + s.binary("content") + " AS is_binary FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN concat(text, chr(0)) "
    "WHEN 2 THEN translate(text, 'aeiou ', concat(chr(1), chr(2), chr(3), chr(14), chr(31), chr(8))) "
    "WHEN 3 THEN translate(text, 'aeiou ', concat(chr(9), chr(10), chr(11), chr(12), chr(13), chr(1))) "
    "ELSE text END AS content FROM documents)"
)

_ALLOWED = (
    "CASE p_size % 5 WHEN 0 THEN regexp_matches(path, '^docs/') OR regexp_matches(path, '[.]env') "
    "WHEN 1 THEN regexp_matches(path, 'README') OR regexp_matches(path, '^client.*json$') "
    "WHEN 2 THEN contains(path, '([unclosed') OR contains(path, '(a+)+$') OR regexp_matches(path, 'secrets/') "
    "WHEN 3 THEN regexp_matches(path, '[.](rs|go|PY)$') "
    "ELSE regexp_matches(path, 'b.c') OR regexp_matches(path, '^x') END"
)
_ALLOW_ROWS = f"SELECT repo, path, {_ALLOWED} AS allowlisted FROM (SELECT *, cast(substr(repo, 5) AS int) AS p_size FROM ({corpora.planted_paths.sql()}))"
SQL["path_allowlisted"] = SQL["path_allowlisted_index"] = SQL["path_allowlisted_joins"] = _ALLOW_ROWS
SQL["apply_allowlist"] = f"SELECT repo, path FROM ({_ALLOW_ROWS}) WHERE NOT allowlisted"


def _lines(files: str) -> list[tuple[str, str]]:
    return [
        ("files", files),
        ("lines", "SELECT repo, path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM (SELECT repo, path, string_split_regex(content, '\\r?\\n') AS ls FROM files)"),
    ]


SQL["inline_allowed"] = query(
    _lines(corpora.planted_generic.sql()), f"SELECT repo, path, cast(line AS bigint) AS line, {s.MARKED} AS allowed FROM lines"
)

_PATTERN_ROWS = (
    f"SELECT k, CASE WHEN k % 7 = 0 THEN concat(p, repeat('x', 195)) ELSE p END AS pattern FROM (SELECT p_partkey AS k, "
    f"{s.listed(CYCLED_PATTERNS)}[p_partkey % {len(CYCLED_PATTERNS)} + 1] AS p FROM part)"
)
_RISKY = f"(length(pattern) > 200 OR {matches('pattern', chr(92) + '([^)]*[+*][^)]*' + chr(92) + f')[{s.WS}]*(?:[+*]|[{{][0-9]+,[{s.WS}]*[}}])')})"
SQL["is_risky_pattern"] = f"SELECT k, {_RISKY} AS risky FROM ({_PATTERN_ROWS})"
# Of the planted patterns these do not compile: an open group or class, a bare
# or doubled repeat, a range counting down.
_COMPILES = "NOT (contains(pattern, '([unclosed') OR starts_with(pattern, '*') OR contains(pattern, '{2,1}') OR contains(pattern, '**'))"
SQL["parse_allowlist"] = (
    f"SELECT concat('r', cast(k AS varchar)) AS repo, cast(1000000 + 1 AS bigint) AS ord, pattern, NOT {_RISKY} AND {_COMPILES} AS is_regex FROM ({_PATTERN_ROWS}) "
    "UNION ALL SELECT concat('r', cast(p_partkey AS varchar)), cast(1000000 + 4 AS bigint), concat('plain', cast(p_partkey AS varchar)), true FROM part"
)

_ENTRIES = [  # id, where, reason when it is the first of its id
    ("good-rule", '"good-rule"', None),
    (None, '"BadCase"', "id must be 2-40 characters of lowercase letters, digits and hyphens"),
    (None, '"github-pat"', "id is already used by a built-in rule"),
    ("good-rule", '"good-rule"', None),
    (None, '"no-regex"', "regex is required"),
    (None, '"bad-regex"', "regex does not compile"),
    (None, '"risky"', "regex is too long or backtracks catastrophically"),
    (None, '"flagged"', "flags may only be i, m, s or u"),
    (None, '"no-text"', "description is required"),
    (None, '"two-lines"', "description must be one line of at most 120 characters"),
    (None, None, "not an object"),
    (None, None, "id must be 2-40 characters of lowercase letters, digits and hyphens"),
    ("null-flags", '"null-flags"', None),
]
_ENTRY_ROWS = "(VALUES " + ", ".join(
    f"({n}, {text(i) if i else 'NULL'}, {text(w) if w else 'NULL'}, {text(r) if r else 'NULL'})" for n, (i, w, r) in enumerate(_ENTRIES, 1)
) + ") AS e(n, id, place, reason)"
_N = len(_ENTRIES)
SQL["parse_rule_pack"] = (
    "WITH packs AS (SELECT p_partkey AS k, p_size AS size FROM part), "
    "refused AS (SELECT k, CASE WHEN k % 29 = 0 THEN 'not valid JSON' WHEN k % 31 = 0 THEN 'expected an object with a \"rules\" array' END AS reason FROM packs), "
    f"picked AS (SELECT k, unnest([i for i in range(k % {_N} + 1, least(k % {_N} + 5, {_N + 1}))] || [i for i in range(1, size % 3 + 1)]) AS n, "
    f"generate_subscripts([i for i in range(k % {_N} + 1, least(k % {_N} + 5, {_N + 1}))] || [i for i in range(1, size % 3 + 1)], 1) AS pos "
    "FROM packs WHERE k % 29 <> 0 AND k % 31 <> 0 AND k % 37 <> 0), "
    f"judged AS (SELECT k, pos, id, place, reason, row_number() OVER (PARTITION BY k, id ORDER BY pos) AS nth FROM picked JOIN {_ENTRY_ROWS} USING (n)) "
    "SELECT concat('pack', cast(k AS varchar)) AS pack, cast(pos AS bigint) AS pos, coalesce(place, concat('rule ', cast(pos AS varchar))) AS place, "
    "CASE WHEN id IS NOT NULL AND nth > 1 THEN 'duplicate id' ELSE reason END AS reason FROM judged "
    "UNION ALL SELECT concat('pack', cast(k AS varchar)), 0, 'pack', reason FROM refused WHERE reason IS NOT NULL"
)

SQL["load_rule_packs"] = f"SELECT reason, count(*) AS n FROM ({SQL['parse_rule_pack']}) GROUP BY reason"

# --- line and context rules --------------------------------------------------

_LINES = corpora.planted_lines.sql()
_CONTEXT = corpora.planted_context.sql()
_K8S = corpora.planted_k8s.sql()
SQL["scan_provider"] = _places(_LINES, file_rules=False, layers=("provider",))
SQL["write_findings"] = f"SELECT *, 'description,line,path,repo,rule_id,rule_ord' AS columns FROM ({SQL['scan_provider']})"
SQL["scan_custom"] = _scan(
    _LINES,
    "SELECT repo, path, cast(line AS bigint) AS line, 'team-name' AS rule_id FROM live WHERE regexp_matches(text, '(?i)\\bcustomer#0+[1-9][0-9]*$') "
    "UNION ALL SELECT repo, path, line, 'quoted-run' FROM live WHERE regexp_matches(text, '\"[A-Z]{4}[0-9A-Za-z_]{16,}\"') "
    "UNION ALL SELECT repo, path, line, 'spaced' FROM live WHERE regexp_matches(text, '^v[[:space:]]=[[:space:]][^[:space:]]+$')",
    file_rules=False,
    layers=("provider",),
)
SQL["scan_gcp_sa"] = _places(_CONTEXT, "rule_ord = 2001", file_rules=False, layers=("context",))
SQL["scan_twilio_ctx"] = _places(_CONTEXT, "rule_ord = 2003", file_rules=False, layers=("context",))
SQL["scan_k8s_secret"] = _places(_K8S, file_rules=False, layers=("k8s",))
SQL["yaml_secret_windows"] = query(
    [*_lines(_K8S), *s.k8s_ctes("lines")], "SELECT repo, path, cast(line AS bigint) AS line FROM k8s_hits"
)

# --- heuristic layer ---------------------------------------------------------

_GENERIC = corpora.planted_generic.sql()
_CANDIDATES = [*_lines(_GENERIC), *s.candidates("lines", "repo, path, line")]
SQL["generic_candidates"] = query(
    _CANDIDATES, "SELECT repo, path, cast(line AS bigint) AS line, length(context) AS starts, md5(value) AS digest FROM candidates"
)
SQL["is_hardcoded"] = query(
    [
        *_CANDIDATES,
        ("both_kinds", "SELECT *, true AS code FROM candidates UNION ALL SELECT *, false FROM candidates"),
        *s.hardcoded("both_kinds", "repo, path, line, context, code", "code"),
    ],
    "SELECT repo, path, cast(line AS bigint) AS line, length(context) AS starts, bool_or(hardcoded) FILTER (WHERE code) AS in_code, "
    "bool_or(hardcoded) FILTER (WHERE NOT code) AS in_config FROM judged GROUP BY repo, path, line, context",
)
_VALUES = corpora.planted_values.sql()
SQL["is_placeholder"] = f"SELECT k, {matches('value', s.VALUE_PLACEHOLDER)} AS verdict FROM ({_VALUES})"
SQL["is_route_template"] = f"SELECT k, {s.route('value')} AS verdict FROM ({_VALUES})"
SQL["echoes_key"] = f"SELECT k, {s.echo('value', 'key_context')} AS verdict FROM ({_VALUES})"
SQL["scan_generic"] = _places(_GENERIC, file_rules=False, layers=("generic",))

_TOKENS = corpora.planted_entropy.sql()
SQL["shannon_entropy"] = f"SELECT path, cast(round({s.entropy('token')} * 1000000) AS bigint) AS microbits FROM ({_TOKENS})"
SQL["entropy_candidates"] = (
    f"SELECT path, cast(len(parts) AS bigint) AS parts, cast(list_max(list_transform(parts, lambda p: length(p))) AS bigint) AS longest "
    f"FROM (SELECT path, {s.entropy_parts('token')} AS parts FROM ({_TOKENS}))"
)
SQL["looks_like_identifier"] = f"SELECT path, {s.identifier('token')} AS verdict FROM ({_TOKENS})"
SQL["scan_entropy"] = _places(ENTROPY_FILES, file_rules=False, layers=("entropy",))

# --- env files ---------------------------------------------------------------

_ENV = corpora.planted_env.sql()
_USERS = corpora.planted_users.sql()
_PAIRS = [("env_files", _ENV), *s.assignments("env_files")]
_SECRETS = [*_PAIRS, ("env_secrets", s.secrets())]
SQL["parse_dotenv"] = query(_PAIRS, "SELECT repo, path, cast(line AS bigint) AS line, key, md5(value) AS digest FROM env_pairs")
SQL["is_dotenv_secret"] = query(_PAIRS, f"SELECT repo, path, cast(line AS bigint) AS line, {s.env_secret()} AS verdict FROM env_pairs")
_BEFORE = f"regexp_extract(content, {s.standalone('value')}, 1)"
SQL["word_boundary_position"] = query(
    [
        *_PAIRS,
        ("users", _USERS),
        ("pairs", "SELECT u.repo, u.path, key, u.content, value FROM users u JOIN env_pairs e ON u.repo = e.repo "
                  "AND regexp_extract(u.path, '^[^/]*') = regexp_extract(e.path, '^[^/]*') WHERE value <> ''"),
    ],
    f"SELECT repo, path, key, CASE WHEN regexp_matches(content, {s.standalone('value')}) "
    f"THEN cast(1 + length({_BEFORE}) - length(replace({_BEFORE}, chr(10), '')) AS bigint) END AS line FROM pairs",
)
SQL["xref_dotenv"] = _places(_USERS, "rule_ord = 10", _SECRETS, secrets_from="env_secrets", layers=())
SQL["xref_dotenv_large"] = query(
    [("files", _USERS), *_SECRETS, *s.value_lines("files", "env_secrets")],
    "SELECT repo, path, cast(line AS bigint) AS line FROM value_lines",
)
SQL["dotenv_coverage"] = query(
    [
        *_SECRETS,
        ("counted", "SELECT repo, count(*) AS secret_count FROM env_secrets GROUP BY repo"),
        ("listed", "SELECT repo, array_to_string(list_sort(list(DISTINCT path))[1:4], ',') AS files, count(DISTINCT path) AS file_count FROM env_files GROUP BY repo"),
    ],
    "SELECT repo, files, file_count, coalesce(secret_count, 0) AS secret_count, CASE WHEN secret_count > 0 THEN 'PASS' ELSE 'WARN' END AS status "
    "FROM listed LEFT JOIN counted USING (repo)",
)

# --- history -----------------------------------------------------------------

_HISTORY = [
    ("changes", corpora.planted_changes.sql()),
    ("versions", "SELECT repo, blob, path, commit_index, commit_sha, epoch FROM (SELECT *, row_number() OVER (PARTITION BY repo, blob, path ORDER BY commit_index, seq) AS nth "
                 f"FROM changes WHERE status <> 'D' AND blob <> '{NULL_BLOB}' AND new_mode IN ('100644', '100755', '120000')) WHERE nth = 1"),
    ("blobs", f"SELECT DISTINCT repo, blob, size, content FROM ({corpora.planted_blobs.sql()}) WHERE kind <> 5"),
    ("head", "SELECT DISTINCT repo, blob, path FROM changes WHERE commit_index % 3 = 0 AND status <> 'D'"),
    ("classified", "SELECT v.*, b.size, b.content, CASE WHEN v.repo LIKE '%4' AND (regexp_matches(path, 'docs/') OR regexp_matches(path, '^f7[.]')) THEN 'allowlisted' "
                   "WHEN b.size IS NULL THEN 'unavailable' WHEN b.size > 10485760 THEN 'oversized' ELSE 'scan' END AS status "
                   "FROM versions v LEFT JOIN blobs b USING (repo, blob)"),
]
# A version's place in a scan is its path plus its blob, so that versions of one path stay apart.
_KEYED = "SELECT repo, concat(blob, chr(1), path) AS path, content, path AS real_path FROM {source} WHERE content IS NOT NULL"


def _history(final: str, audit: bool = False) -> str:
    status = "status = 'scan'" if not audit else "status <> 'unavailable' AND status <> 'oversized'"
    base = list(_HISTORY)
    if audit:
        base[-1] = (
            "classified",
            "SELECT v.*, b.size, b.content, CASE WHEN b.size IS NULL THEN 'unavailable' WHEN b.size > 10485760 THEN 'oversized' ELSE 'scan' END AS status "
            "FROM versions v LEFT JOIN blobs b USING (repo, blob)",
        )
    base.append(("settled", "SELECT * REPLACE (CASE WHEN status = 'scan' AND content IS NULL THEN 'unavailable' ELSE status END AS status) FROM classified"))
    base.append(("files", f"SELECT repo, concat(blob, '/', path) AS path, content FROM settled WHERE {status}"))
    scan = s.scan_ctes("files", ignore_markers=audit)
    attributed = (
        "attributed",
        "SELECT v.repo, v.blob, v.path, f.line, f.rule_ord, r.rule_id, r.description, v.commit_index, v.commit_sha, v.epoch, h.blob IS NOT NULL AS in_head "
        f"FROM findings f JOIN settled v ON f.repo = v.repo AND f.path = concat(v.blob, '/', v.path) JOIN {s.RULES.replace('AS rules', 'AS r')} ON f.rule_ord = r.rule_ord "
        "LEFT JOIN head h ON h.repo = v.repo AND h.blob = v.blob AND h.path = v.path",
    )
    return query([*base, *scan, attributed], final)


SQL["introduce_versions"] = query(_HISTORY[:2], "SELECT repo, blob, path, commit_index, commit_sha, epoch FROM versions")
SQL["distinct_blobs"] = query(_HISTORY[:2], "SELECT repo, blob, count(*) AS paths FROM versions GROUP BY repo, blob")
SQL["classify_versions"] = query(_HISTORY, "SELECT repo, blob, path, status FROM classified")
SQL["fetch_contents"] = query(
    _HISTORY,
    "SELECT DISTINCT repo, blob, CASE WHEN content IS NULL THEN 'unavailable' ELSE 'scan' END AS state, md5(content) AS digest FROM classified WHERE status = 'scan'",
)
SQL["flag_in_head"] = query(
    [*_HISTORY[:2], _HISTORY[3]],
    "SELECT v.repo, v.blob, v.path, h.blob IS NOT NULL AS in_head FROM versions v LEFT JOIN head h USING (repo, blob, path)",
)
_PLACES = "SELECT repo, blob, path, cast(line AS bigint) AS line, rule_id, commit_index, in_head FROM attributed"
SQL["scan_whole_history"] = _history(_PLACES)
SQL["audit_history"] = _history(_PLACES, audit=True)
SQL["order_findings"] = _history(_PLACES)
_COVERAGE = (
    "SELECT c.repo, c.commits, coalesce(versions, 0) AS versions, coalesce(scanned, 0) AS scanned, coalesce(allowlisted, 0) AS allowlisted, "
    "coalesce(oversized, 0) AS oversized, coalesce(unavailable, 0) AS unavailable, coalesce(findings, 0) AS findings, "
    "coalesce(commits_with_findings, 0) AS commits_with_findings "
    "FROM (SELECT repo, count(DISTINCT commit_index) AS commits FROM changes GROUP BY repo) c "
    "LEFT JOIN (SELECT repo, count(*) AS versions, count(*) FILTER (WHERE status = 'scan') AS scanned, count(*) FILTER (WHERE status = 'allowlisted') AS allowlisted, "
    "count(*) FILTER (WHERE status = 'oversized') AS oversized, count(*) FILTER (WHERE status = 'unavailable') AS unavailable FROM settled GROUP BY repo) v USING (repo) "
    "LEFT JOIN (SELECT repo, count(*) AS findings, count(DISTINCT commit_index) AS commits_with_findings FROM attributed GROUP BY repo) f USING (repo)"
)
SQL["history_coverage"] = _history(_COVERAGE)
_DATE = "strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y-%m-%d')"
SQL["findings_by_commit"] = _history(
    f"SELECT repo, commit_index, substr(commit_sha, 1, 12) AS commit, {_DATE} AS date, count(*) AS findings, count(DISTINCT path) AS files, "
    "count(*) FILTER (WHERE in_head) AS still_in_head FROM attributed GROUP BY repo, commit_index, commit_sha, epoch"
)
SQL["commit_lines"] = _history(
    f"SELECT repo, substr(commit_sha, 1, 12) AS commit, {_DATE} AS date, concat(path, CASE WHEN line > 0 THEN concat(':', cast(line AS varchar)) ELSE '' END, "
    "'  [', rule_id, '] ', description, CASE WHEN in_head THEN '  (still in HEAD)' ELSE '' END) AS text FROM attributed"
)
SQL["top_oversized"] = _history(
    "SELECT repo, cast(position AS bigint) AS position, concat(path, ' @ ', substr(commit_sha, 1, 12), ' (', printf('%.1f', size / 1048576), ' MB)') AS label, "
    "cast(greatest(total - 10, 0) AS bigint) AS more FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_index, path, blob) AS position, "
    "count(*) OVER (PARTITION BY repo) AS total FROM settled WHERE status = 'oversized') WHERE position <= 10"
)
SQL["caveats"] = (
    f"WITH cover AS ({_history(_COVERAGE)}), packs AS ({SQL['parse_rule_pack']}) "
    "SELECT repo, caveat, n FROM (SELECT repo, unnest(['allowlisted', 'oversized', 'unavailable']) AS caveat, unnest([allowlisted, oversized, unavailable]) AS n FROM cover) WHERE n > 0 "
    "UNION ALL SELECT repo, 'shallow', 1 FROM cover WHERE repo LIKE '%7' "
    "UNION ALL SELECT NULL, 'invalid rules', count(*) FROM packs WHERE reason IS NOT NULL"
)

# --- reports over scans of files ---------------------------------------------

_FILE_LEVEL = (
    "SELECT f.repo, f.files, f.unavailable, coalesce(n, 0) AS findings, coalesce(with_findings, 0) AS files_with_findings FROM "
    "(SELECT repo, count(*) AS files, count(*) FILTER (WHERE content IS NULL) AS unavailable FROM files GROUP BY repo) f "
    "LEFT JOIN (SELECT repo, count(*) AS n, count(DISTINCT path) AS with_findings FROM findings GROUP BY repo) g USING (repo)"
)
SQL["coverage_summary"] = _scan(DOCUMENTS, _FILE_LEVEL)
_PASSWORD_LINE = text("password: 'orange7secret'")
SQL["coverage_of_tables"] = _scan(
    f"SELECT repo, path, CASE WHEN k % 3 <> 0 THEN {_PASSWORD_LINE} END AS content FROM ({corpora.planted_paths.sql()})", _FILE_LEVEL
)
_NAMED = f"findings JOIN {s.RULES} USING (rule_ord)"
SQL["findings_by_file"] = _scan(
    _LINES,
    f"SELECT repo, path, count(*) AS findings, cast(min(line) AS bigint) AS first_line, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM {_NAMED} GROUP BY repo, path",
)
_NAMES_ONLY = f"SELECT repo, path, 'k = ''x''' AS content FROM ({corpora.planted_paths.sql()})"
SQL["finding_lines"] = _scan(
    f"{_NAMES_ONLY} UNION ALL {_CONTEXT}",
    f"SELECT repo, path, concat('[', rule_id, '] ', description, ' (', CASE WHEN line > 0 THEN concat('line ', cast(line AS varchar)) ELSE 'file' END, ')') AS text FROM {_NAMED}",
)
SQL["findings_by_rule"] = _scan(_LINES, f"SELECT rule_id, count(*) AS findings FROM {_NAMED} GROUP BY rule_id")
_EVERY_LAYER = " UNION ALL ".join(
    f"SELECT concat('{kind}/', repo) AS repo, path, {content} AS content FROM ({files})"
    for kind, files, content in (
        ("entropy", ENTROPY_FILES, "content"),
        ("lines", _LINES, "content"),
        ("context", corpora.planted_context.sql(), "content"),
        ("k8s", corpora.planted_k8s.sql(), "content"),
        ("generic", _GENERIC, "content"),
        ("paths", corpora.planted_paths.sql(), "NULL"),
    )
)
SQL["findings_by_layer"] = _scan(
    f"{_EVERY_LAYER} UNION ALL SELECT repo, path, content FROM ({_USERS})",
    f"SELECT layer, count(*) AS findings FROM {_NAMED} GROUP BY layer",
    _SECRETS,
    secrets_from="env_secrets",
)
SQL["findings_by_repo_rule"] = _scan(_LINES, f"SELECT repo, rule_id, count(*) AS findings FROM {_NAMED} GROUP BY ROLLUP (repo, rule_id)")
_DECISION = (
    "SELECT repo, coalesce(n, 0) AS findings, coalesce(n, 0) > 0 AS blocked, cast(CASE WHEN n > 0 THEN 1 ELSE 0 END AS bigint) AS exit_code "
    "FROM (SELECT DISTINCT repo FROM files) LEFT JOIN (SELECT repo, count(*) AS n FROM findings GROUP BY repo) USING (repo)"
)
SQL["gate"] = _scan(_GENERIC, _DECISION)
SQL["merge_findings"] = _scan(
    _CONTEXT,
    f"SELECT repo, path, cast(line AS bigint) AS line, rule_id FROM {_NAMED} UNION ALL SELECT repo, path, 1, 'external-rule' FROM ({_K8S})",
)
SQL["scan_text"] = _places(DOCUMENTS, file_rules=False)
SQL["scan_pages"] = _places(PAGES, file_rules=False)
SQL["scan_conversations"] = _scan(
    f"SELECT repo, path, concat(content, CASE WHEN cast(regexp_extract(path, '[0-9]+') AS bigint) % 3 = 0 "
    f"THEN concat(chr(10), 'DB_PASS=z', substr(md5(content), 1, 12)) ELSE '' END) AS content FROM ({CONVERSATIONS})", f"SELECT repo, rule_id, count(*) AS findings FROM {_NAMED} GROUP BY repo, rule_id", file_rules=False
)
SQL["findings_by_label"] = _scan(
    DOCUMENTS,
    "SELECT quality, cast(sum(n) AS bigint) AS findings FROM (SELECT cast(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS bigint) AS doc_id, count(*) AS n FROM findings GROUP BY 1) "
    "LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY quality",
    file_rules=False,
)
SQL["scan_file_content"] = _places(
    f"SELECT repo, path, content FROM ({_USERS}) UNION ALL SELECT repo, path, content FROM ({_ENV}) "
    f"UNION ALL SELECT repo, concat(path, '.example'), content FROM ({_ENV}) UNION ALL SELECT repo, path, NULL FROM ({corpora.planted_paths.sql()})",
    extra=_SECRETS,
    secrets_from="env_secrets",
)
SQL["scan_change_set"] = _places(
    f"SELECT repo, path, content FROM ({_GENERIC}) WHERE substr('ACMRTDUX', cast(length(content) % 8 + 1 AS int), 1) IN ('A', 'C', 'M', 'R', 'T') "
    "AND NOT regexp_matches(path, 'm1[0-9]*[.]js$') AND NOT regexp_matches(path, '9.py')"
)

# --- streaming ---------------------------------------------------------------

SQL["stream_scan"] = _places(_LINES)
SQL["stream_env_values"] = SQL["xref_dotenv"]
SQL["stream_first_seen"] = (
    f"SELECT DISTINCT repo, blob, path FROM ({corpora.planted_changes.sql()}) "
    "WHERE status <> 'D' AND blob <> repeat('0', 40) AND new_mode IN ('100644', '100755', '120000')"
)
SQL["stream_introduced"] = query(_HISTORY[:2], "SELECT repo, blob, path, commit_index FROM versions")
SQL["stream_gate"] = SQL["gate"].replace("SELECT repo, coalesce(n, 0) AS findings, coalesce", "SELECT repo AS change_set, coalesce(n, 0) AS findings, coalesce")
