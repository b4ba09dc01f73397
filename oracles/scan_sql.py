"""The scan restated in plain SQL, as common table expressions.

Written for an engine with RE2 regular expressions (no look-around): what
needs a look-around is restated over maximal runs or list elements.
"""

from __future__ import annotations

from oracles.fixed import (
    CATALOGUE,
    CODE_EXTENSIONS,
    DOC_DIRECTORIES,
    DOC_EXTENSIONS,
    ENV_SKIP_DIRECTORIES,
    ENV_TEMPLATE_SUFFIXES,
    GENERATED_DIRECTORIES,
    I18N_DIRECTORIES,
    LOCKFILES,
    PROVIDER_SHAPES,
    SECRET_FILE_NAMES,
    SECRET_FILE_SUFFIXES,
)

# The white space class, as RE2 spells it.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TRIM = "concat(" + ", ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)) + ")"
DOT = r"[^\n\r\x{2028}\x{2029}]"
KEYWORDS = (
    "passwd|password|passphrase|pwd|pass|secret(?:[_-]?key)?|token|access[_-]?token|authorization|"
    "auth(?:[_-]?token)?|bearer|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|private[_-]?key|"
    "encryption[_-]?key|signing[_-]?key|session[_-]?key|connection[_-]?string|conn[_-]?str|credentials?"
)
_SHARED = (
    f"your[_-]{DOT}*|my[_-]{DOT}*|{DOT}*[_-]here|changeme|change[_-]?me|example|placeholder|redacted|dummy|"
    "sample|todo|tbd|xxx+"
)
VALUE_PLACEHOLDER = (
    f"(?i)^(?:{_SHARED}|your|my|the|test|none|null|nil|undefined|true|false|x{{3,}}|\\*+|password|passwd|"
    "secret|token|value|string|auth|authorization|key|apikey|api[_-]?key|credentials?)$"
)
ENV_PLACEHOLDER = (
    f"(?i)^(?:{_SHARED}|true|false|null|none|undefined|localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|development|"
    "production|staging|test)$"
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def trim(column: str) -> str:
    return f"trim({column}, {TRIM})"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {text(pattern)}))"


# --- paths -----------------------------------------------------------------

def base_name(path: str = "path") -> str:
    return f"lower(regexp_extract({path}, '([^/]*)/*$', 1))"


def extension(name: str) -> str:
    return f"regexp_extract({name}, '^.+[.]([^.]*)$', 1)"


def exempt(path: str = "path") -> str:
    parts = f"list_filter(string_split(lower(replace({path}, chr(92), '/')), '/'), lambda s: s <> '')"
    name = f"coalesce(({parts})[-1], '')"
    directories = f"({parts})[1:len({parts}) - 1]"
    return (
        f"CASE WHEN list_has_any({directories}, {listed(I18N_DIRECTORIES)}) THEN 'i18n' "
        f"WHEN list_has_any({directories}, {listed(DOC_DIRECTORIES)}) THEN 'docs' "
        f"WHEN list_has_any({directories}, {listed(GENERATED_DIRECTORIES)}) THEN 'generated' "
        f"WHEN list_contains({listed(DOC_EXTENSIONS)}, {extension(name)}) THEN 'docs' "
        f"WHEN list_contains({listed(LOCKFILES)}, {name}) THEN 'generated' "
        f"WHEN regexp_matches({name}, '([.]min[.]js|[.]min[.]css|[.]map)$') THEN 'generated' END"
    )


def is_code(path: str = "path") -> str:
    return f"list_contains({listed(CODE_EXTENSIONS)}, {extension(base_name(path))})"


def is_template(path: str = "path") -> str:
    name = base_name(path)
    return (
        f"(starts_with({name}, '.env.') AND "
        f"list_contains({listed(ENV_TEMPLATE_SUFFIXES)}, regexp_extract({name}, '([^.]*)$', 1)))"
    )


def is_dotenv(path: str = "path") -> str:
    name = base_name(path)
    return f"({name} = '.env' OR (starts_with({name}, '.env.') AND NOT {is_template(path)}))"


def filename_ord(path: str = "path") -> str:
    name = base_name(path)
    suffixes = "|".join(s[1:] for s in SECRET_FILE_SUFFIXES)
    return (
        f"CASE WHEN {name} = '.env' THEN 1 WHEN starts_with({name}, '.env.') AND NOT {is_template(path)} THEN 2 "
        f"WHEN list_contains({listed(SECRET_FILE_NAMES)}, {name}) THEN 3 "
        f"WHEN regexp_matches({name}, '[.]({suffixes})$') THEN 4 END"
    )


def env_searched(path: str = "path") -> str:
    parts = f"list_filter(string_split(lower({path}), '/'), lambda s: s <> '')"
    directories = f"({parts})[1:len({parts}) - 1]"
    return f"(NOT list_has_any({directories}, {listed(ENV_SKIP_DIRECTORIES)}))"


def env_depth(path: str = "path") -> str:
    return f"(len(list_filter(string_split({path}, '/'), lambda s: s <> '')) - 1)"


# --- keyword assignments ---------------------------------------------------

def echo(value: str, context: str) -> str:
    key = f"regexp_extract({context}, {text(f'([A-Za-z_][A-Za-z0-9_.$-]*)[{WS}]*[' + chr(34) + chr(39) + f'`]?[{WS}]*[:=][{WS}]*$')}, 1)"
    flat = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    letters = f"length(regexp_replace({value}, '[^A-Za-z]', '', 'g'))"
    return (
        f"(regexp_matches({value}, '^[A-Za-z][A-Za-z_-]*$') AND {letters} >= 4 "
        f"AND {count(value, '[aeiouAEIOU]')} / {letters} >= 0.3 AND length({flat(value)}) >= 4 "
        f"AND contains({flat(key)}, {flat(value)}))"
    )


def route(value: str) -> str:
    word = "regexp_replace(s, '^:', '')"
    digits = count(word, "[0-9]")
    letters = f"length(regexp_replace({word}, '[^a-z]', '', 'g'))"
    good = (
        f"regexp_matches({word}, '^[a-z][a-z0-9-]*$') AND length({word}) <= 20 "
        f"AND NOT ({digits} > 2 AND {digits} / length({word}) > 0.15) "
        f"AND NOT regexp_matches({word}, '[bcdfghjklmnpqrstvwxyz]{{7}}') "
        f"AND (length({word}) < 12 OR {count(word, '[aeiou]')} / {letters} >= 0.25)"
    )
    segments = f"list_filter(string_split({value}, '/'), lambda s: s <> '')"
    return (
        f"(regexp_matches({value}, '/:[A-Za-z_]') AND len(list_filter({segments}, lambda s: NOT ({good}))) = 0)"
    )


def candidates(lines: str, keep: str) -> list[tuple[str, str]]:
    """CTEs ending in ``candidates(keep, text, value, context)`` for table ``lines(keep, text)``."""
    tail = f"^(?:[A-Z][a-z0-9]*)?[\"'`]?[{WS}]*[:=][{WS}]*([^{WS}]{DOT}*)$"
    return [
        ("parts", f"SELECT {keep}, text, string_split(regexp_replace(text, {text(f'((?i:{KEYWORDS}))')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM {lines}"),
        ("marks", f"SELECT {keep}, text, p, unnest(range(2, len(p) + 1)) AS i FROM parts WHERE len(p) > 1"),
        ("around", f"SELECT {keep}, text, right(replace(p[i - 1], chr(2), ''), 1) AS before, left(p[i], 1) AS first, "
                   "string_split(p[i], chr(2))[-1] || replace(array_to_string(p[i + 1:len(p)], ''), chr(2), '') AS rest FROM marks"),
        ("assigned", f"SELECT {keep}, text, regexp_extract(rest, {text(tail)}, 1) AS value FROM around "
                     "WHERE before = '' OR NOT regexp_matches(before, '[A-Za-z0-9]') OR (regexp_matches(before, '[a-z0-9]') AND regexp_matches(first, '[A-Z]'))"),
        ("candidates", f"SELECT {keep}, text, value, left(text, length(text) - length(value)) AS context FROM assigned WHERE value <> ''"),
    ]


def hardcoded(source: str, keep: str, code: str) -> list[tuple[str, str]]:
    """CTEs ending in ``judged(keep, hardcoded)`` for ``source(keep, value, context)``."""
    schemes = f"(?i)^(?:bearer|basic|digest|negotiate|oauth|jwt|token|apikey|api[_-]?key)\\b[{WS}:]*"
    roots = ("(?i)^(process|import|globalThis|window|os|System|Deno|ENV|env|config|configService|vault|secret|"
             "secrets|settings)$")
    unquoted = "NOT quoted AND "
    return [
        ("trimmed", f"SELECT *, {trim('value')} AS v0 FROM {source}"),
        ("prefixed", "SELECT *, regexp_replace(v0, '^[fFrRbBuU]{1,2}([\"''`])', '\\1') AS v1 FROM trimmed"),
        ("quotes", "SELECT *, left(v1, 1) IN ('\"', '''', '`') AS quoted, instr(substr(v1, 2), left(v1, 1)) AS closing FROM prefixed"),
        ("inner_text", "SELECT *, CASE WHEN NOT quoted THEN v1 WHEN closing > 0 THEN substr(v1, 2, closing - 1) END AS v2 FROM quotes"),
        ("unlabelled", f"SELECT *, {trim(f'regexp_replace(v2, {text(schemes)}, {text(str())})')} AS v3 FROM inner_text"),
        ("final_text", f"SELECT *, {trim('CASE WHEN quoted THEN v3 ELSE regexp_replace(regexp_extract(v3, ' + text(f'^[^{WS},;)}}' + chr(92) + ']]*') + '), ' + text('[\"' + chr(39) + '`]+$') + ', ' + text('') + ') END')} AS t FROM unlabelled"),
        ("judged", f"SELECT {keep}, CASE WHEN t IS NULL OR length(t) < 4 THEN false "
                   f"WHEN {matches('t', '^[,;:)' + chr(92) + ']}?]')} THEN false "
                   f"WHEN {matches('t', r'[$][{]|[{][{]|%[(]|<%|#[{]|[{][A-Za-z_][0-9A-Za-z_.]*[}]')} THEN false "
                   f"WHEN {route('t')} THEN false "
                   f"WHEN {unquoted} {matches('t', '^[$]|[.(]')} THEN false "
                   f"WHEN {unquoted} {matches('t', roots)} THEN false "
                   f"WHEN {unquoted} {code} AND {matches('t', '^[A-Za-z_$][0-9A-Za-z_$]*$')} THEN false "
                   f"WHEN NOT {code} AND {matches('t', '[^' + chr(92) + 'P{L}' + chr(92) + 'p{Latin}]')} AND NOT {matches('t', '[A-Za-z0-9]')} THEN false "
                   f"WHEN {matches('t', '^[A-Z][A-Z0-9_]{2,}$')} THEN false "
                   f"WHEN {matches('t', VALUE_PLACEHOLDER)} THEN false "
                   f"WHEN {echo('t', 'context')} THEN false "
                   f"WHEN t = '...' OR {matches('t', f'^<{DOT}*>$')} THEN false ELSE true END AS hardcoded FROM final_text"),
    ]


# --- entropy ---------------------------------------------------------------

def entropy(value: str) -> str:
    share = f"((length({value}) - length(replace({value}, c, ''))) / length({value}))"
    return (
        f"CASE WHEN length({value}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({value}, '')), "
        f"lambda c: {share} * log2({share}))) END"
    )


def name_like(s: str) -> str:
    letters = f"length(regexp_replace({s}, '[^A-Za-z]', '', 'g'))"
    digits = count(s, "[0-9]")
    return (
        f"(regexp_matches({s}, '^[.]?[A-Za-z][A-Za-z0-9_.-]*$') AND ({digits} <= 2 OR {digits} / length({s}) <= 0.15) "
        f"AND (length({s}) < 8 OR regexp_matches({s}, '^[A-Z][A-Z0-9_]*$') "
        f"OR {count(s, '[aeiouAEIOU]')} / {letters} >= 0.3))"
    )


def entropy_parts(token: str) -> str:
    segments = f"list_filter(string_split({token}, '/'), lambda s: s <> '')"
    return (
        f"CASE WHEN contains({token}, '/') AND len({segments}) >= 2 "
        f"AND len(list_filter({segments}, lambda s: NOT {name_like('s')})) = 0 THEN {segments} ELSE [{token}] END"
    )


def identifier(token: str) -> str:
    digits = count(token, "[0-9]")
    return (
        f"(regexp_matches({token}, '^[A-Za-z_][A-Za-z0-9_]*$') AND ({digits} <= 2 OR {digits} / length({token}) <= 0.15) "
        f"AND {count(token, '[aeiouAEIOU]')} / length({token}) >= 0.3)"
    )


def binary(content: str = "content") -> str:
    control = "[" + chr(92) + "x01-" + chr(92) + "x08" + chr(92) + "x0E-" + chr(92) + "x1F]"
    return f"(contains({content}, chr(0)) OR {count(content, control)} / greatest(length({content}), 1) > 0.3)"


# --- dotenv ----------------------------------------------------------------

ASSIGNMENT = f"^[{WS}]*(?:export[{WS}]+)?([A-Za-z_][A-Za-z0-9_]*)[{WS}]*=[{WS}]*({DOT}*)$"


def assignments(env_files: str) -> list[tuple[str, str]]:
    """CTEs ending in ``env_pairs(repo, path, line, key, value)``."""
    raw = f"regexp_extract(text, {text(ASSIGNMENT)}, 2)"
    cut = f"regexp_extract(raw, {text('^((?s:.*?))(?:[' + WS + ']+#|$)')}, 1)"
    return [
        ("env_lines", f"SELECT repo, path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM (SELECT repo, path, string_split_regex(content, '\\r?\\n') AS ls FROM {env_files})"),
        ("env_raw", f"SELECT repo, path, line, regexp_extract(text, {text(ASSIGNMENT)}, 1) AS key, {trim(raw)} AS raw FROM env_lines WHERE {matches('text', ASSIGNMENT)}"),
        ("env_pairs", f"SELECT repo, path, line, key, CASE WHEN left(raw, 1) IN ('\"', '''', '`') AND right(raw, 1) = left(raw, 1) "
                      f"THEN substr(raw, 2, greatest(length(raw) - 2, 0)) ELSE {trim(cut)} END AS value FROM env_raw"),
    ]


def env_secret(key: str = "key", value: str = "value") -> str:
    return (
        f"(length({value}) >= 6 AND NOT {matches(value, ENV_PLACEHOLDER)} AND NOT {matches(value, '^[0-9]+$')} "
        f"AND NOT {matches(value, '^#?([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$')} "
        f"AND CASE WHEN {matches(key, '(?i)(pass|pwd|secret|token|key|auth|cred|api|private|access|signature|salt)')} "
        f"THEN length({value}) >= 10 ELSE length({value}) >= 12 AND {matches(value, '[A-Za-z]')} AND {matches(value, '[0-9]')} END)"
    )


def secrets(pairs: str = "env_pairs") -> str:
    place = "lpad(cast(len(string_split(path, '/')) AS varchar), 3, '0') || '/' || path || chr(1) || lpad(cast(line AS varchar), 10, '0')"
    return f"SELECT repo, value, min({place}) AS ord FROM {pairs} WHERE {env_secret()} GROUP BY repo, value"


def standalone(value: str) -> str:
    """Pattern of everything up to ``value`` where it is not part of a longer
    word, as a SQL expression; group 1 is what stands before it."""
    edge = "'[0-9A-Za-z_]'"
    return (
        f"('^((?s:.*?)' || CASE WHEN regexp_matches(left({value}, 1), {edge}) THEN '(?:^|[^0-9A-Za-z_])' ELSE '' END || ')' || "
        f"regexp_escape({value}) || "
        f"CASE WHEN regexp_matches(right({value}, 1), {edge}) THEN '(?:$|[^0-9A-Za-z_])' ELSE '' END)"
    )


def value_lines(files: str, secrets_table: str) -> list[tuple[str, str]]:
    """CTEs ending in ``value_lines(repo, path, line)``: the first listed value found per file."""
    return [
        ("value_hits", f"SELECT f.repo, f.path, s.ord, regexp_extract(f.content, {standalone('s.value')}, 1) AS before "
                       f"FROM {files} f JOIN {secrets_table} s ON f.repo = s.repo AND contains(f.content, s.value) "
                       f"WHERE regexp_matches(f.content, {standalone('s.value')})"),
        ("value_lines", "SELECT repo, path, 1 + length(b) - length(replace(b, chr(10), '')) AS line "
                        "FROM (SELECT repo, path, min_by(before, ord) AS b FROM value_hits GROUP BY repo, path)"),
    ]


# --- the whole scan --------------------------------------------------------

def _entra(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[A-Za-z0-9._~-]+')"
    return (
        f"len(list_filter({runs}, lambda r: length(r) = 40 AND "
        "regexp_matches(r, '^[A-Za-z0-9._-]{2,8}~[A-Za-z0-9._~-]+$'))) > 0"
    )


def provider_match(rule, column: str = "text") -> str:
    if rule.id == "azure-entra-client-secret":
        return _entra(column)
    shape = rule.shape
    if rule.id == "vonage-api-secret":
        shape = shape.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "(?:$|[^A-Za-z0-9])")
    shape = shape.replace(r"/\s:@", f"/{WS}:@").replace(r"\s", f"[{WS}]")
    return matches(column, ("(?i)" if rule.any_case else "") + shape)


def k8s_ctes(source: str = "lines") -> list[tuple[str, str]]:
    """CTEs ending in ``k8s_hits(repo, path, line)``."""
    indent = f"(length(text) - length(ltrim(text, {TRIM})))"
    value = f"^[{WS}]*[A-Za-z0-9._-]+:[{WS}]*[\"']?[A-Za-z0-9+/]{{8,}}={{0,2}}[\"']?[{WS}]*$"
    return [
        ("k8s_docs", f"SELECT *, sum(CASE WHEN {matches('text', f'^---[{WS}]*$')} THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line) AS doc FROM {source}"),
        ("k8s_kinds", f"SELECT *, max(CASE WHEN {matches('text', f'^[{WS}]*kind:[{WS}]*[' + chr(34) + chr(39) + f']?Secret[' + chr(34) + chr(39) + f']?[{WS}]*$')} THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path, doc) AS secret, "
                      f"{matches('text', f'^[{WS}]*(?:data|stringData):[{WS}]*$')} AS opens FROM k8s_docs"),
        ("k8s_blocks", "SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path, doc ORDER BY line) AS block FROM k8s_kinds WHERE secret = 1"),
        ("k8s_inside", f"SELECT *, min(CASE WHEN NOT opens AND {trim('text')} <> '' THEN {indent} END) OVER (PARTITION BY repo, path, doc, block ORDER BY line) > "
                       f"max(CASE WHEN opens THEN {indent} END) OVER (PARTITION BY repo, path, doc, block) AS inside FROM k8s_blocks WHERE block > 0"),
        ("k8s_hits", f"SELECT repo, path, line FROM k8s_inside WHERE inside AND NOT opens AND {matches('text', value)} AND NOT {matches('text', r'[{][{]|[$][{]|<|>')}"),
    ]


MARKED = "regexp_matches(text, '(?i)(?:leakscan|gitleaks):allow')"


def scan_ctes(
    files: str,
    *,
    file_rules: bool = True,
    secrets_from: str | None = None,
    layers: tuple[str, ...] = ("provider", "context", "k8s", "generic", "entropy"),
    ignore_markers: bool = False,
) -> list[tuple[str, str]]:
    """CTEs ending in ``findings(repo, path, line, rule_ord)`` for table ``files``.

    ``secrets_from`` names a table ``(repo, value, ord)`` of env values.
    """
    template = is_template() if file_rules else "false"
    live = "true" if ignore_markers else f"NOT {MARKED}"
    ctes = [
        ("texts", f"SELECT repo, path, content, {is_code()} AS code, {exempt()} IS NULL AND NOT {template} AS heuristic FROM {files}"),
        ("lines", "SELECT repo, path, content, code, heuristic, unnest(ls) AS text, generate_subscripts(ls, 1) AS line "
                  "FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS ls FROM texts WHERE content IS NOT NULL)"),
        ("live", f"SELECT * FROM lines WHERE {live}"),
    ]
    union: list[str] = []
    if "provider" in layers:
        union += [
            f"SELECT repo, path, line, {101 + n} AS rule_ord FROM live WHERE {provider_match(r)}"
            for n, r in enumerate(PROVIDER_SHAPES)
        ]
    if "context" in layers:
        gcp = (f'"type"[{WS}]*:[{WS}]*"service_account"', f'"private_key(?:_id)?"[{WS}]*:', f'"private_key_id"[{WS}]*:[{WS}]*"[A-Za-z0-9]{{16,}}"')
        union.append(f"SELECT repo, path, line, 2001 FROM live WHERE {matches('content', gcp[0])} AND {matches('content', gcp[1])} AND {matches('text', gcp[2])}")
        sid = r"\b(?:AC|SK)[0-9a-fA-F]{32}\b"
        union.append(
            f"SELECT repo, path, line, 2003 FROM live WHERE ({matches('content', '(?i)twilio')} OR {matches('content', sid)}) "
            "AND len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda r: regexp_matches(r, '^[0-9a-fA-F]{32}$'))) > 0"
        )
    if "k8s" in layers:
        ctes += k8s_ctes("lines")
        union.append("SELECT h.repo, h.path, h.line, 2002 FROM k8s_hits h SEMI JOIN live USING (repo, path, line)")
    if "generic" in layers:
        keep = "repo, path, line, code"
        ctes.append(("keyword_lines", f"SELECT {keep}, text FROM live WHERE heuristic AND {matches('text', f'(?i)(?:{KEYWORDS})')} AND {matches('text', '[:=]')}"))
        ctes += candidates("keyword_lines", keep)
        ctes += hardcoded("candidates", keep, "code")
        union.append("SELECT DISTINCT repo, path, line, 2004 FROM judged WHERE hardcoded")
    if "entropy" in layers:
        ctes.append(("tokens", f"SELECT repo, path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{20,}}')) AS token FROM live WHERE heuristic AND {matches('text', '[A-Za-z0-9+/=_-]{20}')} AND NOT {binary()}"))
        ctes.append(("scored", f"SELECT repo, path, line, unnest({entropy_parts('token')}) AS part FROM tokens"))
        union.append(f"SELECT DISTINCT repo, path, line, 2005 FROM scored WHERE length(part) >= 20 AND NOT {identifier('part')} AND {entropy('part')} >= 4.2")
    if file_rules:
        union.append(f"SELECT repo, path, 0, {filename_ord()} FROM {files} WHERE {filename_ord()} IS NOT NULL")
    if secrets_from:
        ctes += value_lines(files, secrets_from)
        union.append("SELECT repo, path, line, 10 FROM value_lines")
    ctes.append(("findings", " UNION ALL ".join(union)))
    return ctes


RULES = "(VALUES " + ", ".join(f"({o}, {text(i)}, {text(d)}, {text(layer)})" for o, i, d, layer in CATALOGUE) + ") AS rules(rule_ord, rule_id, description, layer)"


COLUMNS = {"findings": "(repo, path, line, rule_ord)"}


def query(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ", ".join(f"{name}{COLUMNS.get(name, '')} AS ({body})" for name, body in ctes) + " " + final
