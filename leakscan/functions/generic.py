"""The keyword-assignment layer: hardcoded values given to credential names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import (
    DOT,
    NOT_BEFORE_WORD,
    WS,
    count_matches,
    let,
    strip_chars,
    trim_ws,
    utf16_length,
)

# The keywords in the order they are tried, and the short stems
# of which every keyword contains at least one.
KEYWORDS = (
    "passwd|password|passphrase|pwd|pass|secret(?:[_-]?key)?|token|access[_-]?token|authorization|"
    "auth(?:[_-]?token)?|bearer|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|private[_-]?key|"
    "encryption[_-]?key|signing[_-]?key|session[_-]?key|connection[_-]?string|conn[_-]?str|credentials?"
)
KEYWORD_STEMS = ("pass", "pwd", "secret", "token", "auth", "bearer", "key", "conn", "credential")

# Placeholder words shared by this layer and the env-value layer.
PLACEHOLDERS = (
    f"your[_-]{DOT}*|my[_-]{DOT}*|{DOT}*[_-]here|changeme|change[_-]?me|example|placeholder|redacted|"
    "dummy|sample|todo|tbd|xxx+"
)
VALUE_PLACEHOLDERS = (
    "your|my|the|test|none|null|nil|undefined|true|false|x{3,}|\\*+|password|passwd|secret|token|"
    "value|string|auth|authorization|key|apikey|api[_-]?key|credentials?"
)
ENV_PLACEHOLDERS = (
    "true|false|null|none|undefined|localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|development|production|"
    "staging|test"
)
# Auth schemes named before a credential, and names that read
# configuration rather than hold it.
AUTH_SCHEMES = "bearer|basic|digest|negotiate|oauth|jwt|token|apikey|api[_-]?key"
REFERENCE_ROOTS = (
    "process|import|globalThis|window|os|System|Deno|ENV|env|config|configService|vault|secret|"
    "secrets|settings"
)
# Limits of a route word.
ROUTE_WORD_MAX = 20
ROUTE_WORD_CHECKED_FROM = 12
ROUTE_MIN_VOWELS = 0.25
LABEL_MIN_VOWELS = 0.3

# A necessary condition for any candidate, cheap enough to run on every line.
LINE_GATE = f"(?i)(?:{KEYWORDS})[A-Za-z0-9]*[\"'`]?[{WS}]*[:=][{WS}]*[^{WS}]"

# Keyword occurrences are fenced with two noncharacters; text that already
# holds one gets a third in its place, which no rule tells apart from it.
_OPEN, _CLOSE, _OTHER = chr(0xFDD0), chr(0xFDD1), chr(0xFDD2)


def _candidate_values(line: Column) -> Column:
    """Every value assigned to a keyword on ``line`` (already fence-free).

    Occurrences do not overlap and the leftmost alternative wins, so all of
    them are marked in one pass and each is then judged by what stands around
    it. A rejected occurrence is still consumed.
    """
    parts = F.split(F.regexp_replace(line, f"((?i:{KEYWORDS}))", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)

    def judge(parts: Column) -> Column:
        def at_boundary(part: Column, i: Column) -> Column:
            before = F.substring(F.translate(F.get(parts, i), _CLOSE, ""), -1, 1)
            first = F.substring(part, 1, 1)
            upper, lower, digit = before.between("A", "Z"), before.between("a", "z"), before.between("0", "9")
            return (before == "") | ~(upper | lower | digit) | ((lower | digit) & first.between("A", "Z"))

        def value_after(part: Column, i: Column) -> Column:
            rest = F.concat(
                F.substring_index(part, _CLOSE, -1),
                F.translate(F.array_join(F.slice(parts, i + 3, F.size(parts)), ""), _CLOSE, ""),
            )
            tail = f"^(?:[A-Z][a-z0-9]*)?[\"'`]?[{WS}]*[:=][{WS}]*([^{WS}]{DOT}*)\\z"
            return F.when(at_boundary(part, i), F.regexp_extract(rest, tail, 1)).otherwise("")

        keywords = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.filter(F.transform(keywords, value_after), lambda v: v != "")

    return let(parts, judge)


def _fence_free(line: Column) -> Column:
    return F.translate(line, _OPEN + _CLOSE, _OTHER + _OTHER)


def generic_candidates(line: Column) -> Column:
    """array<struct<value, key_context>>: assigned values and the text left of each."""
    return let(
        _fence_free(line),
        lambda text: F.transform(
            _candidate_values(text),
            lambda v: F.struct(
                v.alias("value"),
                F.substring(text, F.lit(1), F.length(text) - F.length(v)).alias("key_context"),
            ),
        ),
    )


def is_placeholder(value: Column, for_env: bool = False) -> Column:
    words = ENV_PLACEHOLDERS if for_env else VALUE_PLACEHOLDERS
    return F.rlike(value, F.lit(f"(?i)^(?:{PLACEHOLDERS}|{words})\\z"))


def _is_route_word(segment: Column) -> Column:
    def judge(word: Column) -> Column:
        digits = count_matches(word, "[0-9]")
        letters = strip_chars(word, "[^a-z]")
        return (
            F.rlike(word, F.lit(r"^[a-z][a-z0-9-]*\z"))
            & (F.length(word) <= ROUTE_WORD_MAX)
            & ~((digits > 2) & (digits / F.length(word) > 0.15))
            & ~F.rlike(word, F.lit("[b-df-hj-np-tv-z]{7}"))
            & (
                (F.length(word) < ROUTE_WORD_CHECKED_FROM)
                | (count_matches(word, "[aeiou]") / F.length(letters) >= ROUTE_MIN_VOWELS)
            )
        )

    return let(F.regexp_replace(segment, "^:", ""), judge)


def is_route_template(value: Column) -> Column:
    return F.rlike(value, F.lit("/:[A-Za-z_]")) & F.forall(
        F.filter(F.split(value, "/", -1), lambda s: s != ""), _is_route_word
    )


def echoes_key(value: Column, key_context: Column) -> Column:
    """A plain word that only restates the name it is assigned to."""
    # Read backwards from the assignment: the name is the run that ends there,
    # from its first letter on. Read forwards, every long run of the line would
    # be tried from each of its characters.
    name_end = f"^[{WS}]*[:=][{WS}]*[\"'`]?[{WS}]*([A-Za-z0-9_.$-]+)"
    run = F.reverse(F.regexp_extract(F.reverse(key_context), name_end, 1))
    key = F.regexp_replace(run, "^[^A-Za-z_]+", "")
    letters = strip_chars(value, "[^A-Za-z]")
    flat = strip_chars(F.lower(value), "[^a-z0-9]")
    return (
        F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z_-]*\z"))
        & (F.length(letters) >= 4)
        & (count_matches(value, "[aeiouAEIOU]") / F.length(letters) >= LABEL_MIN_VOWELS)
        & (F.length(flat) >= 4)
        & F.contains(strip_chars(F.lower(key), "[^a-z0-9]"), flat)
    )


def is_hardcoded(raw: Column, code_file: Column, key_context: Column) -> Column:
    """Whether an assigned value is a literal rather than a reference."""

    def body(text: Column) -> Column:
        quote = F.substring(text, 1, 1)
        close = F.position(quote, text, F.lit(2))
        quoted = quote.isin('"', "'", "`")
        inner = (
            F.when(~quoted, text).when(close > 0, F.substring(text, F.lit(2), close - 2))
        )
        scheme = f"(?i)^(?:{AUTH_SCHEMES}){NOT_BEFORE_WORD}[{WS}:]*"
        label_free = trim_ws(F.regexp_replace(inner, scheme, ""))
        bare = F.regexp_replace(F.regexp_extract(label_free, f"^[^{WS},;)}}\\]]*", 0), "[\"'`]+\\z", "")
        return F.struct(
            quoted.alias("quoted"), trim_ws(F.when(quoted, label_free).otherwise(bare)).alias("text")
        )

    def verdict(v: Column) -> Column:
        text, quoted = v.getField("text"), v.getField("quoted")
        return (
            F.when(text.isNull() | (utf16_length(text) < 4), False)
            .when(F.rlike(text, F.lit(r"^[,;:)\]}?]")), False)
            .when(F.rlike(text, F.lit(r"\$\{|\{\{|%\(|<%|#\{|\{[A-Za-z_][0-9A-Za-z_.]*\}")), False)
            .when(is_route_template(text), False)
            .when(~quoted & F.rlike(text, F.lit(r"^\$|[.(]")), False)
            .when(~quoted & F.rlike(text, F.lit(f"(?i)^(?:{REFERENCE_ROOTS})\\z")), False)
            .when(~quoted & code_file & F.rlike(text, F.lit(r"^[A-Za-z_$][0-9A-Za-z_$]*\z")), False)
            .when(
                ~code_file
                & F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"))
                & ~F.rlike(text, F.lit("[A-Za-z0-9]")),
                False,
            )
            .when(F.rlike(text, F.lit(r"^[A-Z][A-Z0-9_]{2,}\z")), False)
            .when(is_placeholder(text), False)
            .when(echoes_key(text, key_context), False)
            .when((text == "...") | F.rlike(text, F.lit(f"^<{DOT}*>\\z")), False)
            .otherwise(True)
        )

    unprefixed = F.regexp_replace(trim_ws(raw), "^[fFrRbBuU]{1,2}(?=[\"'`])", "")
    return let(let(unprefixed, body), verdict)


def _head_pattern(checked: str) -> str:
    """Each fenced keyword, with the head of its value where it is assigned one.

    Group 1 is the keyword with its trailing camel segment, group 2 as much of
    the value as can matter: a quoted string, or an unquoted word and, since
    the first word may be an auth scheme, the one after it. Both stand in a
    look-ahead, so the next keyword is tried wherever it stands; a keyword
    without a value matches with empty groups and keeps its place in the list.
    """
    keyword = f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}"
    camel = f"(?:{_OPEN}?[A-Z][a-z0-9{_OPEN}{_CLOSE}]*+)?+"
    boundary = (
        f"(?:(?<![A-Za-z0-9])(?<![A-Za-z0-9]{_CLOSE})"
        f"|(?:(?<=[a-z0-9])|(?<=[a-z0-9]{_CLOSE}))(?={_OPEN}[A-Z]))"
    )
    quoted = "(?:[fFrRbBuU]{1,2}(?=[\"'`]))?(?:\"[^\"]*+\"?|'[^']*+'?|`[^`]*+`?)"
    word = f"[^{WS},;)}}\\]]*+"
    head = f"{quoted}|(?=[^{WS}]){word}[{WS}:]*+{word}"
    return f"(?:{boundary}(?=({keyword}{camel})[\"'`]?[{WS}]*+[:=][{WS}]*+{checked}({head})){keyword}|{keyword})"


# A value runs to the end of its line. Where the line holds a lone line end,
# only what follows the last one counts.
_HEADS = _head_pattern("")
_HEADS_TO_END = _head_pattern(f"(?={DOT}*+\\z)")


def has_hardcoded_assignment(line: Column, code_file: Column) -> Column:
    """Whether any keyword on the line is given a hardcoded value.

    The verdict over ``generic_candidates``, without copying the rest of the
    line for every keyword: only the head of each value is looked at, and the
    text to the left only when the value might restate its key.
    """

    def without_fences(text: Column) -> Column:
        return F.translate(text, _OPEN + _CLOSE, "")

    def judge(fenced: Column) -> Column:
        pattern = F.when(F.rlike(fenced, F.lit("[\r\u2028\u2029]")), _HEADS_TO_END).otherwise(F.lit(_HEADS))

        def heads(pattern: Column) -> Column:
            numbered = F.transform(
                F.regexp_extract_all(fenced, pattern, F.lit(2)), lambda h, n: F.struct(h.alias("head"), n.alias("n"))
            )
            assigned = F.filter(numbered, lambda c: c.getField("head") != "")

            def key_context(n: Column) -> Column:
                left = F.array_join(F.slice(F.split(fenced, _OPEN, -1), F.lit(1), n + 1), "")
                name = F.get(F.regexp_extract_all(fenced, pattern, F.lit(1)), n)
                return F.concat(without_fences(F.concat(left, name)), F.lit(":"))

            return F.exists(
                assigned,
                lambda c: is_hardcoded(without_fences(c.getField("head")), code_file, key_context(c.getField("n"))),
            )

        return let(pattern, heads)

    return let(F.regexp_replace(_fence_free(line), f"((?i:{KEYWORDS}))", f"{_OPEN}$1{_CLOSE}"), judge)
