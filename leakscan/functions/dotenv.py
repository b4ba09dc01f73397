"""Env files: which assignments are secrets, and where their values recur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import DOT, WORD, WS, let, trim_ws, utf16_length
from leakscan.functions.generic import is_placeholder

# Key words that mark a secret, and the minimum lengths.
SECRET_KEY_WORDS = "pass|pwd|secret|token|key|auth|cred|api|private|access|signature|salt"
MIN_VALUE = 6
MIN_KEYED_VALUE = 10
MIN_OTHER_VALUE = 12
HEX_COLOUR = r"^#?(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\z"

ASSIGNMENT = f"^[{WS}]*(?:export[{WS}]+)?([A-Za-z_][A-Za-z0-9_]*)[{WS}]*=[{WS}]*({DOT}*)\\z"


def parse_assignment(line: Column) -> Column:
    """struct<key, value> of a ``KEY=value`` line, or null."""

    def unquote(text: Column) -> Column:
        quote = F.substring(text, 1, 1)
        return F.when(
            quote.isin('"', "'", "`") & F.endswith(text, quote),
            F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))),
        ).otherwise(trim_ws(F.get(F.split(text, f"[{WS}]+#", 2), F.lit(0))))

    return F.when(
        F.contains(line, F.lit("=")) & F.rlike(line, F.lit(ASSIGNMENT)),
        F.struct(
            F.regexp_extract(line, ASSIGNMENT, 1).alias("key"),
            let(trim_ws(F.regexp_extract(line, ASSIGNMENT, 2)), unquote).alias("value"),
        ),
    )


def is_dotenv_secret(key: Column, value: Column) -> Column:
    size = utf16_length(value)
    return (
        (size >= MIN_VALUE)
        & ~is_placeholder(value, for_env=True)
        & ~F.rlike(value, F.lit(r"^[0-9]+\z"))
        & ~F.rlike(value, F.lit(HEX_COLOUR))
        & F.when(F.rlike(key, F.lit(f"(?i){SECRET_KEY_WORDS}")), size >= MIN_KEYED_VALUE).otherwise(
            (size >= MIN_OTHER_VALUE)
            & F.rlike(value, F.lit("[A-Za-z]"))
            & F.rlike(value, F.lit("[0-9]"))
        )
    )


def boundary_line(content: Column, needle: Column) -> Column:
    """Line of the first occurrence of ``needle`` that is not part of a longer
    word, or null. An edge that is a symbol has no word to be part of."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    word_char = F.lit(f"^[{WORD}]")
    pattern = F.concat(
        F.when(F.rlike(needle, word_char), f"(?<![{WORD}])").otherwise(""),
        quoted,
        F.when(F.rlike(F.substring(needle, -1, 1), word_char), f"(?![{WORD}])").otherwise(""),
    )
    # The split yields two pieces exactly when the value occurs; the first one
    # is everything before it.
    return F.when(
        F.contains(content, needle),
        let(
            F.split(content, pattern, 2),
            lambda pieces: F.when(
                F.size(pieces) > 1, F.regexp_count(F.get(pieces, F.lit(0)), F.lit("\n")) + 1
            ),
        ),
    )
