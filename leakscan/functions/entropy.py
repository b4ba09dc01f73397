"""The entropy layer: long opaque tokens that carry no recognisable name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import count_matches, let, strip_chars, utf16_length

# Token alphabet, minimum length, threshold in bits, and the
# shape limits of names.
TOKEN = "[A-Za-z0-9+/=_-]{20,}"
MIN_LENGTH = 20
THRESHOLD = 4.2
MAX_DIGITS = 2
MAX_DIGIT_RATIO = 0.15
MIN_VOWEL_RATIO = 0.3
SHORT_NAME = 8


def _distinct_chars(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "", -1), lambda c: c != ""))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for empty text."""
    total = utf16_length(text)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        let(
            F.struct(F.length(text).alias("n"), total.alias("total")),
            lambda s: F.aggregate(
                _distinct_chars(text),
                F.lit(0.0),
                lambda acc, c: let(
                    (s.getField("n") - F.length(F.replace(text, c))) / s.getField("total"),
                    lambda p: acc - p * F.log2(p),
                ),
            ),
        )
    )


def few_digits(text: Column) -> Column:
    return let(
        count_matches(text, "[0-9]"),
        lambda d: (d <= MAX_DIGITS) | (d / F.length(text) <= MAX_DIGIT_RATIO),
    )


def _reads_as_name(segment: Column) -> Column:
    """A path segment that is a word or constant rather than a random run."""
    letters = strip_chars(segment, "[^A-Za-z]")
    return (
        F.rlike(segment, F.lit(r"^\.?[A-Za-z][A-Za-z0-9_.-]*\z"))
        & few_digits(segment)
        & (
            (F.length(segment) < SHORT_NAME)
            | F.rlike(segment, F.lit(r"^[A-Z][A-Z0-9_]*\z"))
            | let(
                letters,
                lambda l: (F.length(l) > 0)
                & (count_matches(l, "[aeiouAEIOU]") / F.length(l) >= MIN_VOWEL_RATIO),
            )
        )
    )


def entropy_candidates(token: Column) -> Column:
    """The strings scored for a token: a path's segments, or the token whole."""
    return F.when(
        F.contains(token, F.lit("/")),
        let(
            F.filter(F.split(token, "/", -1), lambda s: s != ""),
            lambda parts: F.when((F.size(parts) >= 2) & F.forall(parts, _reads_as_name), parts).otherwise(
                F.array(token)
            ),
        ),
    ).otherwise(F.array(token))


def looks_like_identifier(token: Column) -> Column:
    return (
        F.rlike(token, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*\z"))
        & few_digits(token)
        & (count_matches(token, "[aeiouAEIOU]") / F.length(token) >= MIN_VOWEL_RATIO)
    )


def is_high_entropy(candidate: Column) -> Column:
    # 18 distinct characters carry at most log2(18) = 4.17 bits, under the
    # threshold, so most tokens are settled without the full sum.
    return (
        (F.length(candidate) >= MIN_LENGTH)
        & (F.size(_distinct_chars(candidate)) > 18)
        & ~looks_like_identifier(candidate)
        & (shannon_entropy(candidate) >= THRESHOLD)
    )


def has_high_entropy_token(line: Column) -> Column:
    return F.exists(
        F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)),
        lambda token: F.exists(entropy_candidates(token), is_high_entropy),
    )
