"""Content expressions: decoding, lines, binary check, inline markers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import let

_REST = 1 << 30


def _utf16(data: Column, charset: str, keep: str, lone: str) -> Column:
    """Decode UTF-16 bytes, tolerating a dangling byte and lone surrogates.

    The engine's decoder fails the whole task on malformed input, so units that
    are not part of a pair become U+FFFD first. Pairs are walked from an
    aligned start; the possessive repeat keeps the walk iterative.
    """
    even = F.substring(data, F.lit(1), (F.octet_length(data) / 2).cast("int") * 2)
    units = F.decode(even, "ISO-8859-1")
    paired = F.regexp_replace(units, f"(?s)\\G((?:{keep})*+){lone}", "$1" + _REPLACEMENT[charset])
    return F.decode(F.encode(paired, "ISO-8859-1"), charset)


_REPLACEMENT = {"UTF-16LE": "\xfd\xff", "UTF-16BE": "\xff\xfd"}


def decode_blob(data: Column) -> Column:
    """Text of a blob: byte-order marks, mark-less UTF-16LE, else Latin-1."""
    # Odd-position bytes, counted on the Latin-1 spelling of the whole blob.
    pairs = let(
        F.decode(data, "ISO-8859-1"),
        lambda s: let(
            F.substring(s, F.lit(1), (F.length(s) / 2).cast("int") * 2),
            lambda even: F.struct(
                F.length(F.regexp_replace(even, r"(?s).(?:(\x00)|.)", "$1")).alias("zeros"),
                (F.length(even) / 2).alias("checked"),
            ),
        ),
    )
    looks_utf16 = (F.octet_length(data) >= 4) & let(
        pairs, lambda p: p.getField("zeros") / p.getField("checked") > 0.7
    )
    le = (r".[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF]", r".[\xD8-\xDF]")
    be = (r"[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].", r"[\xD8-\xDF].")
    rest2 = F.substring(data, 3, _REST)
    return (
        F.when(data.isNull() | (F.octet_length(data) == 0), "")
        .when(F.substring(data, 1, 2) == F.unhex(F.lit("FFFE")), _utf16(rest2, "UTF-16LE", *le))
        .when(F.substring(data, 1, 2) == F.unhex(F.lit("FEFF")), _utf16(rest2, "UTF-16BE", *be))
        .when(
            F.substring(data, 1, 3) == F.unhex(F.lit("EFBBBF")),
            F.make_valid_utf8(F.substring(data, 4, _REST).cast("string")),
        )
        .when(F.contains(data, F.unhex(F.lit("00"))) & looks_utf16, _utf16(data, "UTF-16LE", *le))
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def split_lines(content: Column) -> Column:
    """Lines of a text; a trailing empty line is kept."""
    return F.split(content, "\r?\n", -1)


def looks_binary(content: Column) -> Column:
    """A NUL, or over 30 % control characters, in the whole text."""
    control = F.regexp_count(content, F.lit(r"[\x01-\x08\x0E-\x1F]"))
    return F.contains(content, F.lit("\x00")) | (control / F.greatest(F.length(content), F.lit(1)) > 0.3)


def inline_allowed(line: Column, markers: tuple[str, ...]) -> Column:
    """Whether a line carries one of the ``<name>:allow`` markers."""
    names = "|".join(re.escape(m) for m in markers)
    return F.contains(line, F.lit(":")) & F.rlike(line, F.lit(f"(?i)(?:{names}):allow"))
