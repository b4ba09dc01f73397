"""User rule packs: JSON in, accepted rules and rejected entries out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.functions.dialect import repeats_deeply, to_java_pattern, to_re2_hint, trim_ws, utf16_length
from leakscan.functions.rules import FIRST_CUSTOM_ORD, RESERVED_RULE_IDS
from leakscan.operators.allowlist import is_risky_pattern
from leakscan.operators.gate import usable_hint
from leakscan.operators.scan import CustomRule

# Pack limits, the shape of ids and flags, and the wording of refusals.
MAX_RULES = 200
MAX_DESCRIPTION = 120
RULE_ID = r"^[a-z0-9][a-z0-9-]{1,39}\z"
FLAGS = r"^[imsu]*\z"


@F.pandas_udf(T.StringType())
def _java_spelling(rules: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Java spelling of pattern and flags, null where they do not compile.

    Empty for patterns that compile but that no engine here can run on a line
    of any length: a group repeats without bound, and RE2 has no spelling.
    """

    def spell(pattern: str | None, flags: str | None) -> str | None:
        try:
            if pattern is None or len(set(flags or "")) != len(flags or ""):
                return None
            java = to_java_pattern(pattern, flags or "")
            return "" if repeats_deeply(pattern, flags or "") and not usable_hint(to_re2_hint(pattern, flags or "")) else java
        except ValueError:
            return None

    for patterns, flags in rules:
        yield pd.Series([spell(p, f) for p, f in zip(patterns, flags, strict=True)], dtype=object)


def _text_of(entry: Column, field: str) -> Column:
    """A string field of a JSON entry, null when missing or not a string."""
    value = F.variant_get(entry, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(entry, f"$.{field}", "string"))


def parse_rule_packs(packs: DataFrame) -> DataFrame:
    """Every entry of ``packs(pack, text)`` with the reason it was refused, if any.

    ``pack, pos, where, id, description, regex, flags, java_pattern, reason``;
    a null ``reason`` marks an accepted rule. Pack-level errors have ``pos`` 0.
    One bad entry never discards the others.
    """
    parsed = packs.where(trim_ws(F.col("text")) != "").select("pack", F.try_parse_json("text").alias("json"))
    listed = parsed.withColumn(
        "entries",
        F.when(
            F.startswith(F.schema_of_variant(F.variant_get("json", "$.rules", "variant")), F.lit("ARRAY")),
            F.variant_get("json", "$.rules", "array<variant>"),
        ),
    ).withColumn(
        "pack_reason",
        F.when(F.col("json").isNull(), "not valid JSON")
        .when(F.col("entries").isNull(), 'expected an object with a "rules" array')
        .when(
            F.size("entries") > MAX_RULES,
            F.concat(F.lit("too many rules ("), F.size("entries").cast("string"), F.lit(f", limit {MAX_RULES})")),
        ),
    )
    # A refused pack contributes one row of its own; good packs one per entry.
    rows = listed.select(
        "pack",
        "pack_reason",
        F.posexplode(
            F.when(F.col("pack_reason").isNull(), F.col("entries")).otherwise(
                F.array(F.parse_json(F.lit("null")))
            )
        ).alias("n", "entry"),
    )
    kind = F.schema_of_variant("entry")
    fields = rows.select(
        "pack",
        "pack_reason",
        F.when(F.col("pack_reason").isNull(), F.col("n") + 1).otherwise(0).alias("pos"),
        (F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))).alias("is_object"),
        _text_of(F.col("entry"), "id").alias("id"),
        _text_of(F.col("entry"), "description").alias("description"),
        _text_of(F.col("entry"), "regex").alias("regex"),
        F.when(
            F.coalesce(F.schema_of_variant(F.variant_get("entry", "$.flags", "variant")), F.lit("VOID")) == "VOID", ""
        )
        .otherwise(_text_of(F.col("entry"), "flags"))
        .alias("flags"),
    )
    regex, flags, description = F.col("regex"), F.col("flags"), F.col("description")
    runnable = regex.isNotNull() & (regex != "") & ~is_risky_pattern(regex) & F.rlike(flags, F.lit(FLAGS))
    spelled = fields.withColumn("java_pattern", _java_spelling(F.when(runnable, regex), flags))
    id_reason = (
        F.when(F.col("pack_reason").isNotNull(), F.col("pack_reason"))
        .when(~F.col("is_object"), "not an object")
        .when(
            F.col("id").isNull() | ~F.rlike("id", F.lit(RULE_ID)),
            "id must be 2-40 characters of lowercase letters, digits and hyphens",
        )
        .when(F.col("id").isin(*RESERVED_RULE_IDS), "id is already used by a built-in rule")
    )
    other_reason = (
        F.when(description.isNull() | (trim_ws(description) == ""), "description is required")
        .when(
            (utf16_length(description) > MAX_DESCRIPTION) | F.rlike(description, F.lit("[\r\n]")),
            f"description must be one line of at most {MAX_DESCRIPTION} characters",
        )
        .when(regex.isNull() | (regex == ""), "regex is required")
        .when(is_risky_pattern(regex), "regex is too long or backtracks catastrophically")
        .when(flags.isNull() | ~F.rlike(flags, F.lit(FLAGS)), "flags may only be i, m, s or u")
        .when(F.col("java_pattern").isNull(), "regex does not compile")
        .when(F.col("java_pattern") == "", "regex repeats a group in a way that long lines cannot be matched safely")
    )
    judged = spelled.withColumn("id_reason", id_reason).withColumn("other_reason", other_reason)
    # An id is taken by the first entry that is otherwise acceptable.
    taken_at = F.min(F.when(F.col("id_reason").isNull() & F.col("other_reason").isNull(), F.col("pos"))).over(
        Window.partitionBy("pack", "id")
    )
    return judged.withColumn("taken_at", taken_at).select(
        "pack",
        "pos",
        F.when(F.col("pos") == 0, "pack")
        .when(F.col("id") != "", F.concat(F.lit('"'), F.col("id"), F.lit('"')))
        .otherwise(F.concat(F.lit("rule "), F.col("pos").cast("string")))
        .alias("where"),
        "id",
        F.coalesce(F.col("id_reason"), F.when(F.col("pos") > F.col("taken_at"), "duplicate id"), F.col("other_reason")).alias(
            "reason"
        ),
        trim_ws(description).alias("description"),
        "regex",
        "flags",
        "java_pattern",
    )


def rule_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("pack", "where", "reason")


def accepted_rules(parsed: DataFrame, pack: str) -> list[CustomRule]:
    """The rules of one pack, ready to scan with.

    A pack holds at most 200 rules, so its rules are plan constants.
    """
    rows = (
        parsed.where((F.col("pack") == pack) & F.col("reason").isNull())
        .select("id", "description", "regex", "flags", "java_pattern")
        .orderBy("pos")
        .collect()
    )
    return [
        CustomRule(
            r["id"],
            r["description"],
            r["java_pattern"],
            FIRST_CUSTOM_ORD + n,
            usable_hint(to_re2_hint(r["regex"], r["flags"])),
            repeats_deeply(r["regex"], r["flags"]),
        )
        for n, r in enumerate(rows)
    ]
