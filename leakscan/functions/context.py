"""Context rules: a line only counts because of what the rest of the file says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, WS_CHARS
from leakscan.functions.text import inline_allowed, split_lines

# The shapes that identify each context and its lines.
GCP_TYPE = f'"type"[{WS}]*:[{WS}]*"service_account"'
GCP_KEY = f'"private_key(?:_id)?"[{WS}]*:'
GCP_LINE = f'"private_key_id"[{WS}]*:[{WS}]*"[A-Za-z0-9]{{16,}}"'
TWILIO_SID = f"{NOT_AFTER_WORD}(?:AC|SK)[0-9a-fA-F]{{32}}{NOT_BEFORE_WORD}"
TWILIO_LINE = "(?<![A-Za-z0-9])[0-9a-fA-F]{32}(?![A-Za-z0-9])"
YAML_SEPARATOR = f"^---[{WS}]*\\z"
K8S_KIND = f"^[{WS}]*kind:[{WS}]*[\"']?Secret[\"']?[{WS}]*\\z"
K8S_BLOCK = f"^[{WS}]*(?:data|stringData):[{WS}]*\\z"
K8S_VALUE = f"^[{WS}]*[A-Za-z0-9._-]+:[{WS}]*[\"']?[A-Za-z0-9+/]{{8,}}={{0,2}}[\"']?[{WS}]*\\z"
K8S_TEMPLATE = r"\{\{|\$\{|<|>"


def gcp_context(content: Column) -> Column:
    return (
        F.contains(content, F.lit('"service_account"'))
        & F.contains(content, F.lit('"private_key'))
        & F.rlike(content, F.lit(GCP_TYPE))
        & F.rlike(content, F.lit(GCP_KEY))
    )


def gcp_line(line: Column) -> Column:
    return F.contains(line, F.lit('"private_key_id"')) & F.rlike(line, F.lit(GCP_LINE))


def twilio_context(content: Column, lowered: Column) -> Column:
    return F.contains(lowered, F.lit("twilio")) | (
        (F.contains(content, F.lit("AC")) | F.contains(content, F.lit("SK")))
        & F.rlike(content, F.lit(TWILIO_SID))
    )


def twilio_line(line: Column) -> Column:
    return F.rlike(line, F.lit(TWILIO_LINE))


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(WS_CHARS)))


def k8s_gate(content: Column) -> Column:
    return F.contains(content, F.lit("Secret")) & F.contains(content, F.lit("ata:"))


def k8s_value_line(line: Column) -> Column:
    return F.rlike(line, F.lit(K8S_VALUE)) & ~F.rlike(line, F.lit(K8S_TEMPLATE))


def k8s_secret_lines(content: Column, markers: tuple[str, ...] = ()) -> Column:
    """array<int>: numbers of the lines that hold Kubernetes Secret data.

    One fold over the lines of one text, so a scan needs no shuffle to see a
    whole manifest. Values wait in ``pending`` until their document ends and
    its kind is known. Lines with an inline marker are left out.
    """
    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("block"),
        F.lit(False).alias("secret"),
        none.alias("pending"),
        none.alias("found"),
    )

    def settle(acc: Column) -> Column:
        found, pending = acc.getField("found"), acc.getField("pending")
        return F.when(acc.getField("secret") & (F.size(pending) > 0), F.concat(found, pending)).otherwise(found)

    def step(acc: Column, line: Column) -> Column:
        n = acc.getField("n") + 1
        block = acc.getField("block")
        opens = F.contains(line, F.lit("ata:")) & F.rlike(line, F.lit(K8S_BLOCK))
        blank = F.btrim(line, F.lit(WS_CHARS)) == ""
        inside = block.isNotNull() & ~blank & (indent_of(line) > block)
        hit = inside & k8s_value_line(line)
        if markers:
            hit = hit & ~inline_allowed(line, markers)
        next_block = (
            F.when(opens, indent_of(line)).when(block.isNull() | blank | inside, block).otherwise(F.lit(None))
        )
        return F.when(
            F.startswith(line, F.lit("---")) & F.rlike(line, F.lit(YAML_SEPARATOR)),
            F.struct(
                n.alias("n"),
                F.lit(None).cast("int").alias("block"),
                F.lit(False).alias("secret"),
                none.alias("pending"),
                settle(acc).alias("found"),
            ),
        ).otherwise(
            F.struct(
                n.alias("n"),
                next_block.cast("int").alias("block"),
                (acc.getField("secret") | F.rlike(line, F.lit(K8S_KIND))).alias("secret"),
                F.when(~opens & hit, F.array_append(acc.getField("pending"), n))
                .otherwise(acc.getField("pending"))
                .alias("pending"),
                acc.getField("found").alias("found"),
            )
        )

    return F.when(
        k8s_gate(content), F.aggregate(split_lines(content), start, step, settle)
    ).otherwise(none)
