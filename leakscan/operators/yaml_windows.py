"""Kubernetes Secret data over a table of lines, with window functions.

For callers that keep one row per line. Scans of whole texts use the in-row
fold of ``functions.context`` instead, which needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions.context import K8S_BLOCK, K8S_KIND, YAML_SEPARATOR, indent_of, k8s_value_line
from leakscan.functions.dialect import trim_ws


def yaml_documents(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``lines(keys, line, text)`` with ``doc``, the document each line belongs to."""
    separator = F.rlike("text", F.lit(YAML_SEPARATOR)).cast("int")
    return lines.withColumn("doc", F.sum(separator).over(Window.partitionBy(*keys).orderBy("line")))


def secret_documents(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of the documents that declare ``kind: Secret``, wherever they do."""
    declares = F.rlike("text", F.lit(K8S_KIND)).cast("int")
    whole = Window.partitionBy(*keys, "doc")
    return (
        yaml_documents(lines, keys)
        .withColumn("is_secret", F.max(declares).over(whole) == 1)
        .where(F.col("is_secret"))
        .drop("is_secret")
    )


def secret_data_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, line`` of literal values inside the data block of a Secret.

    A block runs from its opener while lines stay indented deeper; nothing
    reopens it but another opener, so a running minimum of the indent settles
    whether a line is still inside.
    """
    opens = F.rlike("text", F.lit(K8S_BLOCK))
    in_document = Window.partitionBy(*keys, "doc").orderBy("line")
    blocks = secret_documents(lines, keys).withColumns({"opens": opens, "indent": indent_of(F.col("text"))})
    blocks = blocks.withColumn("block", F.sum(F.col("opens").cast("int")).over(in_document)).where(F.col("block") > 0)
    whole = Window.partitionBy(*keys, "doc", "block").orderBy("line")
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content_indent = F.when(~F.col("opens") & (trim_ws(F.col("text")) != ""), F.col("indent"))
    inside = F.min(content_indent).over(upto) > F.first(F.col("indent")).over(upto)
    return (
        blocks.withColumn("inside", inside)
        .where(F.col("inside") & ~F.col("opens") & k8s_value_line(F.col("text")))
        .select(*keys, "line")
    )
