"""Scanning texts: one narrow pass from content to findings.

Candidate lines come from ``gate``; the exact rules below decide. The whole
scan is a map over the input splits: content is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions import context, paths
from leakscan.functions import entropy as entropy_layer
from leakscan.functions import generic
from leakscan.functions.rules import (
    DOTENV_ORD,
    ENTROPY_ORD,
    FIRST_PROVIDER_ORD,
    GCP_ORD,
    GENERIC_ORD,
    K8S_ORD,
    PROVIDER_RULES,
    TWILIO_ORD,
    built_in_catalogue,
    java_shape,
)
from leakscan.functions.dialect import sql_string
from leakscan.functions.text import inline_allowed
from leakscan.operators import gate
from leakscan.operators.xref import xref_lines
from leakscan.options import ScanOptions

HITS = "array<struct<line:int,ord:int>>"

# The keyword layer judged as if the text were source code. Scans that do not
# know the path yet (one blob, many paths) record both verdicts.
GENERIC_CODE_ORD = GENERIC_ORD + 100

# Notes a scan may leave at line 0 next to its findings.
_READ, _UNREAD = -1, -2


@dataclass(frozen=True)
class CustomRule:
    """An accepted user rule: ``pattern`` spelled for Java, ``hint`` for RE2.

    ``deep`` rules repeat a group without bound. They are matched by their
    ``hint``, in linear time and constant stack, and never by Java.
    """

    id: str
    description: str
    pattern: str
    ord: int
    hint: str = ""
    deep: bool = False


def _has(bit: int) -> Column:
    return F.col("_mask").bitwiseAND(F.lit(bit)) != 0


def _token_rules(rules: Sequence[CustomRule]) -> Column:
    """array<int>, with nulls: orders of the token-shape rules ``_text`` matches.

    Spelled as SQL text: the expression is large and constant, and one parse is
    much cheaper than a thousand calls to assemble it. Literal searches stand
    before each regular expression.
    """
    cases = []
    for n, rule in enumerate(PROVIDER_RULES):
        where = "lower(_text)" if rule.any_case else "_text"
        literal = " OR ".join(f"contains({where}, {sql_string(lit)})" for lit in rule.literals)
        cases.append(
            f"CASE WHEN (_mask & {gate.PROVIDER}) != 0 AND ({literal})"
            f" AND _text RLIKE {sql_string(java_shape(rule))} THEN {FIRST_PROVIDER_ORD + n} END"
        )
    cases += [
        f"CASE WHEN (_mask & {gate.CUSTOM}) != 0 AND _text RLIKE {sql_string(r.pattern)} THEN {r.ord} END"
        for r in rules
        if not r.deep
    ]
    return F.expr(f"array({', '.join(cases)})")


@cache
def _heuristic_cases(application: str, both_verdicts: bool) -> Column:
    """array<int>, with nulls: orders of the context, keyword and entropy rules.

    Kept per application: assembling these expressions costs more than a second.
    """
    line = F.col("_text")
    keyword = _has(gate.GENERIC)
    found = [
        F.when(_has(gate.GCP) & context.gcp_line(line), GCP_ORD),
        F.when(_has(gate.TWILIO) & context.twilio_line(line), TWILIO_ORD),
    ]
    if both_verdicts:
        found.append(F.when(keyword & generic.has_hardcoded_assignment(line, F.lit(False)), GENERIC_ORD))
        found.append(F.when(keyword & generic.has_hardcoded_assignment(line, F.lit(True)), GENERIC_CODE_ORD))
    else:
        found.append(F.when(keyword & generic.has_hardcoded_assignment(line, _has(gate.CODE)), GENERIC_ORD))
    found.append(F.when(_has(gate.RANDOM) | _has(gate.ENTROPY) & entropy_layer.has_high_entropy_token(line), ENTROPY_ORD))
    return F.array(*found)


@cache
def _manifest_lines(application: str, markers: tuple[str, ...]) -> Column:
    return F.coalesce(context.k8s_secret_lines(F.col("_text"), markers), F.array().cast("array<int>"))


def text_hits(
    units: DataFrame,
    keys: Sequence[str],
    options: ScanOptions,
    *,
    rules: Sequence[CustomRule] = (),
    generic_on: Column | bool = True,
    entropy_on: Column | bool = True,
    code: Column | bool = False,
    both_verdicts: bool = False,
    file_ord: Column | None = None,
    note: Column | None = None,
) -> DataFrame:
    """``keys, line, rule_ord`` for every hit in the ``content`` of ``units``.

    Line 0 stands for the file as a whole. Null content has file hits only.
    ``note`` is an extra order number to report at line 0, for callers that
    count texts in the same pass.
    """
    as_column = lambda v: F.lit(v) if isinstance(v, bool) else v
    content = F.col("content")
    markers = () if options.ignore_inline_allow else options.inline_markers

    def flag(condition: Column, bit: int) -> Column:
        return F.when(condition, F.lit(bit)).otherwise(F.lit(0))

    flags = (
        flag(as_column(generic_on) & F.lit(options.generic), gate.GENERIC)
        + flag(as_column(entropy_on) & F.lit(options.entropy), gate.ENTROPY)
        + flag(as_column(code), gate.CODE)
    )
    # Whole-file hits known before any line is read; null when there are none.
    carried = {"_note": note, "_file_ord": file_ord}
    carried = {name: value for name, value in carried.items() if value is not None}
    lines = gate.candidate_lines(
        units.withColumns(carried) if carried else units,
        keys,
        flags,
        list(carried),
        [r.hint for r in rules],
        {r.ord: r.hint for r in rules if r.deep},
    )

    application = units.sparkSession.sparkContext.applicationId
    text = F.col("_text")
    none = F.array().cast(HITS)

    def file_hit(name: str, line: Column, rule_ord: Column) -> Column:
        return F.when(F.col(name).isNotNull(), F.array(F.struct(line.alias("line"), rule_ord.alias("ord")))).otherwise(none)

    file_hits = [none]
    if "_note" in carried:
        file_hits.append(file_hit("_note", F.lit(0), F.col("_note")))
    if "_file_ord" in carried:
        file_hits.append(file_hit("_file_ord", F.lit(0), F.col("_file_ord")))
    file_hits.append(
        F.transform(
            _manifest_lines(application, markers),
            lambda n: F.struct(n.alias("line"), F.lit(K8S_ORD).alias("ord")),
        )
    )
    # In listing order: token shapes, user rules, then context and heuristics.
    deep = F.coalesce("_deep", F.array().cast("array<int>"))
    ords = F.array_compact(F.concat(_token_rules(rules), deep, _heuristic_cases(application, both_verdicts)))
    if markers:
        ords = F.when(~inline_allowed(text, markers), ords)
    hits = F.when(F.col("_line") == 0, F.concat(*[h.cast(HITS) for h in file_hits])).otherwise(
        F.transform(ords, lambda o: F.struct(F.col("_line").alias("line"), o.alias("ord"))).cast(HITS)
    )
    return lines.select(*keys, F.explode(hits).alias("_hit")).select(
        *keys, F.col("_hit.line").alias("line"), F.col("_hit.ord").alias("rule_ord")
    )


def name_rules(hits: DataFrame, rules: Sequence[CustomRule] = ()) -> DataFrame:
    """Add ``rule_id`` and ``description`` for ``rule_ord`` (a fixed, small catalogue)."""
    entries = [(o, i, d) for o, i, d, _ in built_in_catalogue()] + [(r.ord, r.id, r.description) for r in rules]
    pairs = ", ".join(f"{o}, struct({sql_string(i)} AS id, {sql_string(d)} AS description)" for o, i, d in entries)
    named = hits.withColumn("_rule", F.expr(f"element_at(map({pairs}), rule_ord)"))
    return named.withColumns({"rule_id": F.col("_rule.id"), "description": F.col("_rule.description")}).drop("_rule")


def scan_texts(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
) -> DataFrame:
    """Content rules only: findings of ``files(repo, path, content)``."""
    return _finding_columns(name_rules(_file_hits(files, options, rules, file_rules=False), rules))


def scan_files(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
) -> DataFrame:
    """Every check that applies to a file: its name, env values, its content.

    ``secrets`` is ``dotenv_secrets(repo, ord, value)``. Env templates keep
    only the high-confidence rules; null content keeps only the name rule.
    """
    return _finding_columns(name_rules(_checked_hits(files, options, rules, secrets), rules))


def scan_coverage(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    rules: Sequence[CustomRule] = (),
    secrets: DataFrame | None = None,
) -> DataFrame:
    """Per repository: files, files without content, findings, files with findings.

    The files are counted by the scan itself, so content is read once. Every
    repository is listed, with or without findings.
    """
    seen = F.when(F.col("content").isNull(), _UNREAD).otherwise(_READ)
    hits = _checked_hits(files, options, rules, secrets, note=seen)
    # One row per file first: no repository is counted in a single task.
    per_file = hits.groupBy("repo", "path").agg(
        F.count_if(F.col("rule_ord") < 0).alias("files"),
        F.count_if(F.col("rule_ord") == _UNREAD).alias("unavailable"),
        F.count_if(F.col("rule_ord") > 0).alias("findings"),
    )
    return per_file.groupBy("repo").agg(
        F.sum("files").alias("files"),
        F.sum("unavailable").alias("unavailable"),
        F.sum("findings").alias("findings"),
        F.count_if(F.col("findings") > 0).alias("files_with_findings"),
    )


def _finding_columns(named: DataFrame) -> DataFrame:
    return named.select("repo", "path", "line", "rule_id", "description", "rule_ord")


def _checked_hits(
    files: DataFrame,
    options: ScanOptions,
    rules: Sequence[CustomRule],
    secrets: DataFrame | None,
    note: Column | None = None,
) -> DataFrame:
    if secrets is None:
        return _file_hits(files, options, rules, note=note)
    matches = xref_lines(files, secrets, ["repo", "path"], options).withColumn("rule_ord", F.lit(DOTENV_ORD))
    return _file_hits(files, options, rules, note=note).unionByName(matches)


def _file_hits(
    files: DataFrame,
    options: ScanOptions,
    rules: Sequence[CustomRule],
    *,
    file_rules: bool = True,
    note: Column | None = None,
) -> DataFrame:
    path = F.col("path")
    heuristics = paths.heuristic_exempt(path, options.default_excludes).isNull()
    if file_rules:
        heuristics = heuristics & ~paths.is_env_template(path)
    return text_hits(
        files,
        ["repo", "path"],
        options,
        rules=rules,
        generic_on=heuristics,
        entropy_on=heuristics,
        code=paths.is_code_file(path),
        file_ord=paths.filename_rule_ord(path) if file_rules else None,
        note=note,
    )
