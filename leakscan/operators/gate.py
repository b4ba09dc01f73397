"""Candidate selection: which lines of which texts are worth exact matching.

Almost all text matches no rule. Deciding that with forty Java regular
expressions costs two orders of magnitude more per byte than one RE2 pass over
an Arrow buffer, so candidates are selected with Arrow kernels inside each
task and only the selected lines reach the exact rules. Every pattern here is
a necessary condition of the rules behind it: selection never drops a finding.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.functions import context, generic
from leakscan.functions.dialect import WS
from leakscan.functions.rules import PROVIDER_RULES
from leakscan.operators.token_scores import score_lines

# Mask bits: which layers a line is a candidate for, and whether its text is code.
# A RANDOM line holds a token that is over the entropy threshold beyond doubt.
PROVIDER, GENERIC, ENTROPY, GCP, TWILIO, K8S, CUSTOM, CODE, RANDOM = (1 << n for n in range(9))
LINE_LAYERS = PROVIDER | GENERIC | ENTROPY | GCP | TWILIO | CUSTOM

_PROVIDER = "|".join(r.hint for r in PROVIDER_RULES).replace(r"\s", WS)
_ENTROPY = "[A-Za-z0-9+/=_-]{20}"
# Texts worth a closer look for the rules that need a whole file.
_TWILIO_FILE = r"(?i:twilio)|\b(?:AC|SK)[0-9a-fA-F]{32}\b"
_TWILIO_LINE = "[0-9a-fA-F]{32}"
_K8S_FILE = f"kind:[{WS}]*[\"']?Secret"
_CONTEXT = f"{_TWILIO_FILE}|\"service_account\"|{_K8S_FILE}"


def candidate_lines(
    units: DataFrame,
    keys: Sequence[str],
    flags: Column,
    carried: Sequence[str],
    custom_hints: Sequence[str] = (),
    deep_rules: Mapping[int, str] | None = None,
) -> DataFrame:
    """``keys, carried, _line, _text, _mask, _deep`` rows worth exact matching.

    ``flags`` holds the layer bits that apply to a text at all (``GENERIC``,
    ``ENTROPY``) and ``CODE``. Line 0 stands for the text as a whole: it is
    kept when a ``carried`` value is set, or with the whole text in ``_text``
    when the text may be a Kubernetes Secret. ``deep_rules`` are matched here,
    by rule order; ``_deep`` lists those that a line matches.
    """
    source = units.select(*keys, *carried, flags.cast("int").alias("_flags"), "content")
    schema = T.StructType(
        [*source.schema.fields[:-2]]
        + [T.StructField("_line", T.IntegerType()), T.StructField("_text", T.StringType()), T.StructField("_mask", T.IntegerType())]
        + [T.StructField("_deep", T.ArrayType(T.IntegerType()))]
    )
    lines = {PROVIDER: _PROVIDER, GENERIC: generic.LINE_GATE, ENTROPY: _ENTROPY, GCP: context.GCP_LINE, TWILIO: _TWILIO_LINE}
    lines = {bit: (pattern,) for bit, pattern in lines.items()}
    if custom_hints:
        lines[CUSTOM] = hint_unions(custom_hints) if all(custom_hints) else ()
    deep = dict(deep_rules or {})
    texts = {K8S: [_K8S_FILE], GCP: [context.GCP_TYPE, context.GCP_KEY], TWILIO: [_TWILIO_FILE]}
    n_keys, n_passed = len(keys), len(keys) + len(carried)

    def select(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from _select(batch, n_keys, n_passed, lines, texts, _CONTEXT, deep)

    return source.mapInArrow(select, schema)


def usable_hint(pattern: str) -> str:
    """``pattern`` if Arrow's RE2 takes it, else the empty hint, which every line passes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return ""
    return pattern


def hint_unions(hints: Sequence[str]) -> tuple[str, ...]:
    """Few patterns that together find what the hints find: as many in one as RE2 takes."""
    union = "|".join(f"(?:{h})" for h in hints)
    if len(hints) == 1 or usable_hint(union):
        return (union,)
    half = len(hints) // 2
    return (*hint_unions(hints[:half]), *hint_unions(hints[half:]))


def _select(
    batch, n_keys: int, n_passed: int, line_patterns: dict, text_patterns: dict, context_hint: str, deep_rules: dict
) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def found(strings, pattern: str):
        return pc.match_substring_regex(strings, pattern).fill_null(False).to_numpy(zero_copy_only=False)

    def found_any(strings, patterns: Sequence[str]):
        """Without patterns every text counts as found."""
        return np.logical_or.reduce([found(strings, p) for p in patterns]) if patterns else strings.is_valid().to_numpy(zero_copy_only=False)

    def rows(parents, line, text, mask, deep=None):
        passed = [c.take(pa.array(parents)) for c in batch.columns[:n_passed]]
        deep = pa.nulls(len(parents), pa.list_(pa.int32())) if deep is None else pa.array(deep, pa.list_(pa.int32()))
        arrays = [*passed, pa.array(line, pa.int32()), text.cast(pa.string()), pa.array(mask, pa.int32()), deep]
        return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n_passed], "_line", "_text", "_mask", "_deep"])

    on = batch.column(n_passed).to_numpy(zero_copy_only=False)
    content = batch.column(n_passed + 1)
    mask = np.zeros(len(on), dtype=np.int32)
    for bit in (PROVIDER, GENERIC, ENTROPY, CUSTOM):
        if bit not in line_patterns or not (bit in (PROVIDER, CUSTOM) or (on & bit).any()):
            continue
        mask |= np.where(found_any(content, line_patterns[bit]), bit, 0).astype(np.int32)
    mask &= on | ~(GENERIC | ENTROPY)
    tokens = np.flatnonzero(mask & ENTROPY)
    if len(tokens):
        mask[tokens[_binary(content.take(pa.array(tokens)))]] &= ~ENTROPY
    special = np.flatnonzero(found(content, context_hint))
    if len(special):
        whole = content.take(pa.array(special))
        for bit, patterns in text_patterns.items():
            hit = np.logical_and.reduce([found(whole, p) for p in patterns])
            mask[special] |= np.where(hit, bit, 0).astype(np.int32)

    code = on & CODE
    carries = (mask & K8S) != 0
    for column in batch.columns[n_keys:n_passed]:
        carries |= column.is_valid().to_numpy(zero_copy_only=False)
    files = np.flatnonzero(carries)
    if len(files):
        manifests = pa.array((mask[files] & K8S) != 0)
        text = pc.if_else(manifests, content.take(pa.array(files)), pa.scalar(None, content.type))
        yield rows(files, np.zeros(len(files), dtype=np.int32), text, mask[files] | code[files])

    chosen = np.flatnonzero(mask & LINE_LAYERS)
    if not len(chosen):
        return
    texts = content.take(pa.array(chosen))
    windows = pc.any(pc.match_substring(texts, "\r\n")).as_py()
    lists = pc.split_pattern_regex(texts, "\r?\n") if windows else pc.split_pattern(texts, "\n")
    lines = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    number = np.arange(len(lines)) - (offsets[parent] - offsets[0]) + 1
    wanted = mask[chosen][parent]
    line_mask = np.zeros(len(lines), dtype=np.int32)
    for bit, patterns in line_patterns.items():
        asked = np.flatnonzero(wanted & bit)
        if len(asked):
            some = lines if len(asked) == len(lines) else lines.take(pa.array(asked))
            line_mask[asked] |= np.where(found_any(some, patterns), bit, 0).astype(np.int32)
    opaque = np.flatnonzero(line_mask & ENTROPY)
    if len(opaque):
        random, doubtful = score_lines(lines.take(pa.array(opaque)))
        line_mask[opaque] &= ~ENTROPY
        line_mask[opaque] |= np.where(random, RANDOM, np.where(doubtful, ENTROPY, 0)).astype(np.int32)
    kept = np.flatnonzero(line_mask)
    if len(kept):
        owners, texts = chosen[parent[kept]], lines.take(pa.array(kept))
        deep = None
        if deep_rules:
            hits = {order: found(texts, pattern) for order, pattern in deep_rules.items()}
            deep = [[order for order, hit in hits.items() if hit[n]] for n in range(len(kept))]
        yield rows(owners, number[kept].astype(np.int32), texts, line_mask[kept] | code[owners], deep)


def _binary(texts):
    """A NUL, or over 30 % control characters, in each whole text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        size = pc.utf8_length(texts)
    except pa.ArrowInvalid:  # bytes that are not UTF-8: judge what the text reads as
        raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
        texts = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())
        size = pc.utf8_length(texts)
    size = np.maximum(size.to_numpy(zero_copy_only=False), 1)
    nul = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
    control = pc.count_substring_regex(texts, r"[\x01-\x08\x0E-\x1F]").to_numpy(zero_copy_only=False)
    return nul | (control / size > 0.3)
