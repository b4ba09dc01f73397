"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A label's score is linear in features of
the line and of the lines before and after it; neighbouring labels are tied by
a table of transitions. Forward-backward gives each line's marginal probability
of being good, and a document's quality is their mean, weighted by the lines'
lengths.

The field is fitted on the driver to a bounded sample of labelled documents,
whose lines carry their document's label: at most ``train_documents`` and
``train_lines``, the first by a hash of the id. Either label may take half of
both, and what the other leaves; a document gives at most ``document_lines``,
in pieces spread over it. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import by_bytes, utf8
from leakscan.sources.workspace import materialise

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(0x80, 0x100))
_DIGITS = b"0123456789"
_COMMON = b" .,;:'\"-?()"
_BLANK = b" \t\r\x0b\x0c"
_OWN = 16  # features of a line by itself
FEATURES = 3 * _OWN + 1


@dataclass(frozen=True)
class QualityOptions:
    train_documents: int = 6000
    train_lines: int = 120_000
    document_lines: int = 2000
    window: int = 200  # lines of a training sequence; longer documents are cut for training only
    steps: int = 150
    rate: float = 0.1
    penalty: float = 1e-3
    batch_bytes: int = 4 << 20


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, for good against bad
    ties: np.ndarray  # 2 x 2: the score of a label after a label; 0 is bad
    first: np.ndarray  # 2: of the first line's label


def line_features(line: bytes, seen: int) -> tuple[float, ...]:
    """Numbers that describe a line; ``seen``: how often it came before in its document."""
    size = len(line)
    if not size:
        return (1.0, *[0.0] * (_OWN - 1))
    words = line.split()
    count = len(words)
    letters = size - len(line.translate(None, _LETTERS))
    upper = size - len(line.translate(None, _UPPER))
    digits = size - len(line.translate(None, _DIGITS))
    signs = len(line.translate(None, _LETTERS + _DIGITS + _COMMON + _BLANK))
    tail = line.rstrip()[-1:]
    most = max(map(len, words)) if words else 0
    return (
        0.0,
        math.log1p(size),
        letters / size,
        upper / size,
        digits / size,
        signs / size,
        min(1.0, 8 * signs / size),
        float(upper > 0.5 * letters),
        count / size,
        len(set(words)) / count if count else 0.0,
        math.log1p(count),
        min(most, 60) / 10,
        float(tail in b".!?" and tail != b""),
        float(line[:1] in _UPPER),
        line.count(b"|") / size * 10,
        min(seen, 5) / 5,
    )


def document_features(data: bytes) -> np.ndarray:
    """lines x own features of a text; an empty one has a single empty line."""
    seen: dict[bytes, int] = {}
    rows = []
    for line in data.split(b"\n"):
        before = seen.get(line, 0)
        seen[line] = before + 1
        rows.append(line_features(line, before))
    return np.array(rows, np.float32)


def with_neighbours(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each line's features, the previous and the next line's, and one. Beyond a document's ends stand zeros."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(lengths)
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], 1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, ties: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Marginals of good per line, summed marginals of label pairs, the log of all paths, and marginals of the first labels.

    Sequences are taken side by side, longest first, one line at a time.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    still = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]  # sequences with more than t lines
    emit = np.stack([np.zeros_like(scores), scores], 1)
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest):
        at = starts[: still[t]] + t
        alpha[at] = emit[at] + (first if t == 0 else np.logaddexp(alpha[at - 1, :1] + ties[0], alpha[at - 1, 1:] + ties[1]))
    total = np.logaddexp(*alpha[starts + sizes - 1].T) if len(sizes) else np.zeros(0)
    for t in range(longest - 1, 0, -1):
        at = starts[: still[t]] + t
        on = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(ties[:, 0] + on[:, :1], ties[:, 1] + on[:, 1:])
        joint = alpha[at - 1][:, :, None] + ties + on[:, None, :] - total[: still[t], None, None]
        pairs += np.exp(joint).sum(0)
    by_line = np.repeat(total, sizes)
    place = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)]) if len(sizes) else np.zeros(0, int)
    good = np.zeros(len(scores))
    good[place] = np.exp(np.minimum(alpha[place, 1] + beta[place, 1] - by_line, 0))
    heads = good[starts].sum() if len(sizes) else 0.0
    return good, pairs, float(total.sum()), np.array([len(sizes) - heads, heads])


def fit_field(own: np.ndarray, lengths: np.ndarray, labels: np.ndarray, options: QualityOptions) -> LineField:
    """Maximum likelihood with a quadratic penalty, by Adam. ``labels``: one 0 or 1 per line."""
    x = with_neighbours(own, lengths).astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    x = (x - mean) / scale
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (labels[at - 1], labels[at]), 1)
    seen_first = np.bincount(labels[starts], minlength=2).astype(float)
    theta = np.zeros(FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, options.steps + 1):
        weights, ties, first = theta[:FEATURES], theta[FEATURES:-2].reshape(2, 2), theta[-2:]
        good, pairs, _, heads = forward_backward(x @ weights, lengths, ties, first)
        slope = np.concatenate([x.T @ (labels - good), (seen_pairs - pairs).ravel(), seen_first - heads]) / len(labels)
        slope -= options.penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(mean, scale, theta[:FEATURES].copy(), theta[FEATURES:-2].reshape(2, 2).copy(), theta[-2:].copy())


def shares(sizes: list[int], total: int) -> list[int]:
    """How much of ``total`` each of two labels may have: half, and what the other has no use for."""
    return [min(own, max(total // 2, total - other)) for own, other in (sizes, sizes[::-1])]


def pieces(lines: int, take: int, window: int) -> list[tuple[int, int]]:
    """(first, behind the last) line of pieces of at most ``window``, ``take`` lines in all, spread over ``lines``."""
    take = min(take, lines)
    count = -(-take // window)
    starts = [k * window + k * (lines - take) // count for k in range(count)]
    return [(at, at + min(window, take - k * window)) for k, at in enumerate(starts)]


def sample(docs: DataFrame, labels: DataFrame, options: QualityOptions) -> DataFrame:
    """(doc_id, label, text, take): the texts to learn from, one an id, and how many of their lines."""
    chosen = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    chosen = chosen.where("label = most").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("label").cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    # At most ``train_documents`` ids of either label: bounded whatever the tables hold.
    ids = [chosen.where(F.col("label") == k).orderBy(*order).limit(options.train_documents).collect() for k in (0, 1)]
    ids = [own[:n] for own, n in zip(ids, shares([len(own) for own in ids], options.train_documents), strict=True)]
    named = spark.createDataFrame([(r["doc_id"], r["label"], at) for own in ids for at, r in enumerate(own)], f"doc_id {kind}, label int, at int")
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(named), "doc_id")
    # Rows that share an id count once, with the smallest text.
    held = materialise(held.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("at").alias("at"), F.min("text").alias("text")), "labelled")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes: list[list[tuple]] = [[], []]
    for r in held.select("doc_id", "label", "at", lines.alias("n")).collect():
        sizes[r["label"]].append((r["at"], r["doc_id"], min(r["n"], options.document_lines)))
    takes = []
    for own, left in zip(sizes, shares([sum(x[2] for x in own) for own in sizes], options.train_lines), strict=True):
        for _, doc_id, n in sorted(own):
            if left:
                takes.append((doc_id, min(n, left)))
                left -= takes[-1][1]
    taken = spark.createDataFrame(takes, f"doc_id {kind}, take int")
    return held.join(F.broadcast(taken), "doc_id").select("doc_id", "label", "text", "take")


def fit(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> LineField | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label). None where both labels do not occur.

    Labels other than 0 and 1, and ids with both, are not used. The sample is
    chosen among the ids, so only its texts are read into features; it does not
    depend on how the tables are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", options.batch_bytes):
                cuts = []
                for data, take in zip(utf8(part.column(2)), part.column(3).to_pylist(), strict=True):
                    rows = document_features(data)
                    cuts.append([rows[a:b].tobytes() for a, b in pieces(len(rows), take, options.window)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cuts, pa.list_(pa.binary()))], ["doc_id", "label", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = sample(docs, labels, options).mapInArrow(run, f"doc_id {kind}, label int, pieces array<binary>").orderBy("doc_id")
    own, marks = [], []
    for row in learned.collect():  # at most ``train_lines`` lines
        for piece in row["pieces"]:
            own.append(np.frombuffer(piece, np.float32).reshape(-1, _OWN))
            marks.append(np.full(len(own[-1]), row["label"]))
    if len({int(x[0]) for x in marks}) < 2:
        return None
    return fit_field(np.concatenate(own), np.array([len(x) for x in own]), np.concatenate(marks), options)


def score_batch(texts: list[bytes], field: LineField) -> tuple[np.ndarray, np.ndarray]:
    """(quality, lines) of each text."""
    own = [document_features(t) for t in texts]
    lengths = np.array([len(x) for x in own])
    weight = np.concatenate([np.array([len(line) + 1 for line in t.split(b"\n")], float) for t in texts])
    x = (with_neighbours(np.concatenate(own), lengths) - field.mean) / field.scale
    good, *_ = forward_backward(x @ field.weights, lengths, field.ties, field.first)
    starts = np.cumsum(lengths) - lengths
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1), lengths


def score(docs: DataFrame, field: LineField | None, options: QualityOptions = QualityOptions()) -> DataFrame:
    """(doc_id, score, n_lines) for every row of ``docs`` (doc_id, text).

    A null text is empty and an empty one is a single empty line. Without a
    field every score is 0.5. Repeated rows come out as often as they came in;
    an empty table gives an empty one. Other columns are not read. A map over
    the input: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", options.batch_bytes):
                texts = utf8(part.column(1))
                if shared.value is None:
                    scores, lines = np.full(len(texts), 0.5), np.array([t.count(b"\n") + 1 for t in texts])
                else:
                    scores, lines = score_batch(texts, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(lines, pa.int64())], ["doc_id", "score", "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_lines long")
