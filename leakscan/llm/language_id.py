"""Language identification with error-correcting output codes.

Each language has a codeword of plus and minus ones. One binary classifier per
bit, a log-odds table over hashed letter trigrams, predicts on which side of
the bit's split a text lies; a text gets the language whose codeword has the
smallest weighted loss against the predicted margins.

The classifiers are learned from counts over *all* training rows: a task adds
up its own counts per language, and what reaches the driver has at most
``features`` rows per language, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import strings

UNDETERMINED = "und"
_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_STEP = 1 << 20


@dataclass(frozen=True)
class LanguageIdOptions:
    features: int = 1 << 14
    smoothing: float = 0.5
    exhaustive_up_to: int = 7  # languages; with more the code is a random one
    bits_per_doubling: int = 10  # length of a random code: so many bits for each log2 of the languages
    steepness: float = 4.0  # of the logistic loss, in units of a bit's usual margin
    ambiguous_below: float = 0.5  # scores under this are flagged
    max_languages: int = 1024  # more distinct labels than this are refused, as the tables go to every task


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of +1 and -1
    weights: np.ndarray  # features x bits: log odds in units of the bit's usual margin
    trust: np.ndarray  # languages x bits: how much a bit says about a language; rows sum to 1
    options: LanguageIdOptions


def trigrams(text: str, features: int) -> Iterator[np.ndarray]:
    """Hashed letter trigrams of the lower-cased text, in pieces of bounded size."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACE) + b" ", np.uint8)
    for at in range(0, len(data) - 2, _STEP):
        x = data[at : at + _STEP + 2].astype(np.uint32)
        packed = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        packed = packed[packed != 0x202020]
        yield (packed * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(features)


def count_trigrams(rows: DataFrame, options: LanguageIdOptions) -> DataFrame:
    """(lang, feature, n) over every row of (lang, text); added up in each task before the shuffle."""
    features = options.features

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                sums = seen.setdefault(lang, np.zeros(features, np.int64))
                if len(seen) > options.max_languages:
                    raise ValueError(f"more than {options.max_languages} languages")
                for piece in trigrams(text, features):
                    sums += np.bincount(piece, minlength=features)
        for lang, sums in seen.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())],
                ["lang", "feature", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, feature int, n long")
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def codewords(languages: int, options: LanguageIdOptions) -> np.ndarray:
    """A row of +1 and -1 per language: every split once if they are few, else the best of some random codes."""
    if languages <= options.exhaustive_up_to:
        splits = range(1, 1 << max(languages - 1, 0))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(languages)]).reshape(languages, len(splits))
    bits, best, apart = int(np.ceil(options.bits_per_doubling * np.log2(languages))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1, 1], (languages, bits))
        agree = code @ code.T - 2 * bits * np.eye(languages, dtype=int)
        least = (bits - agree.max()) // 2
        if least > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, least
    if best is None:
        raise ValueError("no code separates these languages")
    return best


def fit(training: DataFrame, options: LanguageIdOptions = LanguageIdOptions()) -> LanguageModel:
    """Learn from (lang, text). Rows without a language are not used; a null text adds nothing."""
    got = count_trigrams(training.where(F.col("lang").isNotNull()), options).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((len(languages), options.features))
    np.add.at(counts, (got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), got["feature"].to_numpy(int)), got["n"].to_numpy(float))
    code = codewords(len(languages), options)
    if code.shape[1] == 0:
        return LanguageModel(languages, code, np.zeros((options.features, 0), np.float32), code.astype(float), options)
    share = (counts + options.smoothing) / (counts + options.smoothing).sum(1, keepdims=True)
    sides = [[share[code[:, b] == side].mean(0) for side in (1, -1)] for b in range(code.shape[1])]
    weights = np.stack([np.log(plus) - np.log(minus) for plus, minus in sides], 1)
    margins = (share @ weights) * code  # the mean margin of each bit over a language's own trigrams
    weights /= np.abs(margins).mean(0)
    trust = np.maximum(margins / np.abs(margins).mean(0), 1e-3)
    return LanguageModel(languages, code, weights.astype(np.float32), trust / trust.sum(1, keepdims=True), options)


def decode(margins: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number for each row of margins, and its share of the likelihood."""
    loss = np.logaddexp(0, -model.options.steepness * margins[:, None, :] * model.code[None])
    total = -(loss * model.trust[None]).sum(2) * max(1, margins.shape[1])
    total -= total.max(1, keepdims=True)
    share = np.exp(total) / np.exp(total).sum(1, keepdims=True)
    return share.argmax(1), share.max(1)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score and lang_ambiguous appended.

    A text that is null or without any letter is ``und`` with score 0, as is
    every text under a model without languages. Columns of these names are
    replaced. A map over the input: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    docs = docs.drop(*added)
    schema = docs.selectExpr("*", "'' AS lang_pred", "0D AS lang_score", "true AS lang_ambiguous").schema
    for name in added:
        schema[name].nullable = True

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            margins, known = np.zeros((len(texts), m.code.shape[1])), np.zeros(len(texts), bool)
            for row, text in enumerate(texts):
                if m.languages and any(map(str.isalpha, text)):
                    known[row], grams = True, 0
                    for piece in trigrams(text, m.options.features):
                        margins[row] += m.weights[piece].sum(0)
                        grams += len(piece)
                    margins[row] /= max(grams, 1)
            if m.languages:
                best, share = decode(margins, m)
                share = np.where(known, share, 0.0)
                names = [m.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            else:
                share, names = np.zeros(len(texts)), [UNDETERMINED] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(share), pa.array(share < m.options.ambiguous_below)],
                [*batch.schema.names, *added],
            )

    return docs.mapInArrow(score, schema)
