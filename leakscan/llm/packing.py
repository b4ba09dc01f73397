"""Packing documents into sequences of a fixed length by the sum of squares.

A document's token ids are cut into pieces of the sequence length; only the
last piece may be shorter. Pieces are then placed one by one: of all residual
gaps in which a piece fits, and a new sequence, the choice is the one after
which the squared numbers of open sequences per residual gap add up to least,
and the narrowest of equal ones. The rule keeps all gaps in stock, so later
pieces find one that they fill to the end.

Rows are dealt evenly into groups of bounded size, which are packed side by
side; a sequence never spans two groups, so each costs one unfilled sequence or
so. The order inside a group is free and is taken as long pieces first.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import by_bytes, giving_back, utf8
from leakscan.sources.workspace import materialise

#: Words in which lower case is letter by letter and accents are composed; apostrophes stand apart, as they part words.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿŒœ]+")
#: What the pre-tokenizer parts such a word into, once in lower case.
_PART = re.compile("[a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9]+")
#: Most words: letters, and signs behind them. These are the two parts.
_LETTERS_SIGNS = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
CACHED_CHARS = 64  # of a word that is remembered; longer ones are encoded each time
_NEVER = np.iinfo(np.int64).max
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackingOptions:
    tokenizer: str
    length: int = 2048
    end_id: int = 0
    group_pieces: int = 100_000  # pieces that one task packs, about
    batch_bytes: int = 4 << 20  # of text that is encoded at once
    cached_words: int = 300_000  # of a task; further words are encoded again each time


class WordEncoder(dict):
    """The ids of a text as little-endian unsigned 32-bit numbers, word by word with a memory of words.

    Holds for tokenizers that drop white space and never merge across it: the
    ids of a text are those of its words in a row. New words go through the
    library; of plain ones, each run of letters or signs does so once, whatever
    its case and neighbours. Once ``cached`` words are kept, others are encoded
    again wherever they occur.
    """

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self._tokenizer, self._cached, self._parts = Tokenizer.from_file(path), cached, {}
        self._merge = self._tokenizer.model.tokenize
        bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
        self._letters = str.maketrans({c: bytes_as_letters.pre_tokenize_str(c)[0][0] for c in letters})
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        # A special token that may stand in such a word would have to be looked for.
        may_hide = any(re.fullmatch(rb"[A-Za-z]*[!-&(-/:-@\[-`{-~]*", t.encode()) for t in special)
        self._two_parts = re.compile(rb"(?!)").fullmatch if may_hide else _LETTERS_SIGNS.fullmatch

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if text.isalpha():  # nothing left to normalise or to part: only the merges
            ids = array("I", [t.id for t in self._merge(text if text.isascii() else text.translate(self._letters))]).tobytes()
        else:
            ids = self._library(text)
        if len(self._parts) < self._cached and len(text) <= CACHED_CHARS:
            self._parts[text] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        parts = self._parts
        if two := self._two_parts(word):
            letters, signs = two[1].lower().decode(), two[2].decode()
            ids = parts.get(letters) or self._part(letters)
            if signs:
                ids += parts.get(signs) or self._part(signs)
        elif _PLAIN.fullmatch(text := word.decode()) and not self._special.search(text):
            ids = b"".join([parts.get(x) or self._part(x) for x in _PART.findall(text.lower())])
        else:
            ids = self._library(text)
        if len(self) < self._cached and len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Drop the words; the tokenizer stays."""
        self.clear()
        self._parts.clear()

    def encode(self, data: bytes) -> bytes:
        return b"".join(map(self.__getitem__, data.replace(b"\n", b" ").split(b" ")))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, cached: int) -> WordEncoder:
    """One for each Python worker, kept between its tasks without its words."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = WordEncoder(path, cached)
    return _encoders[path, cached]


def pieces(docs: DataFrame, options: PackingOptions) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut to the sequence length."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(options.tokenizer, options.cached_words), np.array([options.end_id], "<u4").tobytes()
        step = 4 * options.length
        for batch in batches:
            for some in by_bytes(batch, "text", options.batch_bytes):
                out = []
                for doc_id, text in zip(some.column(0).to_pylist(), utf8(some.column(1)), strict=True):
                    data = memoryview(encoder.encode(text) + end)
                    for k, start in enumerate(range(0, len(data), step)):
                        part = data[start : start + step]
                        out.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the order given."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    counts = np.zeros(size + 1, np.int64)
    used = 0
    for k, s in enumerate(lengths.tolist()):
        # How the sum of squares changes: n(g) becomes one less and n(g - s) one more; full sequences aren't counted.
        change = -2 * counts[s:size]
        change[1:] += 2 * counts[1 : size - s] + 1
        change = np.where(counts[s:size] > 0, change + 1, _NEVER)
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < _NEVER:  # a new sequence is opened only for what fits into no open one
            gap = s + best
            bin_ = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_ = size, used
            used += 1
        sequence[k], offset[k] = bin_, size - gap
        if gap > s:
            open_at[gap - s].append(bin_)
            counts[gap - s] += 1
    return sequence, offset


def pack(cut: DataFrame, options: PackingOptions) -> DataFrame:
    """``cut`` with sequence_id and offset: no sequence is longer than the limit or has a hole."""
    cut = materialise(cut, "pieces")
    groups = max(1, -(-cut.count() // options.group_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        lengths = rows.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        sequence, offset = sum_of_squares(lengths[order], options.length)
        first = TaskContext.get().partitionId() << 32
        packed = rows.take(pa.array(order)).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        yield from packed.combine_chunks().to_batches()

    dealt = cut.select(*names).repartition(groups)
    return dealt.mapInArrow(run, f"{_PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, options: PackingOptions) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text).

    A null or empty text is the end id alone. Repeated rows and ids are packed
    once each; an empty table gives an empty one. Other columns are not read.
    """
    return pack(pieces(docs, options), options)
