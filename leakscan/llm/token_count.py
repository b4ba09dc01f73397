"""Token counts by byte-pair merging on a heap and a linked list.

A text is parted as its tokenizer parts it; each part starts as one symbol per
byte. A heap holds the adjacent pairs that the vocabulary merges, lowest rank
first and leftmost among equals. Popping one joins two symbols in a linked
list and pushes the pairs with the new neighbours; pairs whose symbols have
changed meanwhile are skipped when they surface. A text of n symbols takes
O(n log n) steps however long its words are. The count is the initial symbols
less the merges; no ids are made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import utf8

#: A space before these characters always begins a new part, whatever stands before it.
_BREAK = re.compile(b" (?=[!-~\xc3])")
CACHED_CHARS = 64  # of a word that is remembered; longer ones are counted each time


@dataclass(frozen=True)
class TokenCountOptions:
    tokenizer: str  # a byte-level BPE file of the tokenizers library
    pattern: str  # that parts a text before the merges
    cached_words: int = 600_000  # whose counts each Python worker keeps; others are merged again each time


class MergeTable:
    """Byte-level merges of a tokenizer file: (left, right) to (rank, joined)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        kinds = (config["model"]["type"], config["pre_tokenizer"]["type"], config["normalizer"])
        if kinds != ("BPE", "ByteLevel", None) or config["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a byte-level BPE without normalizer or prefix space: {kinds}")
        numbers = config["model"]["vocab"]
        self.symbols = [numbers[c] for c in _byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(config["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((numbers[left], numbers[right]), (rank, numbers[left + right]))
        self.special = [t["content"].encode() for t in config["added_tokens"]]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in such files: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def count_merged(data: bytes, table: MergeTable) -> int:
    """How many symbols are left of the bytes of one part."""
    merges = table.merges
    symbols = [table.symbols[b] for b in data]
    size = len(symbols)
    following, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []
    for at in range(size - 1):
        if found := merges.get((symbols[at], symbols[at + 1])):
            heap.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
    heapify(heap)
    done = 0
    while heap:
        _, at, left, right, joined = heappop(heap)
        other = following[at] if symbols[at] == left else size
        if other >= size or symbols[other] != right:
            continue
        done += 1
        symbols[at], symbols[other] = joined, -1
        after = following[at] = following[other]
        if after < size:
            before[after] = at
            if found := merges.get((joined, symbols[after])):
                heappush(heap, (found[0], at, joined, symbols[after], found[1]))
        if (previous := before[at]) >= 0 and (found := merges.get((symbols[previous], joined))):
            heappush(heap, (found[0], previous, symbols[previous], joined, found[1]))
    return size - done


class TokenCounter(dict):
    """Counts of texts, with a memory of words and the space before them."""

    def __init__(self, options: TokenCountOptions):
        super().__init__()
        self._table, self._cached, self._parts = MergeTable(options.tokenizer), options.cached_words, {}
        self._split = regex.compile(options.pattern).findall
        self._special = re.compile(b"|".join(map(re.escape, self._table.special)) or b"(?!)")

    def _part(self, text: str) -> int:
        if (count := self._parts.get(text)) is None:
            count = count_merged(text.encode(), self._table)
            if len(self._parts) < self._cached and len(text) <= CACHED_CHARS:
                self._parts[text] = count
        return count

    def __missing__(self, word: bytes) -> int:
        count = sum(map(self._part, self._split(word.decode())))
        if len(self) < self._cached and len(word) <= CACHED_CHARS:
            self[word] = count
        return count

    def count(self, data: bytes) -> int:
        """Tokens of a text. A special token's own string in it is one token, as the library has it."""
        if self._special.search(data):
            found = len(self._special.findall(data))
            return found + sum(self.count(x) for x in self._special.split(data))
        first, *rest = _BREAK.split(data)
        return self[first] + sum(map(self.__getitem__, [b" " + x for x in rest]))


_counters: dict[TokenCountOptions, TokenCounter] = {}


def count_tokens(docs: DataFrame, options: TokenCountOptions) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text).

    A null or empty text has neither bytes nor tokens. Ids may be null or
    repeat; an empty table gives an empty one. Other columns are not read. A
    map over the input: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(options) or _counters.setdefault(options, TokenCounter(options))
        for batch in batches:
            texts = utf8(batch.column(1))
            counts = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
