"""Benchmark decontamination with a positional inverted index.

The index is spread by document. A segment holds some megabytes of whole texts:
for each term that the benchmark uses, the list of its positions, with
documents set apart so that no phrase runs from one into the next. Segments
are written to the shared folder, so they are built once and survive an
executor.

A phrase is looked up from its rarest terms, by the counts of the whole index:
the rarest term's positions, less its offset in the phrase, are intersected
with those of the next rarest, and so on. What is left after the last term is
where the phrase stands. Nothing but the index is read for that, and no posting
leaves its segment.

The benchmark goes to the tasks in blocks of bounded size; with more than one,
the index is passed through them in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import by_bytes, giving_back, utf8
from leakscan.sources.workspace import materialise

#: Digits, lower-case letters and everything beyond ASCII are in words; capitals A-Z become lower case.
_WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(128)) + bytes(range(128, 256))
_SEGMENT = "rows array<long>, doc_ids array<long>, words array<int>, terms array<binary>, postings array<int>, positions binary"
_HITS = "row long, doc_id long, n_words long, items array<string>, spans array<struct<begin:int,end:int>>"
_SEGMENT_ARROW = pa.schema(
    [
        ("rows", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("words", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.binary())),
        ("postings", pa.list_(pa.int32())),
        ("positions", pa.binary()),
    ]
)
_HITS_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
    ]
)


@dataclass(frozen=True)
class DecontaminationOptions:
    window: int = 10  # words of a phrase; an item of fewer words is one phrase
    segment_bytes: int = 4 << 20  # of text in a segment; a longer text is a segment of its own
    block_bytes: int = 2 << 20  # of benchmark text that is sent to the tasks at once
    broadcast_ids: int = 2_000_000  # contaminated documents, 8 bytes each, up to which their ids are sent to all tasks


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


class Segment:
    """The postings of some documents: sorted positions by term."""

    def __init__(self, words: np.ndarray, terms: list[bytes], postings: np.ndarray, positions: np.ndarray):
        self.words = words
        self.base = np.concatenate([[0], np.cumsum(words + 1)]).astype(np.int64)  # a gap after each document
        self._at = {t: k for k, t in enumerate(terms)}
        self._ends = np.concatenate([[0], np.cumsum(postings)])
        self._positions = positions

    def postings(self, term: bytes) -> np.ndarray:
        k = self._at.get(term)
        return self._positions[:0] if k is None else self._positions[self._ends[k] : self._ends[k + 1]]

    def find(self, phrase: list[bytes], rarest: list[int]) -> np.ndarray:
        """Where the phrase starts. ``rarest``: its offsets, the rarest term's first."""
        starts = self.postings(phrase[rarest[0]]) - rarest[0]
        for offset in rarest[1:]:
            if not len(starts):
                break
            there = self.postings(phrase[offset])
            if not len(there):
                return there
            at = np.searchsorted(there, starts + offset)
            starts = starts[there[np.minimum(at, len(there) - 1)] == starts + offset]
        return starts

    def near(self, phrase: list[bytes], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) wherever the terms follow in order with at most ``slop`` other words between; the nearest end for each start."""
        begin = self.postings(phrase[0])
        end = begin
        for term in phrase[1:]:
            there = self.postings(term)
            at = np.searchsorted(there, end, "right")
            keep = at < len(there)
            begin, end = begin[keep], there[at[keep]]
        keep = end - begin < len(phrase) + slop
        begin, end = begin[keep], end[keep] + 1
        same = np.searchsorted(self.base, begin, "right") == np.searchsorted(self.base, end - 1, "right")
        return begin[same], end[same]


@dataclass
class Phrase:
    words: list[bytes]
    items: list[str]
    rarest: list[int]  # offsets, the rarest term's first


def phrases_of(items: list[tuple[str | None, bytes]], window: int) -> list[Phrase]:
    """The distinct windows of some items, each with the items that have it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, data in items:
        words = words_of(data)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[at : at + window]), set()).update([] if item_id is None else [item_id])
    return [Phrase(list(words), sorted(ids), list(range(len(words)))) for words, ids in found.items()]


def build_index(docs: DataFrame, vocabulary: frozenset[bytes], options: DecontaminationOptions) -> DataFrame:
    """Segments of ``docs`` (row, doc_id, text) with the postings of the vocabulary's terms. A map over the input."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sorted(shared.value)
        number = {t: k for k, t in enumerate(terms)}
        for batch in batches:
            for part in by_bytes(batch, "text", options.segment_bytes):
                lengths, codes = [], []
                for data in utf8(part.column(2)):
                    words = words_of(data)
                    lengths.append(len(words))
                    codes.extend([number.get(w, -1) for w in words])
                    codes.append(-1)
                coded = np.array(codes, np.int32)
                at = np.flatnonzero(coded >= 0)
                used, postings = np.unique(coded[at], return_counts=True)
                segment = {
                    "rows": part.column(0).to_pylist(),
                    "doc_ids": part.column(1).to_pylist(),
                    "words": lengths,
                    "terms": [terms[k] for k in used.tolist()],
                    "postings": postings.tolist(),
                    "positions": at[np.argsort(coded[at], kind="stable")].astype("<i4").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([segment], schema=_SEGMENT_ARROW)

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SEGMENT)


def rank_terms(index: DataFrame, phrases: list[Phrase]) -> None:
    """Order each phrase's offsets by how often their terms occur in the whole index; at most a row per term is gathered."""
    counted = index.select(F.explode(F.arrays_zip("terms", "postings")).alias("t")).groupBy("t.terms").agg(F.sum("t.postings").alias("n"))
    counts = {bytes(r["terms"]): r["n"] for r in counted.toLocalIterator()}
    for phrase in phrases:
        phrase.rarest.sort(key=lambda k: (counts.get(phrase.words[k], 0), k))


def spans_of(segment: Segment, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """For each document the stretches that the ranges cover, in words from its first; touching ones are one."""
    covered = np.zeros(int(segment.base[-1]) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, ends, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8)]))
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[dict]] = [[] for _ in segment.words]
    for doc, begin, stop in zip((np.searchsorted(segment.base, begins, "right") - 1).tolist(), begins.tolist(), stops.tolist(), strict=True):
        base = int(segment.base[doc])
        out[doc].append({"begin": begin - base, "end": stop - base})
    return out


def search(index: DataFrame, phrases: list[Phrase], slop: int | None = None) -> DataFrame:
    """(row, doc_id, n_words, items, spans) for every document of the index, whether it has a phrase or not.

    With ``slop``, phrases also match where their terms follow in order with at
    most so many other words between them.
    """
    by_term: dict[bytes, list[Phrase]] = {}
    for phrase in phrases:
        by_term.setdefault(phrase.words[phrase.rarest[0]], []).append(phrase)
    shared = index.sparkSession.sparkContext.broadcast(by_term)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one segment at a time
                (s,) = batch.slice(at, 1).to_pylist()
                segment = Segment(np.array(s["words"], np.int64), s["terms"], np.array(s["postings"], np.int64), np.frombuffer(s["positions"], "<i4").astype(np.int64))
                starts, ends, items = [], [], [set() for _ in s["words"]]
                for term in s["terms"]:
                    for phrase in shared.value.get(term, ()):
                        if slop is None:
                            begin = segment.find(phrase.words, phrase.rarest)
                            end = begin + len(phrase.words)
                        else:
                            begin, end = segment.near(phrase.words, slop)
                        if len(begin):
                            starts.append(begin)
                            ends.append(end)
                            for doc in np.unique(np.searchsorted(segment.base, begin, "right") - 1).tolist():
                                items[doc].update(phrase.items)
                none = [np.zeros(0, np.int64)]
                hits = {
                    "row": s["rows"],
                    "doc_id": s["doc_ids"],
                    "n_words": s["words"],
                    "items": [sorted(x) for x in items],
                    "spans": spans_of(segment, np.concatenate(starts or none), np.concatenate(ends or none)),
                }
                yield pa.RecordBatch.from_pydict(hits, schema=_HITS_ARROW)

    return index.mapInArrow(run, _HITS)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``spans`` are the stretches of words inside any occurrence of a window,
    ``n_hit`` their words and ``items`` the ids, as text and sorted, whose
    windows occur. Null and empty texts have no words and no hits; items
    without words match nothing; an item without an id marks words but is not
    listed; items of the same id are one. Repeated rows come out as often as
    they came in. Either table may be empty. Other columns are not read.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = materialise(items.distinct(), "items")  # equal rows would all be dealt to one block
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // options.block_bytes))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if blocks > 1:  # rows are numbered once, as the blocks' results are put together by them
        docs = materialise(docs, "numbered")
    found: DataFrame | None = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = phrases_of([(r["item_id"], r["text"].encode()) for r in own.toLocalIterator()], options.window)
        index = materialise(build_index(docs, frozenset(w for p in phrases for w in p.words), options), "index")
        rank_terms(index, phrases)
        hits = search(index, phrases)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["begin"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"],
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, in the columns of ``docs``.

    Rows without an id are kept, as no result names them; rows that share an id
    go together.
    """
    found = materialise(find_benchmark(docs, benchmark, options).where("n_hit > 0 AND doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated")
    bounded = found.count() <= options.broadcast_ids
    return docs.join(F.broadcast(found) if bounded else found, "doc_id", "left_anti").select(*docs.columns)
