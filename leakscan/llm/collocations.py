"""Collocations: phrases that occur far more often than their parts would have it.

The counts of all phrases of up to ``longest`` words come from one weighted de
Bruijn graph for each language. A node is a run of ``longest - 1`` words of a
piece of text, an edge the run of ``longest`` words that overlaps two nodes.

1. Edges. Each stretch of input counts its edges, and the runs that only the
   end of a piece keeps from being longer. Nodes are split over buckets; a
   bucket's edges and counts are merged as sorted arrays.
2. Flow. A node occurs as often as its edges leave it, and once more for each
   piece that ends in it; a run of one word less occurs as often as the nodes
   that begin with it, and so on down to words. Nothing shorter than an edge
   is counted in the text, but for the ends of pieces.
3. Names. Texts are dealt to classes by hash, and each run knows the lowest
   class that has it. Runs whose flow reaches ``least`` are named by the texts
   of that class alone: a filter of a bounded size picks them there, a join
   by hash drops what else passes it. So a run is named about once, however
   frequent it is and however many tasks meet it.
4. Paths. An edge is joined to the next where their node has no other edge and
   no end, which is where all three have one count. Such unary paths are
   compacted by pointer doubling, in rounds as many as the logarithm of the
   longest, and kept in rows of at most ``path_edges`` edges.

The runs of ``longest`` words are read off the paths, the shorter ones are the
named flows. All shuffles are of counts that were added up before.

Runs are told apart by 64 bits of hash (edges by 96) of their words' own 64, so
a count could be wrong only where a frequent run shares them with another one.
With 700,000 frequent runs among 10^8, as in 0.5 GB, the chance of any is about
4 in a million.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.common import by_bytes, utf8
from leakscan.operators.lookup import attach
from leakscan.operators.membership import build_filters
from leakscan.options import ScanOptions
from leakscan.sources.workspace import materialise

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_END = b"\xff"  # in no UTF-8 text
_CLASSES = 1 << 16  # of texts


@dataclass(frozen=True)
class CollocationOptions:
    longest: int = 4  # words of a phrase, 3 at least
    least: int = 30  # occurrences of a phrase
    absorbed: int = 80  # percent of a phrase's occurrences that lie in one longer phrase, for the shorter one to go
    scale: int = 2_000_000  # of the score
    top: int = 2000  # phrases of a language in the report
    segment_words: int = 1 << 19  # whose runs are counted at once
    bucket_bytes: int = 4 << 20  # of text for each bucket of nodes: about 20 MB of hashes
    filter_bits: int = 1 << 26  # of the filter of frequent runs, 8 MB; with more than 4 million runs, more others pass it
    broadcast_runs: int = 2_000_000  # edges up to which the steps between them are sent to all tasks, 24 bytes each
    path_edges: int = 64  # edges in a row of a path
    batch_bytes: int = 2 << 20  # of texts that are held as words at once


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def words_of(data: bytes) -> list[bytes]:
    """A text's words, A-Z in lower case, and an ``_END`` behind each piece."""
    return [*_ENDS.sub(b" \xff ", data.lower()).split(), _END]


class Runs:
    """The runs of words that begin at each place of some texts, by hash."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, langs: np.ndarray, longest: int):
        """``codes``: of words, ``ends``: places behind pieces, the last place among them, ``langs``: of each place."""
        n, odd = len(codes), np.full(1, _ODD)
        #: Words from each place to the end of its piece; 0 at ends.
        self.left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        #: ``hashes[m]``: of the run of m + 1 words; right only where so many are left.
        self.hashes = [_mixed(codes ^ langs)]
        shifted = codes
        for m in range(1, longest):
            shifted = np.append(codes[m:], np.zeros(min(m, n), np.uint64))
            if m < longest - 1:
                self.hashes.append(_mixed(self.hashes[-1] * odd + shifted))
        #: Of the word behind each node, never 0.
        self.following = np.maximum(shifted >> np.uint64(32), np.uint64(1)).astype(np.uint32)

    def edges(self) -> np.ndarray:
        return edge_hashes(self.hashes[-1], self.following)


def edge_hashes(nodes: np.ndarray, following: np.ndarray) -> np.ndarray:
    return _mixed(nodes * np.full(1, _ODD) + following.astype(np.uint64))


def _merged(keys: list[np.ndarray], weights: np.ndarray, classes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(each key once, in order, the sum of its weights, its lowest class, a place that has it)."""
    if not len(weights):
        return keys, weights, classes, np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    return [k[first] for k in keys], np.add.reduceat(weights[order], first), np.minimum.reduceat(classes[order], first), order[first]


def flows(runs: Runs, classes: np.ndarray, longest: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(words, keys, counts, classes): the edges, and from their flow all shorter runs but the nodes, which their edges tell.

    ``classes``: of the text at each place. An edge's keys are its node and the word behind it.
    """
    at = np.flatnonzero(runs.left >= longest - 1)
    # A node at the end of a piece is an edge to no word.
    behind = np.where(runs.left[at] >= longest, runs.following[at], np.uint32(0))
    keys, counts, lowest, place = _merged([runs.hashes[-1][at], behind], np.ones(len(at), np.int64), classes[at])
    yield longest, keys, counts, lowest
    place = at[place]
    for words in range(longest - 2, 0, -1):
        last = np.flatnonzero(runs.left == words)
        at = np.append(place, last)
        counts, lowest = np.append(counts, np.ones(len(last), np.int64)), np.append(lowest, classes[last])
        keys, counts, lowest, place = _merged([runs.hashes[words - 1][at]], counts, lowest)
        place = at[place]
        yield words, keys, counts, lowest


def _code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _lang_code(lang: str) -> int:
    """Of another seed than words: a word that is spelled like its language must not cancel it out."""
    return xxhash.xxh64_intdigest(lang.encode(), seed=1)


def _texts(docs: DataFrame) -> DataFrame:
    """(lang, class, text), by which a text has one class wherever it stands."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(_CLASSES)).cast("int").alias("class"), text.alias("text"))


@dataclass
class Part:
    """A few texts: their words, an ``_END`` behind each piece."""

    words: list[bytes]
    codes: np.ndarray
    ends: np.ndarray
    langs: np.ndarray  # hash of each place's language
    classes: np.ndarray  # class of each place's text
    sizes: list[tuple[str, int]]  # language and words of each text


def _parts(batches: Iterator[pa.RecordBatch], options: CollocationOptions) -> Iterator[Part]:
    end, hashed = np.uint64(_code(_END)), {}
    for batch in batches:
        for some in by_bytes(batch, "text", options.batch_bytes):
            words, sizes = [], []
            for lang, data in zip(some.column(0).to_pylist(), utf8(some.column(2)), strict=True):
                before = len(words)
                words += words_of(data)
                sizes.append((lang, len(words) - before))
                hashed.setdefault(lang, _lang_code(lang))
            codes = np.fromiter(map(_code, words), np.uint64, len(words))
            ends = np.array([k for k in np.flatnonzero(codes == end).tolist() if words[k] == _END], np.int64)
            each = [n for _, n in sizes]
            langs = np.repeat(np.array([hashed[lang] for lang, _ in sizes], np.uint64), each)
            classes = np.repeat(some.column(1).to_numpy().astype(np.uint16), each)
            yield Part(words, codes, ends, langs, classes, sizes)


def edge_counts(docs: DataFrame, buckets: int, options: CollocationOptions) -> DataFrame:
    """(bucket, words, lang, n, keys, behind, counts, classes): what each stretch of input adds to each bucket, as sorted arrays.

    Rows with ``words`` 0 count the words of a language instead.
    """
    names = ["bucket", "words", "lang", "n", "keys", "behind", "counts", "classes"]

    def packed(held: list[Part]) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum([0] + [len(p.codes) for p in held[:-1]])
        ends = np.concatenate([p.ends + s for p, s in zip(held, sizes, strict=True)])
        runs = Runs(np.concatenate([p.codes for p in held]), ends, np.concatenate([p.langs for p in held]), options.longest)
        for words, keys, counts, lowest in flows(runs, np.concatenate([p.classes for p in held]), options.longest):
            bucket = (keys[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(edges)).tolist()
            behind = keys[1] if len(keys) > 1 else np.zeros(0, np.uint32)
            arrays = keys[0].astype("<u8"), behind.astype("<u4"), counts.astype("<u4"), lowest.astype("<u2")
            blobs = [pa.array([a[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()) for a in arrays]
            none = pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([words] * len(used), pa.int32()), *none, *blobs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, totals = [], 0, Counter()
        for part in _parts(batches, options):
            before = 0
            for lang, n in part.sizes:
                totals[lang] += n - int(np.searchsorted(part.ends, before + n) - np.searchsorted(part.ends, before))
                before += n
            part.words = []
            held.append(part)
            size += len(part.codes)
            if size >= options.segment_words:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)
        rows = [(_code(lang.encode()) % buckets, 0, lang, n, b"", b"", b"", b"") for lang, n in totals.items() if n]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return _texts(docs).mapInArrow(run, "bucket int, words int, lang string, n long, keys binary, behind binary, counts binary, classes binary")


def frequent_runs(counted: DataFrame, buckets: int, options: CollocationOptions) -> DataFrame:
    """(words, hash, class, lang, n) of all runs that occur ``least`` times or more, by the flow of whole nodes.

    ``lang`` is only set where ``words`` is 0: all words of a language.
    """
    names = ["words", "hash", "class", "lang", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        totals: Counter = Counter()
        for batch in batches:
            for k, words in enumerate(batch.column(0).to_pylist()):
                if words:
                    blobs = [batch.column(c)[k].as_buffer() for c in range(3, 7)]
                    parts.setdefault(words, []).append([np.frombuffer(b, kind) for b, kind in zip(blobs, ("<u8", "<u4", "<u4", "<u2"), strict=True)])
                else:
                    totals[batch.column(1)[k].as_py()] += batch.column(2)[k].as_py()
        for words, held in parts.items():
            keys, behind, counts, classes = (np.concatenate([h[k] for h in held]) for k in range(4))
            keys, flow, lowest, _ = _merged([keys, behind] if words == options.longest else [keys], counts.astype(np.int64), classes)
            out = [(words, keys[0], lowest, flow)]
            if words == options.longest:
                (nodes,), through, least, _ = _merged([keys[0]], flow, lowest)
                inner = keys[1] != 0
                out = [(words, edge_hashes(*keys)[inner], lowest[inner], flow[inner]), (words - 1, nodes, least, through)]
            for size, found, lowest, flow in out:
                often = flow >= options.least
                columns = [pa.array(np.full(often.sum(), size, np.int32)), pa.array(found[often].view(np.int64)), pa.array(lowest[often].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(often.sum()), pa.string()), pa.array(flow[often])], names)
        none = [pa.array([0] * len(totals), kind) for kind in (pa.int32(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], names)

    dealt = counted.repartitionById(buckets, F.col("bucket")).drop("bucket")
    return dealt.mapInArrow(run, "words int, hash long, class int, lang string, n long")


def named(docs: DataFrame, frequent: DataFrame, options: CollocationOptions) -> DataFrame:
    """(words, hash, lang, phrase): words for the runs of ``frequent``, found in the texts of each one's class. Some are named more than once."""
    spark, longest = docs.sparkSession, options.longest
    runs = frequent.where("words > 0")
    count = runs.count()
    if not count:
        return spark.createDataFrame([], "words int, hash long, lang string, phrase string")
    # A run is only known together with its class.
    known = spark.sparkContext.broadcast(build_filters(runs.select(F.lit(0).alias("kind"), F.expr("hash ^ shiftleft(cast(class + 1 as bigint), 40)").alias("hash")), {0: count}, options.filter_bits)[0])
    used = np.zeros(_CLASSES, bool)
    used[[r[0] for r in runs.select("class").distinct().collect()]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(used[batch.column(1).to_numpy()]))
            for part in _parts(iter([batch]), options):
                found = Runs(part.codes, part.ends, part.langs, longest)
                of = np.repeat(np.arange(len(part.sizes)), [n for _, n in part.sizes])
                own = (part.classes.astype(np.uint64) + np.uint64(1)) << np.uint64(40)
                rows: set = set()
                for m, hashes in enumerate([*found.hashes, found.edges()]):
                    at = np.flatnonzero(found.left > m)
                    at = at[known.value.may_hold(hashes[at] ^ own[at])]
                    phrases = [b" ".join(part.words[k : k + m + 1]) for k in at.tolist()]
                    langs = [part.sizes[k][0] for k in of[at].tolist()]
                    rows.update(zip([m + 1] * len(at), hashes[at].view(np.int64).tolist(), langs, phrases, strict=True))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.string())], ["words", "hash", "lang", "phrase"])

    return _texts(docs).mapInArrow(run, "words int, hash long, lang string, phrase string")


def phrase_counts(docs: DataFrame, options: CollocationOptions = CollocationOptions()) -> DataFrame:
    """(lang, words, phrase, n): all runs of 1 to ``longest`` words that occur ``least`` times or more, counted.

    Words are joined by one space. A row with ``words`` 0 and an empty phrase
    counts all words of a language. Rows of ``docs`` (lang, text): a null lang
    is ``und``, a null or empty text has no words, repeated rows count each
    time; an empty table gives an empty one. Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // options.bucket_bytes))
    frequent = materialise(frequent_runs(edge_counts(docs, buckets, options), buckets, options), "frequent")
    names = named(docs, frequent, options).groupBy("words", "hash").agg(F.min(F.struct("lang", "phrase")).alias("name"))
    found = frequent.drop("lang", "class").join(names, ["words", "hash"]).select("name.lang", "words", "name.phrase", "n")
    totals = frequent.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), "n")
    return materialise(found.unionByName(totals), "runs")


def _without(words: Column, ends: str) -> Column:
    """A phrase without its first or its last word."""
    return F.regexp_replace(words, "^[^ ]+ " if ends == "first" else " [^ ]+$", "")


def paths(counts: DataFrame, options: CollocationOptions = CollocationOptions()) -> DataFrame:
    """(lang, path, part, phrase, n): the unary paths of the edges in ``counts``, as phrases of many words.

    All runs of ``longest`` words in ``phrase`` occur ``n`` times, and each run
    of ``counts`` lies in one row. A path of more than ``path_edges`` edges has
    several rows, numbered by ``part``, which overlap by ``longest - 1`` words.
    Edges that follow one another in a ring stay by themselves.
    """
    edges = counts.where(F.col("words") == options.longest).select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", "n")
    edges = materialise(edges, "edges")
    nodes = counts.where(F.col("words") == options.longest - 1).select("lang", F.col("phrase").alias("node"), "n")
    leaving = edges.select("lang", _without(F.col("phrase"), "last").alias("node"), "n", F.col("id").alias("after"))
    arriving = edges.select("lang", _without(F.col("phrase"), "first").alias("node"), "n", F.col("id").alias("before"))
    # An edge with its node's whole count is the only one on its side: each key has one row.
    links = leaving.join(nodes, ["lang", "node", "n"]).join(arriving, ["lang", "node", "n"]).select("after", "before")
    state = edges.select("id").join(links, F.col("id") == F.col("after"), "left")
    state = materialise(state.select("id", F.coalesce("before", "id").alias("up"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps")), "steps")
    small, before = edges.count() <= options.broadcast_runs // 8, None
    while True:
        # Of edges that begin a path nothing is asked: they are their own ``up``, no step away.
        target = state.where("up <> id").select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        joined = state.join(F.broadcast(target) if small else target, "up", "left")
        steps = F.col("steps") + F.coalesce("more", F.lit(0).cast("long"))
        state = joined.select("id", F.coalesce("further", "up").alias("up"), steps.alias("steps"), F.col("further").isNotNull().alias("moved"))
        state = materialise(state, "steps")
        moved = state.where("moved").count()
        if moved in (0, before):  # those of a path become fewer each time, those of rings never
            break
        before = moved
    placed = edges.join(state, "id").select(
        "lang", F.when(F.col("moved"), F.col("id")).otherwise(F.col("up")).alias("path"), F.when(F.col("moved"), 0).otherwise(F.col("steps")).alias("steps"), "phrase", "n"
    )
    parts = placed.groupBy("lang", "path", F.floor(F.col("steps") / options.path_edges).alias("part"), "n").agg(F.array_sort(F.collect_list(F.struct("steps", "phrase"))).alias("edges"))
    more = F.transform(F.slice("edges", 2, options.path_edges), lambda e: F.substring_index(e["phrase"], " ", -1))
    return parts.select("lang", "path", "part", F.concat_ws(" ", F.col("edges")[0]["phrase"], more).alias("phrase"), "n")


def _runs_within(phrase: Column, words: Column, shortest: Column, longest: Column) -> Column:
    """All runs of ``shortest`` to ``longest`` words of a phrase of ``words`` words."""
    split = F.split(phrase, " ")
    of = lambda m: F.transform(F.sequence(F.lit(1), words - m + 1), lambda k: F.array_join(F.slice(split, k, m), " "))
    return F.flatten(F.transform(F.sequence(shortest, longest), of))


def candidates(counts: DataFrame, compacted: DataFrame, options: CollocationOptions = CollocationOptions()) -> DataFrame:
    """(lang, words, phrase, a): the phrases of two words or more, without those that lie mostly in one longer phrase."""
    longest = F.lit(options.longest)
    edges = compacted.select("lang", longest.alias("words"), F.explode(_runs_within(F.col("phrase"), F.size(F.split("phrase", " ")), longest, longest)).alias("phrase"), F.col("n").alias("a"))
    phrases = counts.where(F.col("words").between(2, options.longest - 1)).select("lang", "words", "phrase", F.col("n").alias("a")).unionByName(edges)
    phrases = materialise(phrases, "phrases")
    inner = phrases.where("words > 2").select("lang", F.explode(_runs_within(F.col("phrase"), F.col("words"), F.lit(2), F.col("words") - 1)).alias("phrase"), "a")
    covering = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    mostly = F.expr(f"100 * CAST(longer AS DECIMAL(20)) >= {options.absorbed} * CAST(a AS DECIMAL(20))")
    return phrases.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~mostly).select("lang", "words", "phrase", "a")


def scored(found: DataFrame, counts: DataFrame, options: CollocationOptions = CollocationOptions()) -> DataFrame:
    """``found`` with l, r and score: floor(scale * a / (l + r)) of the cut in two for which it is lowest, the first of equal ones.

    ``l`` and ``r`` count the parts before and behind the cut.
    """
    split, whole = F.split("phrase", " "), F.col("words")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), whole - 1)).alias("cut")).select(
        "*", F.array_join(F.slice(split, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(split, F.col("cut") + 1, whole), " ").alias("rest")
    )
    parts = counts.where(F.col("words").between(1, options.longest - 1))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = attach(cuts, parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", name], ["phrase"], ScanOptions())
    score = F.expr(f"({options.scale} * CAST(a AS DECIMAL(20))) div (CAST(l AS DECIMAL(20)) + r)")
    lowest = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "words", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, options: CollocationOptions = CollocationOptions()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (lang, text).

    Highest score first, then highest count, then the phrase in the order of its
    bytes; ``rank`` counts from 1, ``n`` are all words of the language. Rows are
    taken as in ``phrase_counts``. A language without a phrase has no row.
    """
    counts = phrase_counts(docs, options)
    found = scored(candidates(counts, materialise(paths(counts, options), "paths"), options), counts, options)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top)
    totals = counts.where("words = 0").select("lang", "n")
    return attach(best, totals, ["lang"], ["phrase"], ScanOptions()).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
