"""Benchmark windows against brute force."""

import ctypes
import os
import random
import re

import pyarrow as pa
import pytest

from leakscan.llm import decontamination as dc
from leakscan.llm.common import giving_back
from tests.llm.helpers import ODD, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    phrases = {}
    for item_id, text in items:
        w = own_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).update([] if item_id is None else [str(item_id)])
    out = []
    for doc_id, text in docs:
        w, hit, found = own_words(text), set(), set()
        for phrase, ids in phrases.items():
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "'x' AS spans")


def case(seed):
    rng = random.Random(seed)
    vocabulary = "a b c d é1 Zeit".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 14])))) for k in range(12)]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(30)]
    docs += [(100 + k, f"{words(k, 30)} {t.upper() if k % 2 else t}... {words(k + 50, 20)}") for k, (_, t) in enumerate(items)]
    return docs, items


ITEMS = [(1, words(1, 25)), (2, None), (3, ""), (4, "One; LINE"), (None, words(2, 12)), (5, words(6, 30)), (5, words(1, 12)), (6, "..."), (1, words(1, 25))]


@pytest.mark.parametrize("docs,items", [case(1), case(2), (ODD, ITEMS), (ODD, []), ([], ITEMS), ([(1, "x y")], [(2, "y"), (10, "x")])])
@pytest.mark.parametrize("block", [2 << 20, 60])
def test_equals_brute_force(spark, docs, items, block):
    options = dc.DecontaminationOptions(segment_bytes=500, block_bytes=block)
    found = dc.find_benchmark(documents(spark, docs), benchmark(spark, items), options)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str) == brute(docs, items)


def test_spans_are_the_hit_words(spark):
    text = f"{words(3, 7)} {words(1, 25)} x {words(1, 25)}"
    (row,) = dc.find_benchmark(documents(spark, [(1, text)]), benchmark(spark, [(1, words(1, 25))])).collect()
    assert [(s["begin"], s["end"]) for s in row["spans"]] == [(7, 32), (33, 58)] and row["n_hit"] == 50


def test_proximity(spark):
    docs = [(1, "a x b y c"), (2, "a b c"), (3, "c b a"), (4, "a x x x x b c"), (5, "a b"), (6, "c")]
    phrases = dc.phrases_of([("p", b"a b c")], 10)
    index = dc.build_index(documents(spark, docs).selectExpr("0L AS row", "doc_id", "text"), frozenset([b"a", b"b", b"c"]), dc.DecontaminationOptions())
    found = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in dc.search(index, phrases, slop=2).collect()}
    assert found == {1: [(0, 5)], 2: [(0, 3)], 3: [], 4: [], 5: [], 6: []}


def test_rarest_term_leads(spark):
    docs = documents(spark, [(1, "a a a a b b c")])
    phrases = dc.phrases_of([("p", b"a b c")], 10)
    index = dc.build_index(docs.selectExpr("0L AS row", "doc_id", "text"), frozenset([b"a", b"b", b"c"]), dc.DecontaminationOptions())
    dc.rank_terms(index, phrases)
    assert phrases[0].rarest == [2, 1, 0]


def test_drop_contaminated(spark):
    docs = documents(spark, ODD)
    kept = dc.drop_contaminated(docs, benchmark(spark, [(1, words(2, 120)), (2, words(3, 40))]))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([i for i, _ in ODD if i not in (8, 9)], key=str)


def test_equal_items_are_sent_once(spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, words(1, 30))] * 500 + [(k, words(k, 30)) for k in range(2, 12)] + [(None, words(1, 30))] * 3, "item_id long, text string")
    docs = documents(spark, [(k, f"{words(50 + k, 20)} {words(k, 30)}") for k in range(1, 4)])
    sent, phrases_of = [], dc.phrases_of
    monkeypatch.setattr(dc, "phrases_of", lambda items, window: sent.append(len(items)) or phrases_of(items, window))
    found = dc.find_benchmark(docs, benchmark, dc.DecontaminationOptions(block_bytes=1000)).collect()
    assert sum(sent) == 12 and 1 < len(sent) < 12
    assert {(r["doc_id"], tuple(r["items"]), r["n_hit"]) for r in found} == {(k, (str(k),), 30) for k in range(1, 4)}


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="memory is returned by malloc_trim")
def test_workers_give_memory_back():
    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run(batches):
        # Blocks of the heap below one that is kept, as a task's results lie above what it has freed.
        blocks = [bytes([1]) * 60_000 for _ in range(4000)]
        kept.append(bytes([2]) * 60_000)
        blocks.clear()
        held.append(resident())
        yield from batches

    kept, held = [], []
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(giving_back(run)(iter([batch, batch]))) == [batch, batch]
    assert resident() < held[0] - 150
