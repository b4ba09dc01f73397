"""Collocations against plain counting of every phrase, and the graph's own rules."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from leakscan.llm import collocations
from tests.llm.helpers import ODD, documents

SMALL = collocations.CollocationOptions(least=3, top=40, segment_words=200, bucket_bytes=2000, path_edges=5, batch_bytes=500)


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def brute_counts(rows, longest):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                found.update((lang or "und", " ".join(words[k : k + m])) for k in range(len(words) - m + 1))
    return found, totals


def brute(rows, options):
    found, totals = brute_counts(rows, options.longest)
    often = {k: n for k, n in found.items() if n >= options.least}
    out = {}
    for (lang, phrase), a in often.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        longer = [n for (other, p), n in often.items() if other == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} "]
        if any(100 * n >= options.absorbed * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = found[lang, " ".join(w[:k])], found[lang, " ".join(w[k:])]
            cuts.append((options.scale * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, l, r, totals[lang], score))
    return sorted((lang, k + 1, *row[3:]) for lang, listed in out.items() for k, row in enumerate(sorted(listed)[: options.top]))


def texts(seed, count):
    """Text in which words, pairs and whole passages recur, with rings and hot words."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "漢", "x", "rare", *[f"w{k}" for k in range(25)]]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(count):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(rng.choice(["new york city", "rock and roll", "in spite of", "a", "the the the the the", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))]))
        if k % 9 == 0:
            parts.append(passage)
        if k % 7 == 0:
            parts.append("r1 r2 r3 " * 4 + "r1 r2 r3")
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([" ", ". ", "\n", "  \t", " ; "]).join(parts)))
    return rows


def table(spark, rows):
    docs = documents(spark, [(k, t) for k, (_, t) in enumerate(rows)], phrase="clash", bucket=1, a=2)
    langs = spark.createDataFrame([(k, lang) for k, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return docs.join(langs, "doc_id")


ROWS = [*texts(1, 90), *[(None, t) for _, t in ODD if len(t or "") < 2000], ("de", "x"), ("en", "The! " * 40)]


@pytest.mark.parametrize("broadcast,bits", [(2_000_000, 1 << 26), (0, 1 << 5)])
def test_report_against_brute_force(spark, broadcast, bits):
    """Also where steps are shuffled, and where the filter lets all runs pass."""
    options = collocations.CollocationOptions(**{**vars(SMALL), "broadcast_runs": broadcast, "filter_bits": bits})
    found = collocations.collocations(table(spark, ROWS), options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(ROWS, options)


def test_counts_paths_and_rows(spark):
    counts = collocations.phrase_counts(table(spark, ROWS), SMALL)
    expected, totals = brute_counts(ROWS, SMALL.longest)
    rows = counts.collect()
    assert {(r["lang"], r["phrase"]): r["n"] for r in rows if r["words"]} == {k: n for k, n in expected.items() if n >= SMALL.least}
    assert {r["lang"]: r["n"] for r in rows if not r["words"]} == {k: n for k, n in totals.items() if n}
    found, parts = {}, collocations.paths(counts, SMALL).collect()
    for r in parts:
        words = r["phrase"].split(" ")
        assert len(words) < SMALL.path_edges + SMALL.longest
        for k in range(len(words) - SMALL.longest + 1):
            run = (r["lang"], " ".join(words[k : k + SMALL.longest]))
            assert run not in found
            found[run] = r["n"]
    assert found == {k: n for k, n in expected.items() if n >= SMALL.least and k[1].count(" ") == SMALL.longest - 1}
    assert len(parts) < len(found)  # the passage's runs are few rows


def test_long_path_is_one(spark):
    passage = " ".join(f"p{k}" for k in range(300))
    counts = collocations.phrase_counts(table(spark, [("en", passage)] * 4), SMALL)
    parts = collocations.paths(counts, SMALL).collect()
    assert len({r["path"] for r in parts}) == 1 and {r["n"] for r in parts} == {4}
    assert sorted(r["part"] for r in parts) == list(range(60))


def test_empty_tables(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [("en", None), (None, "")])).count() == 0


def test_other_lengths(spark):
    options = collocations.CollocationOptions(**{**vars(SMALL), "longest": 5})
    rows = ROWS[:40]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), options).collect())) == brute(rows, options)


def test_query_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    table(spark, [row for row in ROWS for _ in range(11)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["op13_collocations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(entry.oracle_sql()["op13_collocations"])
    assert [d[0] for d in result.description] == found.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(result.fetchall()) and len(rows) > 50


def test_words_spelled_like_their_language(spark):
    """Such a word must not cancel out the language: runs of one language would be counted with those of another."""
    rows = [(lang, f"{lang} one two {lang} {lang} three") for lang in ("en", "de", "fr", "es", "it", "und") for _ in range(4)] + [(None, "und one two")] * 3
    found = collocations.collocations(table(spark, rows), SMALL)
    assert sorted(map(tuple, found.collect())) == brute(rows, SMALL)
