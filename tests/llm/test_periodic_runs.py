"""Periodic runs against a search of every start and period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leakscan.llm import periodic_runs
from tests.llm.helpers import ODD, documents, words


def brute_runs(text, repeats=4, min_words=6):
    """Every stretch with its smallest period, tried one by one."""
    n, out = len(text), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and text[j] == text[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, repeats * q):
                part = text[i : i + length]
                if all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(text):
    return periodic_runs.find_runs(np.array([ord(c) for c in text], np.int64)) if text else []


@pytest.mark.parametrize("text", ["", "a", "aaaaa", "aaaaaa", "abababab", "abababa", "aabaabaabaab", "abcabcabcabcab", "a" * 300, "ab" * 100 + "c" + "ab" * 90])
def test_small_texts(text):
    assert runs_of(text) == brute_runs(text)


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 160)))
    for _ in range(rng.randrange(4)):
        part = "".join(rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 30)))
        at = rng.randrange(len(text) + 1)
        text = text[:at] + part * rng.randrange(2, 9) + part[: rng.randrange(len(part) + 1)] + text[at:]
    # A run of runs: the period has repeats of its own.
    if seed % 3 == 0:
        text = (text[: rng.randrange(1, 60)] + "aaaaaaab" * 2) * 5 + text[:40]
    assert runs_of(text) == brute_runs(text)


@pytest.mark.parametrize("min_words,repeats", [(6, 3), (40, 4), (100, 5)])
def test_other_limits(min_words, repeats):
    rng = random.Random(min_words)
    options = periodic_runs.RunOptions(min_words, repeats)
    for _ in range(40):
        text = "".join(("".join(rng.choices("abc", k=rng.randrange(1, 20))) * rng.randrange(1, 60))[: rng.randrange(10, 300)] for _ in range(3))
        expected = [r for r in brute_runs(text, repeats, 1) if r[1] >= min_words]
        assert periodic_runs.find_runs(np.array([ord(c) for c in text]), options) == expected


def test_long_texts_take_little():
    many = np.zeros(400_000, np.int64)
    assert periodic_runs.find_runs(many) == [(0, 400_000, 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 100_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic_runs.find_runs(np.frombuffer(fibonacci[-1].encode(), np.uint8).astype(np.int64)) == []


def expected_row(doc_id, text):
    """The contract, restated."""
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    names = {}
    runs = brute_runs([names.setdefault(x, len(names)) for x in w])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


ROWS = [
    *[(i, t) for i, t in ODD if len(t or "") < 2000],
    *[(100 + k, words(k, 30 + 7 * k)) for k in range(40)],
    (200, "spam  ham\n" * 30),
    (201, "x " * 50 + "y " * 20 + "x y " * 9),
    (201, "x " * 50 + "y " * 20 + "x y " * 9),
    (202, "é\x00 é\x00 é\x00 é\x00 é\x00 é\x00"),
]


def test_query_against_brute_force(spark, tmp_path):
    documents(spark, ROWS, start=1, period=2, runs=3).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["op11_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns[:8] == names
    assert [t for _, t in found.dtypes[:6]] == ["bigint"] * 6
    rows = sorted((tuple(r)[:8] for r in found.collect()), key=str)
    assert rows == sorted((expected_row(i, t) for i, t in ROWS), key=str)
    assert sum(1 for r in rows if r[1]) > 5


def test_operator_on_odd_rows(spark):
    found = {(r["doc_id"], r["collapsed"]): r for r in periodic_runs.periodic_runs(documents(spark, [*ODD, (20, "so " * 9 + "it  is")])).collect()}
    assert len(found) == len(set((i, " ".join((t or "").split())) for i, t in ODD)) + 1
    r = found[20, "so it is"]
    assert [tuple(x) for x in r["runs"]] == [(0, 9, 1)] and tuple(r["best"]) == (0, 9, 1)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0
    assert periodic_runs.plant_repeats(documents(spark, ODD)).where(F.col("doc_id").isNull()).count() == 2
