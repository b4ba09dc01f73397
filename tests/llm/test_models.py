"""Language identification, line quality and the language model: rules, probabilities and held-out accuracy."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.llm import language_id, pitman_yor, quality_crf
from leakscan.llm.common import fold
from tests.llm.helpers import ODD, documents, words

VOICES = {"aa": "ka ri to mu sen da".split(), "bb": "sch wer unt eich kraf tzu".split(), "cc": "éau oui ment tion aire eux".split()}


def voice(lang, seed, count):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(VOICES[lang], k=3)) for _ in range(count))


def spoken(spark, count=60):
    rows = [(k, voice(lang := sorted(VOICES)[k % 3], k, 3 + k % 40), lang) for k in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_fold(spark):
    found = spark.createDataFrame([(k,) for k in [0, 1, 77, None]], "doc_id long").select(fold("doc_id", 7).alias("f")).collect()
    assert [r["f"] for r in found] == [zlib.crc32(x) % 7 for x in (b"0", b"1", b"77", b"")]


def test_languages_of_unseen_texts(spark):
    docs = spoken(spark, 90)
    model = language_id.fit(docs.where("doc_id % 3 <> 1 OR doc_id < 30").unionByName(spark.createDataFrame([(500, "x", None), (501, None, "aa")], docs.schema)))
    assert model.languages == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    found = language_id.identify(docs, model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["lang_score"] <= 1 and not r["lang_ambiguous"] for r in found)


def test_odd_texts(spark):
    docs = documents(spark, ODD, lang_pred="old")
    model = language_id.fit(spoken(spark))
    found = language_id.identify(docs, model)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["lang_score"]))
    assert found.count() == len(ODD)
    for doc_id in (2, 3, 4, 5):
        assert by_id[doc_id] == {("und", 0.0)}
    assert all(p in VOICES and 0 < s <= 1 for k in (1, 6, 7, 8, 10) for p, s in by_id[k])
    assert language_id.identify(documents(spark, []), model).count() == 0
    nothing = language_id.fit(spoken(spark).limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    one = language_id.fit(spoken(spark).where("lang = 'bb'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, one).collect()} == {"und", "bb"}


def test_pieces_hold_every_trigram(monkeypatch):
    whole = np.concatenate(list(language_id.trigrams("Straße über été " * 50, 1 << 14)))
    monkeypatch.setattr(language_id, "_STEP", 7)
    assert (np.concatenate(list(language_id.trigrams("Straße über été " * 50, 1 << 14))) == whole).all()


@pytest.mark.parametrize("count", [2, 3, 5, 7, 12, 40])
def test_codewords(count):
    code = language_id.codewords(count, language_id.LanguageIdOptions())
    assert set(np.unique(code)) == {-1, 1} and (np.abs(code.sum(0)) < count).all()
    assert len(np.unique(code, axis=0)) == count


def test_decoding_takes_the_nearest_codeword_and_flags_ties():
    options = language_id.LanguageIdOptions()
    code = language_id.codewords(4, options)
    model = language_id.LanguageModel(list("wxyz"), code, np.zeros((1, code.shape[1])), np.full(code.shape, 1 / code.shape[1]), options)
    margins = code.astype(float)
    margins[2, 0] *= -1  # one wrong bit
    best, share = language_id.decode(margins, model)
    assert best.tolist() == [0, 1, 2, 3] and (share > 0.5).all()
    assert language_id.decode(np.zeros((1, code.shape[1])), model)[1][0] == pytest.approx(0.25)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    lengths, ties, first = np.array([3, 1, 4]), rng.normal(size=(2, 2)), rng.normal(size=2)
    scores = rng.normal(size=8)
    good, pairs, total, heads = quality_crf.forward_backward(scores, lengths, ties, first)
    expected, expected_pairs, expected_total, expected_heads, at = np.zeros(8), np.zeros((2, 2)), 0.0, np.zeros(2), 0
    for n in lengths:
        weights = {}
        for path in product((0, 1), repeat=int(n)):
            s = first[path[0]] + sum(scores[at + t] * y for t, y in enumerate(path)) + sum(ties[a, b] for a, b in zip(path, path[1:], strict=False))
            weights[path] = math.exp(s)
        z = sum(weights.values())
        expected_total += math.log(z)
        for path, w in weights.items():
            expected[at : at + n] += np.array(path) * w / z
            expected_heads[path[0]] += w / z
            for a, b in zip(path, path[1:], strict=False):
                expected_pairs[a, b] += w / z
        at += n
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs) and total == pytest.approx(expected_total) and np.allclose(heads, expected_heads)


def test_neighbours_stay_in_their_document():
    own = np.arange(1, 4 * quality_crf._OWN + 1, dtype=float).reshape(4, -1)
    x = quality_crf.with_neighbours(own, np.array([1, 3]))
    w = quality_crf._OWN
    assert (x[0, w : 3 * w] == 0).all() and (x[1, w : 2 * w] == 0).all() and (x[3, 2 * w : 3 * w] == 0).all()
    assert (x[2, w : 2 * w] == own[1]).all() and (x[2, 2 * w : 3 * w] == own[3]).all()


def marked(spark, count=200):
    rows = []
    for k in range(count):
        good = "\n".join(f"{words(k * 9 + j, 12).capitalize()}." for j in range(1 + k % 4))
        bad = "\n".join("*** ".join(upper.split()) + " $$$" for upper in [words(k * 9 + j, 12).upper() for j in range(1 + k % 4)])
        rows.append((k, bad if k % 5 == 0 else good))
    labels = [(k, 0 if k % 5 == 0 else 1) for k in range(count)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")


def test_quality_of_unseen_documents(spark):
    docs, labels = marked(spark)
    noise = spark.createDataFrame([(0, 1), (3, None), (4, 7), (None, 1)], "doc_id long, label int")  # contradicting, missing, unknown
    field = quality_crf.fit(docs, labels.where("doc_id < 150").unionByName(noise))
    scored = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, field).collect()}
    assert all((scored[k] >= 0.3) == (k % 5 != 0) for k in range(150, 200))
    odd = quality_crf.score(documents(spark, ODD), field).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"]) for r in odd) == sorted((i is None, i or 0, (t or "").count("\n") + 1) for i, t in ODD)
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert quality_crf.score(documents(spark, []), field).count() == 0


def test_quality_without_both_labels(spark):
    docs, labels = marked(spark, 20)
    assert quality_crf.fit(docs, labels.where("label = 1")) is None and quality_crf.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_crf.score(docs, None).collect()} == {0.5}


def test_training_sample_is_bounded(spark):
    docs, labels = marked(spark)
    options = quality_crf.QualityOptions(train_documents=40, train_lines=30, steps=5)
    assert quality_crf.fit(docs, labels, options) is not None


def test_sample_of_lines_is_bounded_and_has_both_labels(spark, monkeypatch):
    # Stored by label, with more lines than are learned from, and one text that could fill the sample alone.
    rows = [(k, "\n".join([f"line {k}"] * (5000 if k == 3 else 40)), int(k >= 30)) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    options = quality_crf.QualityOptions(train_lines=600, document_lines=100, steps=2)
    seen = []
    fit_field = quality_crf.fit_field
    monkeypatch.setattr(quality_crf, "fit_field", lambda own, lengths, marks, options: seen.append((own, lengths, marks)) or fit_field(own, lengths, marks, options))
    for stored in (docs, docs.orderBy(F.desc("doc_id")).repartition(4)):
        assert quality_crf.fit(stored, labels, options) is not None
    (own, lengths, marks), again = seen
    assert len(own) == 600 and np.bincount(marks).tolist() == [300, 300] and lengths.max() <= 100
    assert all((x == y).all() for x, y in zip(seen[0], again, strict=True))
    assert quality_crf.pieces(1000, 500, 200) == [(0, 200), (366, 566), (733, 833)] and quality_crf.pieces(5, 9, 2) == [(0, 2), (2, 4), (4, 5)]


SMALL = pitman_yor.PitmanYorOptions(classes=11, segment_bytes=2000)


def test_draw_tables_has_the_seating_distribution():
    rng = np.random.default_rng(3)
    customers, discount, weight = 6, 0.4, 0.7
    drawn = pitman_yor.draw_tables(np.full(60_000, float(customers)), discount, np.full(60_000, weight), rng, 64)
    chance = {1: 1.0}
    for n in range(1, customers):
        following = Counter()
        for t, p in chance.items():
            new = weight / (n - discount * t + weight)
            following[t + 1] += p * new
            following[t] += p * (1 - new)
        chance = following
    for t, p in chance.items():
        assert abs((drawn == t).mean() - p) < 0.01
    many = pitman_yor.draw_tables(np.full(4000, 1000.0), discount, np.full(4000, weight), rng, 64)
    exact = pitman_yor.draw_tables(np.full(4000, 1000.0), discount, np.full(4000, weight), rng, 2000)
    assert abs(many.mean() / exact.mean() - 1) < 0.03 and many.min() >= 1 and many.max() <= 1000


def test_class_probabilities_sum_to_one():
    pairs = np.random.default_rng(1).poisson(0.7, (13, 12))
    pairs[3] = 0
    table = pitman_yor.class_model(pairs, SMALL)
    assert np.allclose((10.0**table).sum(1), 1) and np.isfinite(table).all()
    assert np.allclose((10.0 ** pitman_yor.class_model(np.zeros((13, 12), int), SMALL)).sum(1), 1)


def training(spark):
    rows = [(k, voice(sorted(VOICES)[k % 3], k % 17, 30).replace("ka", "the KA")) for k in range(60)]
    return documents(spark, rows + ODD).withColumn("held_out", F.col("doc_id") % 7 == 2), rows + ODD


def test_words_and_counts(spark):
    docs, rows = training(spark)
    found = pitman_yor.score_texts(docs, SMALL).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in rows if i is None or i % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in rows:
        own = tokens(t)
        expected.append((i, i is not None and i % 7 == 2, len(own), sum(w in counts for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r["score"] < 0 for r in found)
    sums = pitman_yor.perplexity(spark.createDataFrame(found)).collect()
    assert all(r["perplexity"] < r["base_perplexity"] for r in sums)


def test_next_word_probabilities_sum_to_one(spark):
    docs, rows = training(spark)
    trained = sorted({w for i, t in rows if i is None or i % 7 != 2 for w in (t or "").encode().lower().split()})
    unseen = {}
    k = 0
    while len(unseen) < SMALL.classes:  # one unseen word of each class
        unseen.setdefault(pitman_yor.word_class(b"qqq%d" % k, SMALL), b"qqq%d" % k)
        k += 1
    probes = [(10_000 + j, f"the {w.decode()}") for j, w in enumerate([*trained, *unseen.values()])]
    probes.append((9998, "the"))
    held = spark.createDataFrame(probes, "doc_id long, text string").withColumn("held_out", F.lit(True))
    scored = pitman_yor.score_texts(docs.select("doc_id", "text", "held_out").unionByName(held), SMALL).where("doc_id > 9000").collect()
    # p(the) p(x | the) p(end | x), so p(x | the) needs p(end | x); the classes' part of it comes from texts of one word.
    assert len({r["train_tokens"] for r in scored}) == 1
    segments = pitman_yor.read_segments(docs, SMALL)
    table = pitman_yor.class_model(pitman_yor.count_pairs(segments, SMALL), SMALL).astype(np.float32)
    the, end = pitman_yor.word_class(b"the", SMALL), SMALL.classes
    score = {t: r["score"] for r in scored for i, t in probes if i == r["doc_id"]}
    end_word = score["the"] - table[end + 1, the] - table[the, end]  # log p(the | its class) + log p(end mark | its class)
    total = 0.0
    for _, text in probes:
        if text == "the":
            continue
        word = text.split()[1].encode()
        kind = pitman_yor.word_class(word, SMALL)
        inner = score[text] - table[end + 1, the] - end_word - table[the, kind] - table[kind, end]
        total += 10 ** (inner + table[the, kind])
    only_end = 10 ** table[the, end]
    assert total + only_end == pytest.approx(1, abs=0.02)


def test_no_training_rows(spark):
    docs = documents(spark, ODD).withColumn("held_out", F.lit(True))
    found = pitman_yor.score_texts(docs, SMALL).collect()
    assert len(found) == len(ODD) and {r["train_tokens"] for r in found} == {0} and {r["n_known"] for r in found} == {0}
    assert all(np.isfinite(r["score"]) and r["base_score"] == 0 for r in found)
    assert pitman_yor.score_texts(documents(spark, []).withColumn("held_out", F.lit(None).cast("boolean")), SMALL).count() == 0


def test_suffix_classes_agree(spark):
    docs, _ = training(spark)
    segments = pitman_yor.read_segments(docs, SMALL)
    for r in segments.collect():
        assert [pitman_yor.word_class(bytes(w), SMALL) for w in r["words"]] == np.frombuffer(r["classes"], "<u2").tolist()


def test_workers_return_memory(spark, monkeypatch):
    """Every step that reads words or segments in Python returns what it has freed at a task's end."""
    wrapped = []
    monkeypatch.setattr(pitman_yor, "giving_back", lambda run: wrapped.append(run.__qualname__.split(".")[0]) or run)
    docs, _ = training(spark)
    assert pitman_yor.score_texts(docs, SMALL).count() == docs.count()
    assert set(wrapped) == {"read_segments", "count_pairs", "_seat", "score_texts"}
