"""Near copies, components, fingerprints and repeated passages against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from leakscan.llm import components, fingerprints, simhash_dedup, substring_dedup
from tests.llm.helpers import ODD, documents, upper, words


def union(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(random.Random(3).randrange(90), k) for k in range(90)]])
def test_components(spark, edges):
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    expected = union({n for e in edges for n in e}, edges)
    assert {tuple(r) for r in found.collect()} == {(n, r) for n, r in expected.items() if n != r}


def brute_fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(spark):
    found = simhash_dedup.fingerprints(documents(spark, ODD)).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64)) for r in found), key=str) == sorted(((i, brute_fingerprint(t)) for i, t in ODD), key=str)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b ç') AS h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_majority_counts_beyond_a_lane():
    hashes = np.concatenate([np.full(70000, 0x8000000000000001, np.uint64), np.full(69999, 0x0F, np.uint64)])
    assert simhash_dedup.majority(hashes) == 0x8000000000000001


def test_anchors_cover():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 31, 200)
    rows, anchors = simhash_dedup.anchors_within_two(values)
    assert (simhash_dedup.syndromes(anchors) == 0).all()
    home = anchors[:200]
    assert (np.bitwise_count(home ^ values) <= 1).all()
    sent = {(r, a) for r, a in zip(rows.tolist(), anchors.tolist(), strict=True)}
    assert len(sent) == len(rows)
    for bit in range(31):  # a neighbour's home is among them
        near = values ^ (1 << bit)
        for k, anchor in enumerate(simhash_dedup.anchors_within_two(near)[1][:200].tolist()):
            assert (k, anchor) in sent


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, 1 << 63}
    for v in list(values)[:40]:
        for flips in (1, 2, 2, 3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    classes = spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp long, rep long")
    found = [tuple(sorted(r)) for r in simhash_dedup.links(classes).collect()]
    expected = {(a, b) for (a, x), (b, y) in combinations(enumerate(signed), 2) if ((x ^ y) % (1 << 64)).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == expected
    with pytest.raises(ValueError):
        simhash_dedup.links(classes, 3)


def near_copies():
    base = words(9, 400).split()
    out = [(k, words(k, 60)) for k in range(20, 30)]
    for k in range(40):
        own = list(base)
        own[k * 7 % 400] = f"changed{k}"
        out.append((100 + k, " ".join(own)))
    return out + [(90, " ".join(base)), (91, upper(" ".join(base)))]


@pytest.mark.parametrize("rows", [ODD, near_copies(), [(None, "a b"), (None, "a b c d"), (None, "")], []])
def test_near_duplicates_equal_brute_force(spark, rows):
    found = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = union(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    ids = {}
    for k, g in group.items():
        ids.setdefault(g, []).extend([rows[k][0]] if rows[k][0] is not None else [])
    expected = [(rows[k][0], prints[k], min(ids[g], default=None)) for k, g in group.items()]
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=str) == sorted(expected, key=str)


def test_keep_one(spark):
    kept = simhash_dedup.keep_one(documents(spark, ODD + near_copies()))
    assert kept.columns == documents(spark, []).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(8) == 1 and 9 not in ids and 2 in ids and 3 not in ids and 91 not in ids and set(range(20, 30)) <= set(ids)


def test_keep_one_of_rows_that_share_an_id(spark):
    one, other = words(9100, 90), words(9101, 90)
    rows = [(5, one), (5, other), (5, one), (6, other), (7, words(9102, 90)), (None, one)]
    docs = documents(spark, rows, _nth=1, key_="x")
    kept = simhash_dedup.keep_one(docs, broadcast_ids=0)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, one), (5, other), rows[4], (None, one)], key=str)


def test_edited_fingerprints(spark):
    rows = [(k, t) for k, t in ODD if k is not None and k != 8] + [(40, words(4, 200)), (41, words(4, 200)), (12345678901, "last one of all here")]
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents(spark, rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    assert sorted(found) == ids
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, quarter = texts[i], len(texts[i]) // 4
        edited = text[: len(text) - quarter] + texts[after][:quarter]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["next_fp"] == found[after]["fp"]
        if edited == text:
            assert found[i]["fp"] == found[i]["edited_fp"]
    assert found[40]["fp"] == found[41]["fp"] and found[2]["fp"] == found[3]["fp"] == 0
    assert fingerprints.edited_fingerprints(documents(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(documents(spark, ODD)).count() == len(ODD)


def test_simhash_votes(spark):
    text = "One two three four five one two three"
    own = text.lower().split()
    rows = [(own[k], *(own[k + j] if k + j < len(own) else None for j in (1, 2))) for k in range(len(own))]
    hashes = spark.createDataFrame(rows, "a string, b string, c string").selectExpr("xxhash64(a, b, c) AS h", "octet_length(a) + coalesce(octet_length(b), 0) + coalesce(octet_length(c), 0) AS w").collect()
    total = sum(r["w"] for r in hashes)
    expected = sum(1 << b for b in range(64) if 2 * sum(r["w"] for r in hashes if r["h"] >> b & 1) > total)
    got = fingerprints.simhash(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()["fp"]
    assert got % (1 << 64) == expected


@pytest.mark.parametrize("radius,blocks", [(3, 6), (2, 4), (0, 1)])
def test_near_fingerprints_equal_brute_force(spark, radius, blocks):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    for v in list(values):
        values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in [*signed, *signed, None]], "fp long")
    found = [tuple(r) for r in fingerprints.near_fingerprints(prints, radius, blocks).collect()]
    expected = {(min(x, y), max(x, y), ((x ^ y) % (1 << 64)).bit_count()) for x, y in combinations(signed, 2)}
    assert len(found) == len(set(found)) and set(found) == {e for e in expected if e[2] <= radius}


def test_no_python_in_fingerprints(spark):
    plan = fingerprints.simhash(documents(spark, ODD), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def passages_of(spark, rows, **options):
    found = substring_dedup.repeated_passages(documents(spark, rows), substring_dedup.PassageOptions(**options))
    return [r.asDict() for r in found.collect()]


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r["a"], set()).update(range(r["begin_a"], r["end_a"]))
        out.setdefault(r["b"], set()).update(range(r["begin_b"], r["end_b"]))
    return out


def planted(count=12):
    passage = words(77, 60)
    rows = [(k, f"{words(200 + k, 70)} {upper(passage) if k % 2 else passage} {words(300 + k, 50)}") for k in range(count)]
    return rows, passage


def test_planted_passages_are_found(spark):
    rows, _ = planted()
    clean = [(100 + k, words(500 + k, 300)) for k in range(10)]
    found = covered(passages_of(spark, rows + clean))
    assert set(found) == set(range(12))
    for k in range(12):
        assert set(range(70, 130)) <= found[k] and len(found[k]) < 80


def test_fuzzy_passages_are_found(spark):
    passage = words(78, 100).split()
    other = list(passage)
    other[30], other[61:63], other[80:80] = "changed", [], ["put", "in"]
    rows = [(1, f"{words(1, 90)} {' '.join(passage)} {words(2, 30)}"), (2, f"{words(3, 20)} {' '.join(other)} {words(4, 80)}")]
    (found,) = passages_of(spark, rows)
    assert (found["a"], found["b"]) == (1, 2) and found["identity"] >= 0.9
    assert found["begin_a"] <= 90 and found["end_a"] >= 190 and found["begin_b"] <= 20 and found["end_b"] >= 120


def test_short_and_loose_matches_are_left_alone(spark):
    short, loose = words(79, 45), words(80, 100).split()
    broken = [w if k % 3 else f"x{k}" for k, w in enumerate(loose)]
    rows = [(1, f"{words(1, 50)} {short}"), (2, f"{short} {words(2, 50)}"), (3, " ".join(loose)), (4, " ".join(broken))]
    assert passages_of(spark, rows) == []


def test_odd_rows(spark):
    found = passages_of(spark, ODD)
    assert {(r["a"], r["b"]) for r in found} == {(8, 9)} and found[0]["end_b"] == 120 and found[0]["identity"] == 1
    assert passages_of(spark, []) == []


def test_groups(spark):
    rows, _ = planted(5)
    found = substring_dedup.grouped_passages(substring_dedup.repeated_passages(documents(spark, rows + [(50, words(1, 80)), (51, words(1, 80))])))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["group_id"], set()).update({r["a"], r["b"]})
    assert groups == {0: {0, 1, 2, 3, 4}, 50: {50, 51}}


def test_every_exact_repeat_is_covered(spark):
    rng = random.Random(4)
    parts = [words(1000 + k, rng.randrange(50, 90)) for k in range(6)]
    rows = [(k, " ".join(f"{words(2000 + 10 * k + j, rng.randrange(5, 60))} {rng.choice(parts)}" for j in range(3))) for k in range(30)]
    found = covered(passages_of(spark, rows))
    own = {k: t.split() for k, t in rows}
    where = {}
    for k, w in own.items():
        for p in range(len(w) - 49):
            where.setdefault(tuple(w[p : p + 50]), []).append((k, p))
    need, missed = 0, 0
    for places in where.values():
        if len({k for k, _ in places}) > 1:
            for k, p in places:
                need += 50
                missed += len(set(range(p, p + 50)) - found.get(k, set()))
    assert need and missed <= 0.02 * need


def missed_windows(rows, found):
    """Words of windows of 50 that two documents have, and that no passage covers."""
    own = {k: t.split() for k, t in rows}
    where = {}
    for k, w in own.items():
        for p in range(len(w) - 49):
            where.setdefault(tuple(w[p : p + 50]), []).append((k, p))
    shared = [x for x in where.values() if len({k for k, _ in x}) > 1]
    assert shared
    return sum(len(set(range(p, p + 50)) - found.get(k, set())) for x in shared for k, p in x)


def test_repeats_of_lines_that_stand_elsewhere_are_found(spark):
    lines = [words(906 + k, 25) for k in range(3)]  # no seed spans two of them
    rows = [(k, f"{words(600 + k, 40)} {lines[k % 3]} {words(700 + k, 40)}") for k in (0, 1, 2, 30, 31, 32)]
    rows += [(k, f"{words(800 + k, 30)} {' '.join(lines)} {words(820 + k, 30)}") for k in (10, 11, 12, 13)]
    found = passages_of(spark, rows)
    assert missed_windows(rows, covered(found)) == 0
    edges = [(r["a"], r["b"]) for r in found]
    assert set(union({10, 11, 12, 13}, edges).values()) == {10}


def test_no_window_is_missed_among_shuffled_lines(spark):
    rng = random.Random(12)
    lines = [words(1500 + k, rng.randrange(8, 30)) for k in range(12)]
    rows = [(k, " ".join(rng.choice(lines) for _ in range(12))) for k in range(40)]
    assert missed_windows(rows, covered(passages_of(spark, rows))) == 0


def changed(passage, identity, seed):
    """``passage`` with other words in some places, not at its ends; every so manyth if ``seed`` is None."""
    own = passage.split()
    step, count = round(1 / (1 - identity)), round(len(own) * (1 - identity))
    for k in range(step - 1, len(own) - 1, step) if seed is None else random.Random(seed).sample(range(1, len(own) - 1), count):
        own[k] = f"other{k}"
    return " ".join(own)


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9])
def test_recall_of_changed_passages(spark, identity):
    rows, planted = [], {}
    for k in range(60):
        passage = words(5000 + k, 50 + k % 3 * 25)
        rows.append((k, f"{words(6000 + k, 60)} {passage} {words(6100 + k, 60)}"))
        rows.append((100 + k, f"{words(6200 + k, 30)} {changed(passage, identity, k or None)} {words(6300 + k, 30)}"))
        planted[k] = range(60, 60 + len(passage.split()))
    # By construction an alignment of every pair has 50 words or more at this identity.
    found = passages_of(spark, rows)
    assert {(r["a"], r["b"]) for r in found} <= {(k, 100 + k) for k in range(60)} and all(r["identity"] >= 0.8 - 1e-9 for r in found)
    got = covered(found)
    assert 0 in got and sum(k in got for k in planted) >= 0.95 * len(planted)
    assert sum(len(set(p) & got.get(k, set())) for k, p in planted.items()) >= 0.85 * sum(map(len, planted.values()))


@pytest.mark.parametrize("size,step", [(100, 10), (60, 6)])
def test_changed_passages_whose_seeds_stand_elsewhere(spark, size, step):
    """Each equal stretch is in a document before and one behind the two that share the passage."""
    rows, pairs = [], 40
    for k in range(pairs):
        own = words(7000 + k, size).split()
        other = [f"other{j}" if j % step == step - 1 else w for j, w in enumerate(own)]
        rows.append((1000 + k, f"{words(7100 + k, 60)} {' '.join(own)} {words(7200 + k, 60)}"))
        rows.append((2000 + k, f"{words(7300 + k, 30)} {' '.join(other)} {words(7400 + k, 30)}"))
        for j in range(0, size, step):
            stretch = " ".join(own[j : j + step - 1])
            rows += [(n + k * 20 + j // step, f"{words(n + 9000 + 20 * k + j // step, 30)} {stretch} {words(n + 20 * k + j // step, 30)}") for n in (10_000, -20_000)]
    found = {(r["a"], r["b"]) for r in passages_of(spark, rows)}
    assert sum((1000 + k, 2000 + k) in found for k in range(pairs)) >= 0.9 * pairs


def test_a_family_of_changed_copies(spark):
    passage = words(7500, 100)
    rows = [(k, f"{words(7600 + k, 40)} {changed(passage, 0.9, k + 1)} {words(7700 + k, 40)}") for k in range(30)]
    found = passages_of(spark, rows)
    assert set(union(set(range(30)), [(r["a"], r["b"]) for r in found]).values()) == {0}
    got = covered([{**r, "a": -1} for r in found])
    assert sum(len(set(range(42, 138)) & got.get(k, set())) for k in range(1, 30)) >= 0.9 * 29 * 96


@pytest.mark.parametrize("seed", range(30))
def test_covering(seed):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 60, rng.integers(1, 25))
    high = low + rng.integers(1, 20, len(low))
    kept = substring_dedup.covering(low, high)
    whole = lambda ks: {x for k in ks for x in range(low[k], high[k])}
    assert whole(kept) == whole(range(len(low))) and len(set(kept)) == len(kept)
    assert all(sum(low[k] <= x < high[k] for k in kept) <= 2 for x in whole(kept))


def test_texts_that_repeat_themselves(spark):
    line = words(7950, 9)
    rows = [(1, " ".join([line] * 60)), (2, f"{words(7951, 30)} {' '.join([line] * 90)} {words(7952, 30)}")]
    found = passages_of(spark, rows)
    assert missed_windows(rows, covered(found)) == 0 and len(found) < 60


def test_closest_partners():
    options = substring_dedup.PassageOptions(partners=2, stretch=10)
    rows = [(1, 9, 3, 4), (2, 9, 3, 4), (2, 9, 5, 4), (3, 9, 3, 4), (3, 9, 4, 4), (3, 9, 5, 4), (4, 9, 7, 50), (1, 9, 12, 4), (5, 9, 13, 4), (6, 9, 14, 4), (7, 8, 1, 4)]
    a, b, at, words = (np.array(c) for c in zip(*sorted(rows, key=lambda r: (r[1], r[0])), strict=True))
    kept = substring_dedup.closest(a, b, at, words, options)
    assert sorted(set(a[kept].tolist())) == [1, 2, 3, 4, 5, 7]


def test_every_linked_document_is_a_partner(spark):
    passage = words(7960, 64).split()
    changed = [" ".join(f"c{k}x{i}" if i % 8 == k % 8 else w for i, w in enumerate(passage)) for k in range(20)]
    rows = [(k, f"{words(7970 + k, 40)} {text} {words(8000 + k, 30)}") for k, text in enumerate(changed)]
    rows.append((100, f"{words(8050, 64)} {' '.join(passage)} {words(8051, 30)}"))
    assert {r["a"] for r in passages_of(spark, rows) if r["b"] == 100} == set(range(20))
    assert len({r["a"] for r in passages_of(spark, rows, partners=4) if r["b"] == 100}) < 20


def test_equal_texts_are_paired_with_the_first(spark):
    text = words(7800, 200)
    rows = [(k, text) for k in range(40)] + [(100, f"{words(1, 20)} {text[:900]}"), (101, words(2, 30)), (102, words(2, 30))]
    found = passages_of(spark, rows)
    assert sorted((r["a"], r["b"], r["end_b"]) for r in found if r["b"] < 100) == [(0, k, 200) for k in range(1, 40)]
    assert {(r["a"], r["b"]) for r in found if r["b"] >= 100} == {(0, 100)}


def test_rows_that_share_an_id_keep_their_own_words(spark):
    passage, clean = words(7900, 80), words(7901, 200)
    rows = [(1, f"{words(7902, 30)} {passage}"), (5, f"{passage} {words(7903, 60)}"), (5, clean), (5, clean), (6, words(7904, 90))]
    assert {(r["a"], r["b"]) for r in passages_of(spark, rows)} == {(1, 5)}
    cut = [(r["doc_id"], r["text"]) for r in substring_dedup.cut_repeats(documents(spark, rows, spans="x", _spans=1, b=2, a=3)).collect()]
    assert sorted(cut) == sorted([rows[0], (5, words(7903, 60)), (5, clean), rows[4]])


def test_packed_numbers_come_back():
    import pyarrow as pa

    arrays = [np.array([0, 1, 1 << 31], "<u4"), np.array([-5, 0, 1 << 40], "<i8"), np.array([7, 8, 9], "<u4")]
    back = substring_dedup._unplaned(pa.py_buffer(substring_dedup._planes(arrays)), ("<u4", "<i8", "<u4"))
    assert all((x == y).all() for x, y in zip(arrays, back, strict=True))


def test_linked_equals_brute_force():
    rng = random.Random(5)
    rows = sorted((rng.randrange(30), rng.randrange(25), p) for p in range(400))
    keys, docs, places = (np.array(c) for c in zip(*rows, strict=True))
    options = substring_dedup.PassageOptions(all_pairs=12)
    found = {t for some in substring_dedup.linked(keys, docs, places, options) for t in zip(*(x.tolist() for x in some), strict=True)}
    expected = set()
    for key in set(keys.tolist()):
        first = {}
        for _, d, p in (own := [r for r in rows if r[0] == key]):
            first.setdefault(d, p)
        others = set(first) if len(first) <= 12 else {min(first), max(first)}
        for _, d, p in own:
            expected |= {(min(d, e), max(d, e), *((p, first[e]) if d < e else (first[e], p))) for e in others if e != d}
    assert found == expected


def test_chain_prefers_the_collinear():
    options = substring_dedup.PassageOptions(min_links=3)
    pa_, pb = np.array([10, 20, 30, 40, 25]), np.array([110, 120, 131, 141, 5])
    runs = substring_dedup.diagonals(pa_, pb, options)
    best = substring_dedup.chain(runs, options)[0]
    assert best[:, 0].tolist() == [10, 30] and best[:, 1].tolist() == [110, 131]


def test_cut_repeats(spark):
    rows, passage = planted(4)
    docs = documents(spark, [*rows, (20, passage), (21, None), (22, ""), (None, passage)], n_chars=7)
    cut = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs).collect()}
    assert substring_dedup.cut_repeats(docs).columns == docs.columns
    assert set(cut) == {0, 1, 2, 3, 21, 22, None}
    assert cut[0]["text"] == rows[0][1] and cut[None]["text"] == passage
    for k in (1, 2, 3):
        assert passage not in cut[k]["text"].lower() and cut[k]["text"].startswith(rows[k][1][:60]) and cut[k]["n_chars"] == len(cut[k]["text"])


def test_packed_numbers_are_small():
    rng = np.random.default_rng(2)
    low = np.diff(np.sort(rng.integers(0, 1 << 32, 50_000)).astype("<u4"), prepend=np.uint32(0))
    arrays = [low, rng.integers(5000, 6500, 50_000).astype("<i8"), rng.integers(0, 700, 50_000).astype("<u4")]
    assert len(substring_dedup._planes(arrays)) < 0.48 * sum(a.nbytes for a in arrays)


def test_shared_anchors_equal_brute_force(spark):
    from collections import defaultdict

    options = substring_dedup.PassageOptions()
    shared, rare = words(3001, 120), words(3002, 90)
    rows = [(k, f"{words(3100 + k, 30)} {shared} {words(3200 + k, 30)}") for k in range(5)]
    rows += [(10, f"{rare} {words(3300, 40)}"), (11, f"{words(3301, 60)} {rare}"), (12, f"{words(3302, 60)} " * 3), (13, "too short")]
    places = defaultdict(list)
    for doc, text in rows:
        hashes, at = substring_dedup.anchors_of(substring_dedup.codes_of(substring_dedup.words_of(text.encode())), options)
        for h, p in zip(hashes.tolist(), at.tolist(), strict=True):
            places[h].append((doc, p))
    two, more = set(), set()
    for found in places.values():
        if len({d for d, _ in found}) > 1:
            if len(found) == 2:
                (a, p), (b, q) = sorted(found)
                two.add((a, b, p, q))
            else:
                more |= {(d, None, p, None) for d, p in found}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for buckets in (1, 4):
        got = substring_dedup.shared_anchors(substring_dedup.packed_anchors(docs, buckets, options), buckets).collect()
        assert len(got) == len(two) + len(more) and {tuple(r) for r in got} == two | more
    assert two and more


@pytest.mark.parametrize("at_once", [1, 30, 1 << 16])
def test_words_of_many_texts_are_hashed_at_once(at_once):
    import zlib

    rng = random.Random(at_once)
    texts = [bytes(rng.choice(b"aAbZ \t\n\x0b\x0c\r\xc3\x1c\x85\x00") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [b"", b"  ", b"Long" * 100 + b" word", b"x" * 64, b"x" * 65]
    found = substring_dedup.codes_of_texts(texts, at_once)
    assert [c.tolist() for c in found] == [[zlib.crc32(w) for w in t.lower().split()] for t in texts]
    assert substring_dedup.codes_of_texts([], at_once) == []


@pytest.mark.parametrize("options", [{}, {"min_words": 14}, {"min_words": 3, "window": 4}])
def test_anchors_of_many_texts_equal_those_of_windows(options):
    options = substring_dedup.PassageOptions(**options)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n).astype(np.uint32) for n in [*range(60), 400, 0, 700]]
    expected = []
    for k, codes in enumerate(texts):
        runs, whole = substring_dedup.runs_of(codes, options.k), substring_dedup.runs_of(codes, substring_dedup.anchor_words(options))
        width = min(options.window, len(runs))
        at = {i + int(runs[i : i + width].argmin()) for i in range(len(runs) - width + 1) if width}
        expected += [(int(whole[i]), i, k) for i in sorted(at) if i < len(whole)]
    assert list(zip(*(x.tolist() for x in substring_dedup.anchors_of_texts(texts, options)), strict=True)) == expected


def test_links_of_many_pairs_are_merged_at_once():
    options = substring_dedup.PassageOptions()
    rng = np.random.default_rng(8)
    pair, at_a, at_b, words = np.sort(rng.integers(0, 12, 900)), rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.choice([4, 39, 50], 900, p=[0.9, 0.05, 0.05])
    own, runs = substring_dedup.merged(pair, at_a, at_b, words, options)
    expected = []
    for k in range(12):
        lines = {}
        for a, b, n in zip(at_a[pair == k].tolist(), at_b[pair == k].tolist(), words[pair == k].tolist(), strict=True):
            lines.setdefault(b - a, set()).add((a, n))
        for shift, links in lines.items():
            merged = []
            for a, n in sorted(links):
                if not merged or a > merged[-1][1] + options.window:
                    merged.append([a, a, 0])
                merged[-1][1] = max(merged[-1][1], a + n)
                merged[-1][2] += options.min_links if n >= substring_dedup.anchor_words(options) else 1
            expected += [(k, a, a + shift, end - a, count) for a, end, count in merged]
    assert [(int(k), *r) for k, r in zip(own, runs.tolist(), strict=True)] == sorted(expected)


def test_common_words_equal_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, v in enumerate(x):
            for j, w in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
        assert substring_dedup.common_words(x, y) == best[-1][-1]
