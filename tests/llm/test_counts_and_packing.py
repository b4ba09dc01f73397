"""Token counts against the library, packing against its rules."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leakscan.llm import packing, token_count
from tests.llm.helpers import ODD, documents, words

BYTES = token_count.TokenCountOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
PACK = packing.PackingOptions(public_tokenizers.path("word_bpe_49k.json"))
TRICKY = [
    "", " ", "  ", "a  b\n\n c\t d\n", "x<|endoftext|>y <|endoftext|><|endoftext|>  z <|startoftext|>", "don't you'll 'S  it's", "\x85a \x1fb \x1c",
    "a﻿b 　c", "1234 5 ½ ², 漢字 かな", "a" * 3000, " \n x", "x   \n   y", " é  É", "éf ΣΑΣ İstanbul", "ÀÉ,Œuvre-œ!! (ß) ×÷ naïve12", "the|the #%$ 'tis",
]


@pytest.mark.parametrize("cached", [600_000, 3])
def test_counter_equals_library(cached):
    library = Tokenizer.from_file(BYTES.tokenizer)
    counter = token_count.TokenCounter(token_count.TokenCountOptions(BYTES.tokenizer, BYTES.pattern, cached))
    for text in [*TRICKY, words(5, 300)]:
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text[:40]


@pytest.mark.parametrize("cached", [600_000, 3])
def test_encoder_equals_library(cached):
    library = Tokenizer.from_file(PACK.tokenizer)
    encoder = packing.WordEncoder(PACK.tokenizer, cached)
    for text in [*TRICKY, words(5, 300), "́x ̈ y"]:
        assert encoder.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:40]


def test_letters_and_signs_are_two_parts(monkeypatch, tmp_path):
    encoder = packing.WordEncoder(PACK.tokenizer, 300_000)
    library = Tokenizer.from_file(PACK.tokenizer)
    monkeypatch.setattr(packing, "_PART", None)  # the general way to part a word
    for word in ["theser$$$", "The.***", "A", "z`{|}~", "Word!\"#%&()*+,-./:;<=>?@[\\]^_", "x<|"]:
        assert encoder.encode(word.encode()) == np.array(library.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word
    monkeypatch.undo()
    library.add_special_tokens(["er$$", "the"])  # such a token may hide in a word
    library.save(str(tmp_path / "special.json"))
    encoder = packing.WordEncoder(str(tmp_path / "special.json"), 300_000)
    for text in ["theser$$$ er$$ the", "other"]:
        assert encoder.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_long_words_are_not_remembered():
    text = " ".join(chr(97 + k) * 5000 for k in range(20)).encode()
    counter, encoder = token_count.TokenCounter(BYTES), packing.WordEncoder(PACK.tokenizer, 300_000)
    counter.count(text)
    encoder.encode(text)
    for held in (counter, counter._parts, encoder, encoder._parts):
        assert sum(map(len, held)) < 200


def test_count_tokens(spark):
    library = Tokenizer.from_file(BYTES.tokenizer)
    found = token_count.count_tokens(documents(spark, ODD), BYTES)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert token_count.count_tokens(documents(spark, []), BYTES).count() == 0


def test_merge_table_refuses_other_kinds():
    with pytest.raises(ValueError):
        token_count.MergeTable(PACK.tokenizer)


def check_packing(rows, texts, length):
    """Gapless sequences within the limit; the pieces of each text put together are its ids."""
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    library = Tokenizer.from_file(PACK.tokenizer)
    expected = []
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(doc_id, k, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for k, s in enumerate(range(0, len(ids), length))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(expected, key=str)
    return len(fill), -(-sum(r["length"] for r in rows) // length)


def test_pack_documents(spark):
    rows = packing.pack_documents(documents(spark, ODD), PACK).collect()
    check_packing(rows, ODD, 2048)
    assert packing.pack_documents(documents(spark, []), PACK).count() == 0


def best_fit_decreasing(lengths, size):
    fills = []
    for s in sorted(lengths, reverse=True):
        if fitting := [(f, k) for k, f in enumerate(fills) if f + s <= size]:
            fills[max(fitting)[1]] += s
        else:
            fills.append(s)
    return len(fills)


@pytest.mark.parametrize("group,apart", [(100, 3), (100_000, 0)])
def test_as_few_sequences_as_best_fit_finds(spark, group, apart):
    """At most one more for each group that is packed apart."""
    texts = [(k, words(k, 5 + k * 37 % 90)) for k in range(200)]
    options = packing.PackingOptions(PACK.tokenizer, length=256, group_pieces=group)
    rows = packing.pack_documents(documents(spark, texts), options).collect()
    used, _ = check_packing(rows, texts, 256)
    assert used <= best_fit_decreasing([r["length"] for r in rows], 256) + apart


def brute_sum_of_squares(lengths, size):
    bins, out = [], []
    for s in lengths:
        def total(fills):
            counts = defaultdict(int)
            for f in fills:
                if f < size:
                    counts[size - f] += 1
            return sum(c * c for c in counts.values())

        options = [(total([f + s if k == j else f for k, f in enumerate(bins)]), size - bins[j], j) for j in range(len(bins)) if bins[j] + s <= size]
        best = min(options, default=None)
        if best:
            gap = best[1]
            j = max(k for k, f in enumerate(bins) if size - f == gap)
        else:
            bins.append(0)
            j = len(bins) - 1
        out.append((bins[j], s))
        bins[j] += s
    return bins, out


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, 60)
    sequence, offset = packing.sum_of_squares(lengths, 20)
    fills = np.zeros(sequence.max() + 1, int)
    np.add.at(fills, sequence, lengths)
    bins, placed = brute_sum_of_squares(lengths.tolist(), 20)
    assert sorted(fills) == sorted(bins)
    assert list(zip(offset.tolist(), lengths.tolist(), strict=True)) == placed


def test_workers_forget_words_after_a_task(spark):
    def words_kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e) + len(e._parts) for e in packing._encoders.values())])], ["kept"])

    options = packing.PackingOptions(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack_documents(documents(spark, [(k, words(k, 300)) for k in range(40)]), options).count() >= 40
    assert [r["kept"] for r in spark.range(0, 40, 1, 8).mapInArrow(words_kept, "kept long").where("kept > 0").collect()] == []
