"""The batch forms of some checks against their expression forms, over random text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakscan.functions import entropy, text
from leakscan.operators import gate
from leakscan.operators.token_scores import score_lines

ALPHABETS = ["ab\x00\x01\x02\x1f\t\n é", "abcXYZ019+/=_-", "aeiouBCD_09", "x\x07é😀漢\x0e\x0b \r\n", "0123456789abcdef", "AbCdEfGhIjKlMnOp+/="]


def _strings(seed, count, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(a := rng.choice(ALPHABETS), k=rng.randrange(longest))) if n else "" for n in range(count)]


def test_binary(spark):
    texts = [*_strings(1, 400, 60), "x" * 9000 + "\x00", "\x01" * 4000 + "x" * 8000, "\x01" * 3000 + "x" * 8000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    expected = [r["b"] for r in df.orderBy("n").select(text.looks_binary(F.col("t")).alias("b")).collect()]
    assert gate._binary(pa.array(texts)).tolist() == expected
    assert True in expected and False in expected


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_entropy(spark, seed):
    rng = random.Random(seed)
    lines = [f"{rng.choice(['k = ', 'path/to/', '', 'é '])}{s}{rng.choice(['', '/x', ' y', '\"'])}" for s in _strings(seed, 600, 70)]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, t string")
    expected = [bool(r["b"]) for r in df.orderBy("n").select(entropy.has_high_entropy_token(F.col("t")).alias("b")).collect()]
    surely, doubtful = score_lines(pa.array(lines))
    for line, want, sure, doubt in zip(lines, expected, surely, doubtful, strict=True):
        assert (want or not sure) and (sure or doubt or not want), line
    assert True in expected
