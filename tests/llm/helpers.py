"""Small tables with the cases that every operator must bear."""

import random

from pyspark.sql import functions as F

WORDS = "the of and a river stone quick brown fox jumps over lazy dog été über señor garden window silver".split()


def words(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(count))


def upper(text: str) -> str:
    """Only A-Z, as the operators see case."""
    return text.encode().upper().decode()


def documents(spark, rows, **extra):
    """(doc_id, text) rows with columns whose names clash with inner ones."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    clashing = {"fp": "x", "row": 1, "hash": 2, "doc": 3, "pos": "p", "score": 0.5, "key": "k", "length": 9, "words": "w", "n": 1, "id": 4, "kind": 5, **extra}
    return df.withColumns({k: F.lit(v) for k, v in clashing.items()}).repartition(3)


ODD = [
    (1, "One line."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "!!! ??? 123"),
    (6, words(1, 5000)),
    (7, "é" * 30000),
    (8, words(2, 120)),
    (8, words(2, 120)),
    (9, words(2, 120)),
    (10, "A b c​漢字 🙂 <|endoftext|> x"),
    (None, words(3, 40)),
    (None, None),
]
