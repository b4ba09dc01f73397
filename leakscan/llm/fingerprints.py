"""SimHash fingerprints of whole texts, and the search for near ones. DataFrame functions only.

The terms of a text are its runs of three words; a term's weight is its length
in bytes, so that runs of short common words count less. Each term's hash votes
with its weight for or against each of 64 bits, and a fingerprint bit is one
where the votes for it outweigh. The votes are kept two to a long in 32-bit
lanes and added up in each task, so what is shuffled is one row per text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.sources.workspace import materialise

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _votes() -> list[Column]:
    """Weight of the terms with each bit set, for bits k and k + 32 in one sum, and the weight of all terms."""
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{k}") for k in range(32)]
    return [*sums, F.sum("w").alias("all")]


def _fingerprint() -> Column:
    out = F.lit(0).cast("long")
    for k in range(32):
        low = F.when(F.col(f"s{k}").bitwiseAND(F.lit(_LOW)) * 2 > F.col("all"), F.lit(1 << k)).otherwise(F.lit(0))
        high = F.when(F.shiftrightunsigned(f"s{k}", 32) * 2 > F.col("all"), F.lit((1 << k + 32) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0))
        out = out.bitwiseOR(low).bitwiseOR(high)
    return out


def simhash(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., fp) for every row of ``texts``, whose ``key`` must tell its rows apart.

    Texts without words, null ones too, have fingerprint 0. Equal texts have
    equal fingerprints.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    cut = texts.select(*key, words.alias("t"))
    size = F.greatest(F.size("t"), F.lit(1))
    # A row without words still stands for its text: its only term is null and weighs nothing.
    first = F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit(None).cast("string")))
    zipped = F.arrays_zip(first.alias("a"), F.slice("t", F.lit(2), size).alias("b"), F.slice("t", F.lit(3), size).alias("c"))
    terms = cut.select(*key, F.inline(zipped).alias("a", "b", "c"))
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in "abc"), F.lit(0)).cast("long")
    hashed = terms.select(*key, F.xxhash64("a", "b", "c").alias("h"), weight.alias("w"))
    return hashed.groupBy(*key).agg(*_votes()).select(*key, _fingerprint().alias("fp"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """0 to 1: the cosine of the angle that the differing bits of two fingerprints estimate; 0 from a right angle on."""
    bits = F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))
    return F.greatest(F.cos(bits * F.lit(3.141592653589793 / 64)), F.lit(0.0))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def successors(keys: DataFrame) -> DataFrame:
    """(no_id, id, next_no_id, next_id) in ascending order, after the last the first; ``keys`` are distinct.

    Keys are dealt out by range; only a range's last key needs another range,
    of which the first keys, one row each, are put in order.
    """
    ranges = materialise(keys.repartitionByRange("no_id", "id").withColumn("p", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("p").orderBy("no_id", "id")
    after = F.lead(F.struct("no_id", "id")).over(own)
    firsts = ranges.groupBy("p").agg(F.min(F.struct("no_id", "id")).alias("first"))
    in_order = Window.orderBy("p")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("p", F.coalesce(F.lead("first").over(in_order), F.min("first").over(everything)).alias("head"))
    linked = ranges.withColumn("next", after).join(heads, "p").withColumn("next", F.coalesce("next", "head"))
    return linked.select("no_id", "id", F.col("next.no_id").alias("next_no_id"), F.col("next.id").alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited form, row by row.

    Edited, a text's last quarter of code points, rounded down, gives way to as
    many first ones of the next document's, or all it has. The next document is
    the one with the next larger id; after the last comes the first. Rows of
    one id share their next document, and as a next document they count with
    their smallest text and smallest fingerprint. Rows without an id come last
    and are one document in this. A null text is empty.
    """
    rows = docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = ["no_id", "id"]
    quarter = F.floor(F.length("text") / 4).cast("int")
    needs = rows.groupBy(*key).agg(F.max(quarter).alias("need"))
    links = materialise(successors(needs.select(*key)).join(needs, key), "successors")
    # The text that each document lends to the one before it. Texts are dealt out once, for both joins.
    lent = rows.join(links.select(F.col("next_no_id").alias("no_id"), F.col("next_id").alias("id"), F.col("no_id").alias("to_no_id"), F.col("id").alias("to_id"), "need"), key)
    lent = lent.groupBy(F.col("to_no_id").alias("no_id"), F.col("to_id").alias("id")).agg(F.min(F.substring("text", F.lit(1), F.col("need"))).alias("lent"))
    joined = rows.join(lent, key).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.substring("text", F.lit(1), F.length("text") - quarter)
    edited = joined.withColumn("edited", F.concat(kept, F.substring("lent", F.lit(1), quarter)))
    known = ["row", *key, "n_chars", "edited_sha256"]
    named = edited.select(
        F.monotonically_increasing_id().alias("row"), *key, "n_chars", "text", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    )
    forms = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))
    both = named.select(*known, F.explode(forms).alias("e")).select(*known, "e.v", F.col("e.t").alias("text"))
    prints = simhash(both, [*known, "v"])
    paired = prints.groupBy(*known).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp"))
    paired = materialise(paired, "fingerprints")
    following = paired.groupBy(*key).agg(F.min("fp").alias("next_fp")).select(F.col("no_id").alias("next_no_id"), F.col("id").alias("next_id"), "next_fp")
    found = paired.join(links.drop("need"), key).join(following, ["next_no_id", "next_id"])
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp1, fp2, bits) for every two different values of ``fp`` that differ in at most ``radius`` bits, once each.

    64 bits are cut into blocks. Two values within the radius agree in
    ``blocks - radius`` blocks at least, so there is a table for every choice
    of so many blocks, in which the chosen ones come first and are the key. A
    pair that meets in several tables is taken from the first.
    """
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than bits may differ")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block_masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(block_masks[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    literal = [F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(m).alias("lead")) for k, m in enumerate(literal)])
    sent = prints.where(F.col("fp").isNotNull()).select("fp").distinct().select("fp", F.inline(tables))
    a, b = sent.withColumnRenamed("fp", "fp1"), sent.withColumnRenamed("fp", "fp2")
    differ = F.col("fp1").bitwiseXOR(F.col("fp2"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, F.lit(k)) for k, m in enumerate(literal)])
    met = a.join(b, ["table", "lead"]).where((F.col("fp1") < F.col("fp2")) & (F.bit_count(differ) <= radius) & (first == F.col("table")))
    return met.select("fp1", "fp2", F.bit_count(differ).alias("bits"))
