"""Threshold-scaled document fingerprints: of every shingle's 64-bit hash, keep those below a
fixed fraction of the hash range (here one in 2**SCALE_BITS).

The same hashes are kept in every document, so fingerprints of parts merge by set union, and
the share of a small document's hashes found in a large one's estimates containment whatever the
two lengths. Fingerprints are sorted distinct hashes. Only DataFrame expressions are used.

Defined results: a null text is empty; a text of fewer than five words is one shingle (none
for no words); two empty fingerprints are alike (1.0) if their texts are equal, else 0.0; one empty
fingerprint is like nothing (0.0). Rows with equal ids are ordered by their text's hash and text; null ids
come last in descending order. Empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import words

SHINGLE = 5
SCALE_BITS = 2
#: Rows in an id range, about, and the least and greatest number of ranges (bounds are literals of the plan, looked up in two steps of STEP).
RANGE_ROWS, RANGES, STEP = 20_000, (256, 16_384), 128


def with_sketch(df: DataFrame, text: str, out: str, size: int = SHINGLE, scale_bits: int = SCALE_BITS) -> DataFrame:
    """Add the fingerprint of column text as array<bigint>."""
    w, h = f"_{out}_w", f"_{out}_h"
    df = df.withColumn(w, words(F.lower(F.coalesce(F.col(text), F.lit("")))))
    df = df.withColumn(
        h,
        F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )
    kept = F.filter(h, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0) if scale_bits else F.col(h)
    return df.withColumn(out, F.sort_array(F.array_distinct(kept))).drop(w, h)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two texts together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has; null if a is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def likeness(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Containment of the smaller fingerprint in the larger; see above for empty ones."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when((F.size(a) == 0) & (F.size(b) == 0) & (ta == tb), F.lit(1.0)).otherwise(F.lit(0.0))


def as_hex(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds the key has reached: first among every STEP-th, then among those that follow."""
    if not bounds:
        return F.lit(0)
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    blocks = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    block = F.greatest(F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= key)) - 1, F.lit(0))
    return block * STEP + F.size(F.filter(F.get(F.array(*map(longs, blocks)), block), lambda x: x <= key))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the sketch, and next_text and next_sketch of the next row by descending id, the first after the last.

    Rows are dealt by id range (bounds from approximate quantiles, so that ranges are even whatever
    the ids); each range also gets a ghost of the row that follows it. So each window sees a range's
    rows and one more, and no task sees the whole table. Ghosts are chosen by text, so that each text is sketched once."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ranges = min(RANGES[1], max(RANGES[0], docs.count() // RANGE_ROWS))
    bounds = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], min(100 * ranges, 1_000_000))).first()[0] or []
    part = _range_of(key, sorted(set(bounds)))
    rows = docs.withColumns({"_k": key, "_part": part, "_h": F.xxhash64("text"), "_ghost": F.lit(False)})
    order = [F.col("_k").desc(), F.col("_h"), F.col("text")]
    # the first row of each range, in the window's order
    heads = rows.groupBy("_part").agg(F.max(F.struct("_k", F.bitwise_not("_h").alias("_nh"))).alias("m")).select(F.col("_part").alias("_hp"), "m").collect()
    live = sorted((r["_hp"] for r in heads), reverse=True)
    after = {b: a for a, b in zip(live, live[1:] + live[:1], strict=True)}  # head of b follows the rows of a
    if not live:
        return with_sketch(rows, "text", "sketch").withColumns({"next_text": F.col("text"), "next_sketch": F.col("sketch")}).drop("_k", "_part", "_h", "_ghost")
    spark = docs.sparkSession
    table = spark.createDataFrame([(r["_hp"], r["m"]["_k"], ~r["m"]["_nh"], after[r["_hp"]]) for r in heads], "_hp int, _hk bigint, _hh bigint, _to int")
    ghosts = rows.join(F.broadcast(table), (F.col("_part") == F.col("_hp")) & (F.col("_k") == F.col("_hk")) & (F.col("_h") == F.col("_hh")))
    ghosts = ghosts.groupBy("_to").agg(F.min("text").alias("text")).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(-(2**63)).cast("bigint").alias("_k"), F.col("_to").alias("_part"), F.lit(0).cast("bigint").alias("_h"), F.lit(True).alias("_ghost"))
    w = Window.partitionBy("_part").orderBy(F.col("_ghost"), *order)
    both = with_sketch(rows.select("doc_id", "text", "_k", "_part", "_h", "_ghost").unionByName(ghosts), "text", "sketch")
    out = both.withColumns({"next_text": F.lead("text").over(w), "next_sketch": F.lead("sketch").over(w)})
    return out.where(~F.col("_ghost")).drop("_k", "_part", "_h", "_ghost")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next_text(docs)
    half = F.col("_half")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "_edited", "_es")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("sketch")).alias("fingerprint"),
        as_hex(F.col("_es")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("_es"), F.col("text"), F.col("_edited")).cast("double").alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text"), F.col("next_text")).cast("double").alias("near_next"),
        F.size("sketch").alias("n_hashes"),
    )
