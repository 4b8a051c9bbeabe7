"""Feature vectors of lines, chunk means, couplet vectors and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions import metre as M

KEYS = ["work", "author", "book_no", "line_idx"]


def distribution(lines: DataFrame, elisions: bool = True, keys: list[str] | None = None) -> DataFrame:
    """One row of features a line; every expression is worked out in the scan's stage."""
    cols = [F.expr(M.feature(f)).alias(f) for f in M.FEATURES]
    if elisions:
        cols.append(F.expr(M.elision_count()).alias("ELC"))
    return lines.select(*(keys or [k for k in [*KEYS, "rn"] if k in lines.columns]), *cols)


def names(df: DataFrame) -> list[str]:
    return [c for c in [*M.FEATURES, "ELC"] if c in df.columns]


def chunk_means(feats: DataFrame, n: int, by: list[str], order: str, digits: int | None = 4) -> DataFrame:
    """Means of n consecutive rows of each group; a short last chunk is dropped."""
    if n < 1:
        raise ValueError("a chunk has a row at least")
    placed = feats.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / n))
    mean = lambda c: F.round(F.avg(c), digits) if digits is not None else F.avg(c)
    return placed.groupBy(*by, "chunk").agg(F.count("*").alias("n"), *[mean(c).alias(c) for c in names(feats)]).where(F.col("n") == n).drop("n")


def centroid(feats: DataFrame, by: list[str]) -> DataFrame:
    return feats.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names(feats)])


def rechunk(feats: DataFrame, n: int, by: str, seed: int | None = None) -> DataFrame:
    """chunk_means over the rows of each label, in order or shuffled by a seed."""
    keyed = feats.withColumn("_o", F.xxhash64(F.lit(seed), "book_no", "line_idx") if seed is not None else F.struct("book_no", "line_idx"))
    return chunk_means(keyed, n, [by], "_o")


def couplets(lines: DataFrame) -> DataFrame:
    """(book keys, couplet, features of the hexameter with H before their names, of the pentameter with P), pairing rows by place;
    a last line without a partner is dropped, and P3SP, P4SP are constant and left out."""
    feats = distribution(lines, keys=["work", "author", "book_no", "rn"])
    feats = feats.withColumn("couplet", F.floor(F.col("rn") / 2))
    side = lambda k, p: [F.max(F.when(F.col("rn") % 2 == k, F.col(c))).alias(p + c) for c in M.FEATURES]
    out = feats.groupBy("work", "author", "book_no", "couplet").agg(F.count("*").alias("_n"), *side(0, "H"), *side(1, "P"), F.sum("ELC").alias("ELC"))
    return out.where("_n = 2").drop("_n", "P3SP", "P4SP")


def moments(feats: DataFrame, by: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(by, a, b, n, mean_a, mean_b, covariance): population covariance of pairs of features, of every one if none are named. Equal vectors are counted first, and
    only their kinds are spread into pairs, so what is shuffled and multiplied is far less than the lines; the result has a row a
    pair, whatever the data's size."""
    cs = names(feats)
    kinds = feats.groupBy(*by, *cs).agg(F.count("*").alias("_k"))
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    rows = kinds.select(*by, "_k", F.explode(F.array(*[pair(a, b) for a, b in pairs or [(a, b) for i, a in enumerate(cs) for b in cs[i:]]])).alias("p")).select(*by, "_k", "p.*")
    k = F.col("_k")
    sums = rows.groupBy(*by, "a", "b").agg(F.sum("_k").alias("n"), F.sum(k * F.col("x")).alias("sx"), F.sum(k * F.col("y")).alias("sy"), F.sum(k * F.col("x") * F.col("y")).alias("sxy"))
    n = F.col("n")
    return sums.select(*by, "n", "a", "b", (F.col("sx") / n).alias("mean_a"), (F.col("sy") / n).alias("mean_b"), (F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)).alias("covariance"))
