"""Quality by compression: which of two zstandard dictionaries, one built from good and one from bad labelled
text, makes a text smaller.

A text is compressed in blocks of BLOCK bytes, so that its own history does not take over from the dictionary;
x = (bad - good) / (bad + good) of the summed sizes. A logistic curve fitted to x on labelled rows that did not go into
the dictionaries turns x into a probability.

Learning takes a bounded sample of labelled rows, whole texts: of each class the max_rows with the least hash of their id. Those that
build the dictionaries come to the driver; those that the curve is fitted to are compressed where they are. Scoring reads whole texts.

Defined results: null and empty texts have no difference and the curve's value there; with no rows of one class
the score is the smoothed share of label 1; repeated label rows count once (the largest label); null labels
or ids teach nothing; null ids are not held out; repeated documents each get a row; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, release_memory

BLOCK, LEVEL, DICT_BYTES = 1024, 3, 112_640
MAX_ROWS = 2500
CUT = 0.3


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; too few samples to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=512, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    """Two dictionaries and the curve: weights of the difference, the logarithm and 1."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def __getstate__(self) -> tuple:
        return self.good, self.bad, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.good, self.bad, self.weights = state

    def packers(self) -> list:
        if not hasattr(self, "_packers"):
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress if d else None for d in (self.good, self.bad)]
        return self._packers

    def inputs(self, parts: list[bytes]) -> tuple[float, float]:
        good, bad = self.packers()
        n = sum(map(len, parts))
        if not n or good is None or bad is None:
            return 0.0, 0.0
        g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
        return (b - g) / n, math.log((g + 1) / n)

    def score(self, text: bytes) -> float:
        x, y = self.inputs(blocks(text))
        z = self.weights[0] * x + self.weights[1] * y + self.weights[2]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> list[float]:
    """Logistic weights of the columns of x and of 1, by Newton steps, with Platt's smoothed targets."""
    ones, zeros = int(y.sum()), int((1 - y).sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), design.T @ (target - p) - ridge * w)
        w = w + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def dictionaries(rows: list[tuple[bytes, int]]) -> Model:
    """The model without its curve, from (text, label)."""
    ones, zeros = ([p for t, y in rows if y == q for p in blocks(t)] for q in (1, 0))
    if not ones or not zeros:
        return Model(b"", b"", [0.0, 0.0, 0.0])
    return Model(build_dictionary(ones), build_dictionary(zeros), [0.0, 0.0, 0.0])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model from labelled documents that are not held out; every other row of a class, by the hash of its id, builds its dictionary, the rest fit the curve."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        part = part.withColumn("fits", F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")) % 2 == 0)
        sample = part if sample is None else sample.unionByName(part)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "fits", text)
    taught = [(bytes(r["text"]), r["quality"]) for r in rows.where("not fits").select("quality", "text").distinct().orderBy(F.xxhash64("text"), "text").collect()]
    model = dictionaries(taught)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.inputs(blocks(x.as_py())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())], names=["quality", "x", "y"])

    seen = sorted((r["quality"], r["x"], r["y"]) for r in rows.where("fits").mapInArrow(each, "quality int, x double, y double").distinct().collect())
    ones = sum(y for _, y in taught) + sum(r[0] for r in seen)
    if not model.good or len({r[0] for r in seen}) < 2:
        model.weights = [0.0, 0.0, math.log((ones + 1) / (len(taught) + len(seen) - ones + 1))]
    else:
        model.weights = fit_curve(np.array([r[1:] for r in seen]), np.array([r[0] for r in seen], float))
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of column text; a column of that name is replaced."""
    keep = [f for f in docs.schema.fields if f.name != out]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        m = sent.value
        for b in batches:
            scores = pa.array([m.score((x.as_py() or "").encode()) for x in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [scores], names=[f.name for f in keep] + [out])

    return docs.select(*[f.name for f in keep]).mapInArrow(each, StructType([*keep, StructField(out, DoubleType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
