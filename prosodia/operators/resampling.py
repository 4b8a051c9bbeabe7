"""Random draws as plans: a replicate a row, seeded, so that runs repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.functions import statistics as S

from . import features

def sampled_distribution(feats: DataFrame, size: int, n: int, seed: int) -> DataFrame:
    """n means of `size` rows drawn without replacement (anew for each mean). Rows with equal features are one kind with a count; a draw takes how many
    come of each kind (multivariate hypergeometric), so only kinds reach the workers: of 20 yes-or-no features and a small number there are bounded many,
    however many rows. Kinds are in the order of their values, so that draws repeat."""
    cs = features.names(feats)
    kinds = feats.groupBy(*cs).agg(F.count("*").alias("_k")).orderBy(*cs).toArrow()
    count = sum(kinds.column("_k").to_pylist())
    if size > count:
        raise ValueError(f"cannot draw {size} of {count} rows")
    spark = feats.sparkSession
    sent = spark.sparkContext.broadcast((np.column_stack([kinds.column(c).to_numpy() for c in cs]).astype(np.int16), kinds.column("_k").to_numpy()))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, k = sent.value
        for part in parts:
            means = [np.random.default_rng([seed, int(r)]).multivariate_hypergeometric(k, size, method="marginals") @ x / size for r in part["id"]]
            out = pd.DataFrame(means, columns=cs)
            out.insert(0, "replicate", part["id"].to_numpy())
            yield out

    return spark.range(n).mapInPandas(draw, "replicate bigint, " + ", ".join(f"`{c}` double" for c in cs))


def _moments(dist: DataFrame, cs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances: a matrix of features by features is all that reaches the driver."""
    place = {c: i for i, c in enumerate(cs)}
    mean, cov = np.zeros(len(cs)), np.zeros((len(cs), len(cs)))
    for r in features.moments(dist.select(*cs, F.lit(1).alias("_all")), ["_all"]).collect():
        i, j = place[r["a"]], place[r["b"]]
        cov[i, j] = cov[j, i] = r["covariance"]
        if i == j:
            mean[i] = r["mean_a"]
    return mean, cov


def explain_each(points: DataFrame, dist: DataFrame, by: list[str], shrinkage: float = 0.1) -> DataFrame:
    """(by, feat, score, samp, dist, m, p): the squared Mahalanobis distance of each point (by, features) from a distribution, by feature."""
    cs = features.names(dist)
    mean, cov = _moments(dist, cs)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema.fields)

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, x in zip(part[by].itertuples(index=False, name=None), part[cs].to_numpy(float), strict=True):
                v, m, p = S.contributions(x, mean, cov, shrinkage)
                rows += [(*key, c, float(a), float(b), float(d), float(m), float(p)) for c, a, b, d in zip(cs, v, x, mean, strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "feat", "score", "samp", "dist", "m", "p"])

    return points.select(*by, *cs).mapInPandas(each, f"{kind}, feat string, score double, samp double, dist double, m double, p double")


def explain(point: dict[str, float], dist: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """(feat, score, samp, dist, m, p): the squared Mahalanobis distance of a point from a distribution, by feature, largest part first."""
    cs = features.names(dist)
    mean, cov = _moments(dist, cs)
    x = np.array([point[c] for c in cs], float)
    v, m, p = S.contributions(x, mean, cov, shrinkage)
    out = sorted(zip(cs, v.tolist(), x.tolist(), mean.tolist(), strict=True), key=lambda r: -r[1])
    return dist.sparkSession.createDataFrame([(*r, m, p) for r in out], "feat string, score double, samp double, dist double, m double, p double")


def report(explained: DataFrame, latex: bool = False, limit: int = 10) -> str:
    """The report of explain() as text or as LaTeX rows."""
    rows = explained.orderBy(F.col("score").desc()).limit(limit).collect()
    join, end = (" & ", r" \\") if latex else ("  ", "")
    return "\n".join([f"m {rows[0]['m']:.4f}, p {rows[0]['p']:.4f}", *(join.join([f"{r['feat']:<5}", f"{r['score']:8.3f}", f"{r['samp']:8.3f}", f"{r['dist']:8.3f}"]) + end for r in rows)])


def chunk_explain(sample: DataFrame, dist: DataFrame, size: int, n: int = 5000, seed: int = 0, shrinkage: float = 0.1, drawn: DataFrame | None = None) -> DataFrame:
    """explain() of a sample's centroid against n drawn means of `size` rows of dist."""
    cs = features.names(dist)
    point = sample.agg(*[F.avg(c).alias(c) for c in cs]).first().asDict()
    return explain(point, drawn if drawn is not None else sampled_distribution(dist, size, n, seed), shrinkage)
