"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A fingerprint's bit is set if it is set in over half of the XXH64 hashes of the text's 4-word
shingles. Distinct fingerprints only are compared; copies share one.

Sharding. One tree over all 64 bits prunes nearly nothing: distances of unrelated fingerprints crowd about 32, so rings of +-4 round a boundary
hold most of them, on both sides. So there are several trees, each over some of the bits only, whose distance is a pseudo-metric below the whole
one. The bits are cut into RADIUS + m segments; of two fingerprints with at most RADIUS differing bits, some m segments are equal, and in the tree
over these the search radius is 0: the triangle bound leaves, at each of LEVELS sampled vantage points, the branch of the same distance and no
other, and boundaries overlap by nothing. The distances to the vantage points are the path to a shard; the shards of all trees together hold
every pair. m follows the number of fingerprints, by the cost of copies and of comparisons, so that shards don't grow with it.

Within a shard a vantage-point tree over the whole distance splits by the median distance to a
vantage down to LEAF rows; a side is searched only if the triangle bound lets it hold a partner, so rows within RADIUS of
the boundary are compared across it, and leaves are compared exactly. Only links that join two parts
leave a shard (at most one for each fingerprint), never all pairs of a group.

A shard of more than SHARD_ROWS fingerprints is split by rows into blocks, and pairs of blocks are
tasks of their own; in these too only joining links leave.

Links of all shards are joined into components by alternating large-star and small-star
rounds, each written to the shared folder.

Defined results: null and word-less texts have fingerprint zero and are linked like any other; rows
with null ids take part, and component_id is the least non-null id (null if there is none);
repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, publish

SHINGLE, SEED = 4, 42
RADIUS = 4
#: Vantage points of each tree over some of the bits; rows of a leaf of a tree over all; rows compared at once.
LEVELS, LEAF, BLOCK = 16, 32, 1024
SHARD_ROWS = 16_384
#: Cost of copying a row to one more tree, in comparisons.
COPY = 200
#: Hot shards that are named by broadcast; more are joined by shuffle, with the same result.
NAMED = 10_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text, as an unsigned number."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    starts, ends, at = [], [], 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    hash_ = xxhash.xxh64_intdigest
    total, bits = len(found) - shingle + 1, np.zeros(64, np.int64)
    for lo in range(0, total, 8192):
        hi = min(total, lo + 8192)
        h = np.fromiter((hash_(line[s:e], seed) for s, e in zip(starts[lo:hi], ends[lo + shingle - 1 : hi + shingle - 1], strict=True)), np.uint64, hi - lo)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a long with the same bits; the text is dropped from the result."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in b.column("_text")), np.uint64, b.num_rows)
            cols = [b.column(f.name) for f in keep] + [pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in keep] + [out])

    rows = docs.select(*[F.col(f.name) for f in keep], F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(each, StructType([*keep, StructField(out, LongType())]))


class Joined:
    """Union-find over places in an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.compared = 0

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            n = self.up[r]
            if (n == r).all():
                break
            r = n
        self.up[at] = r
        return r

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def differing(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a number or a row of numbers."""
    if fps.ndim == 1:
        return np.bitwise_count(fps[i] ^ fps[j])
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.uint16) for w in fps.T)


def compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, joined: Joined, radius: int) -> None:
    """Join all of a with all of b that lie within the radius. Each round adds one link for each row that
    has a partner in another part, until none has."""
    for lo in range(0, len(a), BLOCK):
        for left in range(0, len(b), BLOCK):
            i, j = a[lo : lo + BLOCK], b[left : left + BLOCK]
            joined.compared += len(i) * len(j)
            near = differing(fps, i[:, None], j[None, :]) <= radius
            if not near.any():
                continue
            while True:
                bad = near & (joined.roots(i)[:, None] != joined.roots(j)[None, :])
                rows = np.flatnonzero(bad.any(axis=1))
                if not len(rows):
                    break
                for r, c in zip(rows, bad[rows].argmax(axis=1), strict=True):
                    joined.union(i[r], j[c])


def self_join(fps: np.ndarray, at: np.ndarray, joined: Joined, radius: int) -> None:
    """Vantage-point tree over places `at`: split at the median distance to a vantage, search both sides, and
    compare across the boundary those rows only that the triangle bound leaves."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            compare(fps, at, at, joined, radius)
            continue
        d = differing(fps, at, at[0]).astype(int)
        for p in at[(d <= radius) & (d > 0)]:
            joined.union(at[0], p)
        cut = int(np.median(d))
        inner, outer = at[d <= cut], at[d > cut]
        if not len(inner) or not len(outer):
            compare(fps, at, at, joined, radius)
            continue
        compare(fps, inner[d[d <= cut] > cut - radius], outer[d[d > cut] <= cut + radius], joined, radius)
        todo += [inner, outer]


def trees(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits of each tree for n fingerprints: all choices of m of radius + m segments, with the m of least cost."""

    def masks(m: int) -> list[int]:
        k = radius + m
        segments = [((1 << 64 * (i + 1) // k) - 1) & ~((1 << 64 * i // k) - 1) for i in range(k)]
        return [sum(c) for c in itertools.combinations(segments, m)]

    def cost(found: list[int]) -> float:
        return len(found) * (COPY + n / 2.0 ** min(f.bit_count() for f in found))

    return min(map(masks, (1, 2, 3)), key=cost)


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that join all fingerprints within the radius of one another."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    vantage = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(levels).collect()]

    def path(mask: int) -> Column:
        """Distances to the vantage points over the bits of a tree."""
        rings = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v).cast("long")).bitwiseAND(F.lit(signed(mask)).cast("long"))) for v in vantage]
        return F.xxhash64(*rings) if rings else F.lit(0).cast("long")

    keys = F.array(*[F.struct(F.lit(k).alias("tree"), path(mask).alias("shard")) for k, mask in enumerate(trees(fps.count(), radius))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.tree", "k.shard")
    sizes = rows.groupBy("tree", "shard").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > shard_rows).select("tree", "shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("blocks"))
    hot = publish(hot, "hot-shards")
    blocks = F.broadcast(hot) if hot.count() <= NAMED else hot
    rows = rows.join(blocks, ["tree", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine)
    # block m meets block o in the task of the two: (min, max)
    rows = rows.select("fp", "tree", "shard", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    rows = rows.select("fp", "tree", "shard", "mine", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))

    def each(key: tuple, table: pa.Table) -> pa.Table:
        values = np.sort(table.column("fp").to_numpy().view(np.uint64))
        joined = Joined(len(values))
        self_join(values, np.arange(len(values)), joined, radius)
        roots = joined.roots(np.arange(len(values)))
        own = roots != np.arange(len(values))
        return pa.table({"a": values[own].view(np.int64), "b": values[roots[own]].view(np.int64)})

    several = rows.groupBy("tree", "shard", "x", "y")
    return several.applyInArrow(each, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the least node it reaches. Large-star, then small-star,
    until no edge changes; every round is written to the shared folder, and nodes go to their neighbour of
    least value, so that a hub's edges are spread over its neighbours after the first round."""
    e = publish(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        old, e = e, publish(small, "edges")
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of every row of docs(key, text)."""
    prints = publish(with_fingerprint(docs.select(key, "text")), "fingerprints")
    # node: a fingerprint; its least id stands for its rows
    distinct = publish(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    comps = publish(components(links(distinct.select("fp"), radius)), "components")
    named = distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = publish(named.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id"), "component-ids")
    discard(distinct, comps)
    return prints.join(of, prints["fp"] == of["_fp"], "left").select(key, "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
