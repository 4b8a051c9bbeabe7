"""Near-duplicates by Jaccard similarity of 5-word shingle sets, for the pipeline.

Two texts are linked if the similarity of their sets of shingle hashes (XXH64) is at least
4/5; equal sets are one node, and word-less texts share the empty set. Exact but for hash collisions and
for the radius below.

Shards. In the order of the hashes (any order of all shingles does), two sets of similarity >= 4/5 share one of the
floor(n / 5) + 1 first shingles of each, so a shard for each such shingle holds every pair. Shingles that over COMMON sets
(and a 100,000th of all) have among their first come last in the order, and the sets concerned take others instead. Shards of equal members are
one.

Within a shard, vantage-point trees over SimHash fingerprints of 256 bits find the pairs of at most
RADIUS differing bits. At similarity 4/5 about 39 bits differ (deviation 6; of sets of four and five shingles 48), so 84 lose less than one pair in
10^8, while unrelated fingerprints differ in 128 (deviation 8). Only joining links leave a shard.

Verification. Candidate links are joined into components, each of which holds the whole components of linked sets
within it; these are found by comparing the sets themselves, each set with all that are not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, few_rows, numbered, publish, release_memory, unused
from .simhash import SEED, SHARD_ROWS, Joined, components, self_join

SHINGLE, WORDS = 5, 4
#: Similarity, as a fraction.
LEAST, OF = 4, 5
RADIUS = 84
COMMON, COMMONEST = 1000, 100_000
#: Rows that are joined by broadcast at most (some ten bytes each); more go by shuffle, with the same result.
NAMED = 200_000


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles of a UTF-8 text, in order; a text of fewer words is one shingle."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts, line, hash_ = [0, *ends[:-1].tolist()], b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= SHINGLE:
        return np.array([hash_(line, SEED)], np.uint64)
    pairs = zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)
    return np.unique(np.fromiter((hash_(line[s:e], SEED) for s, e in pairs), np.uint64, len(found) - SHINGLE + 1))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(sh: np.ndarray) -> bytes:
    """SimHash of a set: WORDS words of 64 bits, each bit set if it is in over half of the hashes."""
    bits = np.zeros((WORDS, 64), np.int64)
    for lo in range(0, len(sh), 8192):
        for k in range(WORDS):
            bits[k] += np.unpackbits(_mixed(sh[lo : lo + 8192], k + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(sh), axis=1, bitorder="little").tobytes()


def needed(n: int) -> int:
    """How many first shingles of a set of n shard it: one more than may be missing at the least similarity."""
    return n - -(-LEAST * n // OF) + (n > 0)


def first(sh: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (common, hash)."""
    if len(sh) and len(common):
        rare = ~np.isin(sh, common)
        sh = np.concatenate([sh[rare], sh[~rare]])
    return sh[: needed(len(sh))]


def with_sets(rows: DataFrame) -> DataFrame:
    """(row, node, fp, size, first) of rows(row, text): node is the hash of the whole set; first has its least hashes, half as many again as shard it, so that
    common ones can be left out without the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py() or b"") for x in b.column("text")]
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            stored = [s[: needed(len(s)) * 3 // 2 + 8].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(nodes.view(np.int64)), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(stored, pa.list_(pa.int64()))],
                names=["row", "node", "fp", "size", "first"],
            )

    return rows.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(each, StructType([rows.schema["row"], *StructType.fromDDL("node bigint, fp binary, size int, first array<bigint>")]))


def chosen(sets: DataFrame, common: list[int]) -> DataFrame:
    """(node, first) of sets(node, size, first): the shingles that shard each, common ones last; null where those stored don't do."""
    sent = sets.sparkSession.sparkContext.broadcast(np.sort(np.array(common, np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for size, stored in zip(b.column("size").to_pylist(), b.column("first"), strict=True):
                s, need = stored.values.to_numpy(), needed(size)
                rare = ~np.isin(s, sent.value) if len(sent.value) else np.ones(len(s), bool)
                found = s[rare][:need]
                if len(found) < need:
                    found = np.concatenate([s[rare], s[~rare]])[:need] if len(s) == size else None
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["node", "first"])

    return sets.select("node", "size", "first").mapInArrow(each, "node bigint, first array<bigint>")


def _rarer(rows: DataFrame, common: list[int]) -> DataFrame:
    """(node, first) of rows(node, text), with the common shingles last."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(common, np.int64).view(np.uint64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first(shingles(x.as_py() or b""), sent.value).view(np.int64) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "first"])

    return rows.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(each, "node bigint, first array<bigint>")


def _few(df: DataFrame) -> DataFrame:
    """df (published), for a join by broadcast if it is small."""
    return F.broadcast(df) if df.count() <= NAMED else df


def candidates(sets: DataFrame, firsts: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that join all nodes of sets(node, fp) that share one of firsts(node, first) and lie within RADIUS."""
    rows = firsts.select("node", F.explode("first").alias("h"))
    shards = rows.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    shards = publish(shards.groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("n") / shard_rows).cast("int").alias("blocks")), "shards")
    rows = rows.join(shards, "h").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block m meets block o in the task of the two: (min, max)
    rows = rows.select("node", "h", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    rows = publish(rows.select("node", "h", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y")), "shard-rows")
    discard(shards)
    rows = rows.join(sets, "node")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may reach over batches."""
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
            at = np.column_stack([t.column(c).to_numpy() for c in ("h", "x", "y")])
            new = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            if not len(new):
                kept = t
                continue
            yield linked(t.slice(0, new[-1]), np.array([0, *new]))
            kept = t.slice(new[-1])
        if kept is not None and kept.num_rows:
            yield linked(kept, np.array([0, kept.num_rows]))
        release_memory()

    def linked(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        nodes = t.column("node").to_numpy()
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
        joined = Joined(len(nodes))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo == 2:
                if int(np.bitwise_count(fps[lo] ^ fps[lo + 1]).sum(dtype=int)) <= RADIUS:
                    joined.union(lo, lo + 1)
            elif hi - lo > 2:
                self_join(fps, np.arange(lo, hi), joined, RADIUS)
        roots = joined.roots(np.arange(len(nodes)))
        own = roots != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], names=["a", "b"])

    return rows.select("h", "x", "y", "node", "fp").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(runs, "a bigint, b bigint")


def verified(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first set of its component, linked where the similarity is at least 4/5."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, int)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    has, root, left = np.zeros(int(flat.max(initial=0)) + 1, bool), np.full(n, -1), np.arange(n)
    # left: places not reached yet; their shingles lie in `rest`, cut at `cuts`
    rest, cuts = flat, starts
    for i in range(n):
        if root[i] >= 0:
            continue
        todo = [i]
        root[i] = i
        while todo and len(left):
            x = todo.pop()
            mine = flat[starts[x] : starts[x + 1]]
            has[mine] = True
            upto = np.concatenate([[0], np.cumsum(has[rest])])
            has[mine] = False
            both = upto[cuts[1:]] - upto[cuts[:-1]]
            found = (OF * both >= LEAST * (sizes[left] + len(mine) - both)) | (left == i)
            todo += [int(p) for p in left[found] if p != i]
            root[left[found]] = i
            if found.any():
                rest = rest[np.repeat(~found, sizes[left])]
                left = left[~found]
                cuts = np.concatenate([[0], np.cumsum(sizes[left])])
    return root


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the first of least doc_id. Texts are joined with the numbers of rows; they are not compared themselves, and
    do not meet by component but for verification."""
    with few_rows(docs.sparkSession):
        return _kept(docs)


def _kept(docs: DataFrame) -> DataFrame:
    number = unused("_row", docs.columns)
    rows = numbered(docs, number)
    texts = rows.select(F.col(number).alias("row"), "text")
    found = publish(with_sets(texts), "sets")
    least = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("bigint"), F.col("row"))
    ids = publish(rows.select(F.col(number).alias("row"), "doc_id").join(found.select("row", "node"), "row").select("row", "node", least.alias("least")), "ids")
    nodes = publish(ids.groupBy("node").agg(F.min("least").alias("least")), "nodes")
    one = publish(found.join(nodes.select(F.col("least.row").alias("row")), "row", "left_semi").drop("row"), "distinct-sets")
    discard(found)
    firsts = publish(chosen(one, []), "firsts")
    # at most COMMONEST of them: each has that part of all; any order of the shingles is exact
    often = max(COMMON, (firsts.agg(F.sum(F.size("first"))).first()[0] or 0) // COMMONEST)
    common = [r.h for r in firsts.select(F.explode("first").alias("h")).groupBy("h").count().where(F.col("count") > often).select("h").collect()]
    if common:
        discard(firsts)
        firsts = publish(chosen(one, common), "firsts")
        short = publish(firsts.where("first is null").select("node").join(nodes, "node").select("node", F.col("least.row").alias("row")), "short")
        some = firsts.where("first is not null")
        if short.limit(1).count():
            some = some.unionByName(_rarer(texts.join(_few(short), "row"), common))
        whole = publish(some, "rarer-firsts")
        discard(firsts, short)
        firsts = whole
    linked = publish(candidates(one.select("node", "fp"), firsts), "links")
    discard(one, firsts)
    comps = publish(components(linked), "candidates")
    discard(linked)
    asked = publish(nodes.join(comps, "node").select("node", "root", F.col("least.row").alias("row")), "asked")
    theirs = texts.join(_few(asked), "row")

    def exact(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("node").to_numpy()
        root = verified([shingles(x.as_py() or b"") for x in table.column("text")])
        return pa.table({"node": at, "root": at[root]})

    groups = theirs.select("root", "node", F.col("text").cast("binary").alias("text")).groupBy("root")
    joined = publish(groups.applyInArrow(exact, "node bigint, root bigint"), "components")
    discard(comps, asked)
    named = nodes.join(joined, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = publish(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(number)), "kept")
    gone = publish(ids.select(F.col("row").alias(number)).join(kept, number, "left_anti"), "gone")
    discard(nodes, joined, ids)
    if gone.count() <= NAMED:
        return rows.join(F.broadcast(gone), number, "left_anti").select(docs.columns)
    return rows.join(kept, number, "left_semi").select(docs.columns)
