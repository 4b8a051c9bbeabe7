"""Repeated passages over a whole corpus, by longest-previous-factor arrays of suffix arrays.

A byte is repeated if a string of min_len bytes that covers it also starts elsewhere, in the same text or another. One suffix array of a
corpus fits no machine, so places are first brought together:

1. Every window of min_len bytes has an owner, its GRAM-byte string of least hash (leftmost among equals). Equal windows have equal owners at
   equal places, so a run of windows with one owner, its piece, has to be compared with pieces of the same owner only. Runs are counted by
   (owner, piece) hashes, with partial sums before each shuffle.
2. A piece that occurs twice is repeated as a whole. Distinct pieces with one owner, that is the ends of shared passages, are fetched and
   concatenated in the order of first occurrence. Their suffixes are sorted by prefix doubling; the previous and next smaller
   positions in that order give each place's longest previous factor, and the mirror image its longest next factor: a window is repeated
   if either is long enough, and a later copy if the previous one is.
3. An owner with more than GROUP pieces is not gathered: its pieces' windows are counted by 128-bit hash, which stands for the bytes (two
   different windows share one with a chance below 1e-18 in 10^10 windows).

Owners and pieces with a large share of all rows are joined by broadcast: there are 100,000 of them at most, as each has at least that part of
the rows; no task gets all rows of one.

Modes: `every` marks all copies; `later` all but the first by (doc_id, text order in the input), which is what a cleaning step wants.

Defined results: a null text has no bytes; texts shorter than min_len are untouched; rows with equal ids or
texts are different places; null ids sort first; an empty table gives an empty result; other
columns pass through `deduplicate` untouched. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, publish, release_memory

#: Bytes of the contract's strings, and of the shortest passage that a cleaning step cuts: fewer than fifty words take.
MIN_LEN, PASSAGE = 400, 240
GROUP = 4096
#: Rows from which on an owner may be joined by broadcast, and how many such there can be.
SHARE_ROWS, SHARES = 20_000, 100_000
EVERY, LATER = 0, 1
#: Bytes of pieces in one suffix array, about.
BATCH = 1 << 20
#: Window starts hashed at once; places must fit the low 20 bits.
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Owners:
    """Owner of each window of a text."""

    def __init__(self, min_len: int, gram: int):
        self.min_len, self.gram, self.width = min_len, gram, min_len - gram + 1
        n = BLOCK + min_len
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, w = len(x), self.gram, self.width
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x.astype(np.uint64) * self.up[:n], out=sums[1:])
        m = n - k + 1
        h = (sums[k:] - sums[:-k]) * self.down[:m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ranked = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(m, dtype=np.uint64)
        starts = n - self.min_len + 1
        q = np.concatenate([ranked, np.full(-m % w + w, ~np.uint64(0))]).reshape(-1, w)
        tail = np.minimum.accumulate(q[:, ::-1], axis=1)[:, ::-1].ravel()
        head = np.minimum.accumulate(q, axis=1).ravel()
        least = np.minimum(tail[:starts], head[w - 1 : w - 1 + starts])
        return h, (least & np.uint64(0xFFFFF)).astype(np.int64)

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, owner hash, owner's place, first start and last start of the runs of windows with one owner, in order; short texts are hashed
        together, long ones in blocks."""
        found: list[list[np.ndarray]] = []
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k]) <= BLOCK):
                size += len(texts[k])
                k += 1
            lengths = np.array([len(t) for t in texts[i:k]])
            whole = np.frombuffer(texts[i] if k == i + 1 else b"".join(texts[i:k]), np.uint8)
            ends = np.cumsum(lengths)
            n = len(whole) - self.min_len + 1
            for lo in range(0, max(n, 0), BLOCK):
                h, own = self._block(whole[lo : min(lo + BLOCK, n) + self.min_len - 1])
                start = np.arange(lo, lo + len(own))
                text = np.searchsorted(ends, start, side="right")
                inside = np.flatnonzero(start + self.min_len <= ends[text])
                if not len(inside):
                    continue
                own, start, text = own[inside], start[inside], text[inside]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
                last = np.append(new[1:], len(own)) - 1
                base = (ends - lengths)[text[new]]
                found.append([i + text[new], h[own[new]].view(np.int64), own[new] + lo - base, start[new] - base, start[last] - base])
            i = k
        if not found:
            return (np.empty(0, np.int64),) * 5
        text, h, own, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        # a run that goes on over two blocks
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (own[1:] != own[:-1])]) if len(text) else np.empty(0, bool)
        at = np.flatnonzero(new)
        return text[at], h[at], own[at], first[at], last[np.append(at[1:], len(text)) - 1]

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, owner hash, piece hash, first start and last start of each piece, in order."""
        text, h, own, first, last = self.runs(texts)
        digest = xxhash.xxh3_64_intdigest
        rows = zip(text.tolist(), first.tolist(), (last + self.min_len).tolist(), (own - first).tolist(), strict=True)
        g = np.fromiter((digest(texts[t][a:z], o) for t, a, z, o in rows), np.uint64, len(text)).view(np.int64)
        return text, h, g, first, last


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    return rank


def ranks(x: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(k, rank of the k bytes from each place of x) for k = 1, 2, 4 and on to `length`, by prefix doubling; bytes are above 0, places past the end
    count as 0."""
    n, have, rank = len(x), 1, x.astype(np.int64)
    out = [(1, rank)]
    while have < length:
        step = min(have, length - have)
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + (have > 2)
        keys = rank * {1: 1 << 9, 2: 1 << 18}.get(have, n + 1) + after
        have += step
        rank = keys if have == 2 else _dense(keys)
        out.append((have, rank))
    return out


def common_prefix(levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and q, up to the last level's."""
    n, (most, last) = len(levels[0][1]), levels[-1]
    found = np.zeros(len(p), np.int64)
    for k, rank in reversed(levels[:-1]):
        at, to = p + found, q + found
        inside = np.maximum(at, to) < n
        same = np.zeros(len(p), bool)
        same[inside] = rank[at[inside]] == rank[to[inside]]
        found += k * same
    return np.where(last[p] == last[q], most, np.minimum(found, most))


def previous_factors(order: list[int], shared: list[int]) -> list[int]:
    """For each place in suffix order the longest prefix that it shares with a smaller place: the larger of those with the previous and the next
    smaller place. shared: common prefix of each place with the one before it."""
    out, n = [0] * len(order), len(order)
    stack: list[tuple[int, int]] = []  # entry, common prefix with the entry below it
    for i in range(n + 1):
        run = shared[i] if i < n else 0
        while stack and (i == n or order[stack[-1][0]] > order[i]):
            j, below = stack.pop()
            out[j] = max(below, run)
            run = min(run, below)
        stack.append((i, run if stack else 0))
    return out


def longest_previous_factors(x: np.ndarray) -> np.ndarray:
    """For each place of x the length of the longest string from it that also starts earlier."""
    out = np.zeros(len(x), np.int64)
    if len(x):
        levels = ranks(x + 1, len(x))
        order = np.argsort(levels[-1][1], kind="stable")
        shared = np.concatenate([[0], common_prefix(levels, order[:-1], order[1:])])
        left = len(x) - order
        out[order] = np.minimum(previous_factors(order.tolist(), shared.tolist()), left)
    return out


def factors(pieces: list[bytes], owned: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each owned start of each piece (its first ones, in order): piece, place in it, and its longest previous and next factor, up to `least` and
    within the piece; shorter ones are given as 0."""
    gap = np.zeros(1, np.int16)
    x = np.concatenate([a for p in pieces for a in (np.frombuffer(p, np.uint8).astype(np.int16) + 1, gap)])
    firsts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    piece = np.repeat(np.arange(len(pieces)), owned)
    place = np.arange(len(piece)) - np.repeat(np.cumsum([0, *owned[:-1]]), owned)
    at = firsts[piece] + place
    left = np.array([len(p) for p in pieces])[piece] - place
    levels = ranks(x, least)
    order = np.argsort(levels[-1][1][at], kind="stable")
    pos = at[order]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = common_prefix(levels, pos[:-1], pos[1:])
    before, after = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    # places that share `least` bytes stand together; of two the later has the earlier
    cuts = np.flatnonzero(shared < least)
    ends = np.append(cuts[1:], len(order))
    two = cuts[ends - cuts == 2]
    low, high = np.where(pos[two] < pos[two + 1], two, two + 1), np.where(pos[two] < pos[two + 1], two + 1, two)
    before[high], after[low] = shared[two + 1], shared[two + 1]
    for a, z in zip(cuts[ends - cuts > 2].tolist(), ends[ends - cuts > 2].tolist(), strict=True):
        places, lcp = pos[a:z].tolist(), [0, *shared[a + 1 : z].tolist()]
        before[a:z] = previous_factors(places, lcp)
        after[a:z] = previous_factors([-p for p in places], lcp)
    out = []
    for f in (before, after):
        own = np.zeros(len(order), np.int64)
        own[order] = f
        own = np.minimum(own, left)
        out.append(np.where(own >= least, own, 0))
    return piece, place, *out


def matched(pieces: list[bytes], owned: list[int], least: int) -> list[list[list[tuple[int, int]]]]:
    """For each kind of span and piece the runs of owned starts that are of it."""
    piece, place, before, after = factors(pieces, owned, least)

    def runs(flag: np.ndarray) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in pieces]
        i = np.flatnonzero(flag)
        if len(i):
            cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(piece[i]) != 0)) + 1
            for a, z in zip(i[np.concatenate([[0], cut])], i[np.concatenate([cut - 1, [len(i) - 1]])], strict=True):
                out[piece[a]].append((int(place[a]), int(place[z])))
        return out

    return [runs(np.maximum(before, after) > 0), runs(before > 0)]


def _stage(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    """docs without text, with row, z, n_bytes, sha and occs: texts compressed, with their pieces."""
    pass_on = [f for f in docs.schema.fields if f.name != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        own, pack = Owners(min_len, gram), zstandard.ZstdCompressor(level=1)
        occ = pa.struct([("h", pa.int64()), ("g", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                texts = [x.as_py() or b"" for x in b.column("_text")]
                text, h, g, first, last = own.pieces(texts)
                ends = np.searchsorted(text, np.arange(len(texts) + 1))
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((h, g, first.astype(np.int32), last.astype(np.int32)), occ, strict=True)], fields=list(occ))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_row"), *(b.column(f.name) for f in pass_on), pa.array([pack.compress(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["row", *(f.name for f in pass_on), "z", "n_bytes", "sha", "occs"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[f.name for f in pass_on], F.col("text").cast("binary").alias("_text"))
    more = StructType.fromDDL("row bigint, z binary, n_bytes bigint, sha string, occs array<struct<h:bigint,g:bigint,lo:int,hi:int>>")
    return rows.mapInArrow(each, StructType([more["row"], *pass_on, *more.fields[1:]]))


def _fetch(staged: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """wanted(row, h, g, ord, lo, hi) with the pieces' bytes."""
    names = ("h", "g", "ord", "lo", "hi")
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("want"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for big in batches:
            for at in range(0, big.num_rows, 200):
                out: dict[str, list] = {k: [] for k in ("row", *names, "piece")}
                for r in big.slice(at, 200).to_pylist():
                    text = unpack.decompress(r["z"])
                    for w in r["want"]:
                        for k in names:
                            out[k].append(w[k])
                        out["row"].append(r["row"])
                        out["piece"].append(text[w["lo"] : w["hi"] + min_len])
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return staged.select("row", "z").join(lists, "row").mapInArrow(each, "row bigint, h bigint, g bigint, ord bigint, lo int, hi int, piece binary")


_RUNS = ", ".join(f"r{k} array<struct<a:int,z:int>>" for k in (EVERY, LATER))


def _resolve(pieces: DataFrame, min_len: int) -> DataFrame:
    """(h, g, r0, r1): by kind the runs of owned starts, counted from the piece's first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        run = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))

        def solve() -> pa.RecordBatch:
            found = matched([p for _, _, p, _ in held], [n for *_, n in held], min_len)
            named = lambda x: pa.array([[{"a": a, "z": z} for a, z in r] for r in x], run)
            return pa.RecordBatch.from_arrays([pa.array([h for h, *_ in held], pa.int64()), pa.array([g for _, g, *_ in held], pa.int64()), *map(named, found)], names=["h", "g", "r0", "r1"])

        size = 0
        for b in batches:
            for h, g, lo, hi, p in zip(*(b.column(k).to_pylist() for k in ("h", "g", "lo", "hi", "piece")), strict=True):
                if size >= BATCH and held[-1][0] != h:
                    yield solve()
                    held, size = [], 0
                held.append((h, g, p, hi - lo + 1))
                size += len(p)
        if held:
            yield solve()

    by_owner = pieces.select("h", "g", "ord", "row", "lo", "hi", "piece").repartition("h").sortWithinPartitions("h", "ord", "row", "lo")
    return by_owner.mapInArrow(each, f"h bigint, g bigint, {_RUNS}")


def _resolve_large(pieces: DataFrame, min_len: int) -> DataFrame:
    """As _resolve, by counting the windows' hashes: no owner's pieces meet in one task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, ord_, row, lo, hi, p in zip(*(b.column(k).to_pylist() for k in ("h", "g", "ord", "row", "lo", "hi", "piece")), strict=True):
                n = hi - lo + 1
                same = [pa.array([v] * n, t) for v, t in ((h, pa.int64()), (g, pa.int64()), (ord_, pa.int64()), (row, pa.int64()), (lo, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(p[i : i + min_len]) for i in range(n)], pa.binary())], names=["h", "g", "ord", "row", "lo", "i", "w"])

    windows = pieces.mapInArrow(each, "h bigint, g bigint, ord bigint, row bigint, lo int, i int, w binary")
    mine = F.struct("ord", "row", "lo")
    counts = windows.groupBy("w").agg(F.count("*").alias("n"), F.min(mine).alias("first")).where("n > 1")
    hits = _shared_join(windows, counts, ["w"]).select("h", "g", F.struct(F.col("i").alias("a"), F.col("i").alias("z")).alias("r"), (mine != F.col("first")).alias("late"))
    return hits.groupBy("h", "g").agg(F.collect_list("r").alias("r0"), F.collect_list(F.when(F.col("late"), F.col("r"))).alias("r1"))


def _shared_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right(on, n, ...), n: rows of left with these keys. Keys with a large share of the rows go by broadcast."""
    right = publish(right, "shares")
    rows = right.agg(F.sum("n")).first()[0] or 0
    hot = right.where(F.col("n") >= max(SHARE_ROWS, rows // SHARES))
    if not hot.limit(1).count():
        return left.join(right.drop("n"), on)
    cold = right.where(F.col("n") < max(SHARE_ROWS, rows // SHARES)).drop("n")
    near = left.join(F.broadcast(hot.drop("n")), on)
    return near.unionByName(left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def repeated_spans(docs: DataFrame, key: str = "doc_id", mode: str = "every", min_len: int = MIN_LEN, gram: int | None = None, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(staged, spans): staged has row, the columns of docs but text, z (the text, compressed), n_bytes and sha; spans has row and
    an array of (lo, hi) byte ranges for rows that have any, of mode every (all copies), later (all but the first) or both: `every`, `later`."""
    kinds = {"every": [EVERY], "later": [LATER], "both": [EVERY, LATER]}[mode]
    staged = publish(_stage(docs, min_len, gram or min_len * 5 // 8), "staged")
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    shared = staged.select(F.explode("occs.h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    occs = staged.select("row", order.alias("ord"), F.explode("occs").alias("x")).select("row", "ord", "x.*")
    occs = publish(_shared_join(occs, shared, ["h"]).select("row", "ord", "h", "g", "lo", "hi"), "shared-owners")
    distinct = occs.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("ord", "row", "lo", "hi")).alias("first"))
    distinct = publish(distinct, "pieces")
    groups = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    ends = publish(_shared_join(distinct, groups.withColumn("n_g", F.col("n")), ["h"]).select("h", "g", "first.*", "n_g"), "ends")
    small, large = ends.where(F.col("n_g") <= group).drop("n_g"), ends.where(F.col("n_g") > group).drop("n_g")
    found = _resolve(_fetch(staged, small, min_len), min_len)
    if large.limit(1).count():
        found = found.unionByName(_resolve_large(_fetch(staged, large, min_len), min_len))
    found = publish(found, "matched")
    discard(ends)
    status = distinct.join(found, ["h", "g"], "left").where("c > 1 or r0 is not null").select("h", "g", F.col("c").alias("n"), "c", F.col("first.row").alias("f_row"), F.col("first.lo").alias("f_lo"), "r0", "r1")
    hits = _shared_join(occs, status, ["h", "g"])
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("z")))
    first = (F.col("row") == F.col("f_row")) & (F.col("lo") == F.col("f_lo"))
    runs = {EVERY: F.when(F.col("c") > 1, whole).otherwise(F.col("r0")), LATER: F.when(first, F.col("r1")).otherwise(whole)}

    def placed(k: int) -> Column:
        found = F.coalesce(runs[k], F.array().cast("array<struct<a:int,z:int>>"))
        return F.transform(found, lambda r: F.struct(F.lit(k).alias("kind"), (F.col("lo") + r["a"]).alias("lo"), (F.col("lo") + r["z"] + min_len).alias("hi")))

    ranges = hits.select("row", F.explode(F.concat(*map(placed, kinds))).alias("s"))
    spans = publish(ranges.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans")), "spans")
    discard(occs, distinct, found)
    of = lambda k: F.transform(F.filter("spans", lambda s: s["kind"] == k), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))
    return staged, spans.select("row", *[of(k).alias(("every", "later")[k]) for k in kinds])


def _united(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return out


def _without(text: bytes, spans: list[list[int]], whole_chars: bool = False) -> bytes:
    kept, at = [], 0
    for lo, hi in spans:
        if whole_chars:  # a character cut by an end stays
            while lo < hi and text[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                hi -= 1
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def longer_spans(staged: DataFrame, spans: DataFrame, length: int = MIN_LEN) -> DataFrame:
    """(row, longer): ranges of all copies of strings of `length` bytes, found among the `every` ranges of a shorter length: a long string that repeats lies
    within one of these as a whole."""
    held = staged.select("row", "z").join(spans.select("row", "every"), "row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for big in batches:
            for at in range(0, big.num_rows, 200):
                out: list[list] = [[], [], []]
                for r in big.slice(at, 200).to_pylist():
                    long = [s for s in _united(r["every"]) if s[1] - s[0] >= length]
                    text = unpack.decompress(r["z"]) if long else b""
                    for lo, hi in long:
                        for c, v in zip(out, (r["row"], lo, text[lo:hi]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["of", "from", "text"])

    passages, found = repeated_spans(held.mapInArrow(each, "of bigint, from int, text binary"), "of", "every", length)
    ranges = passages.select("row", "of", "from").join(found, "row").select(F.col("of").alias("row"), F.explode(F.transform("every", lambda s: F.struct((F.col("from") + s["lo"]).alias("lo"), (F.col("from") + s["hi"]).alias("hi")))).alias("s"))
    out = publish(ranges.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("longer")), "longer")
    discard(passages)
    return out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, of strings of MIN_LEN bytes; and `text`, what a cleaning step leaves: without passages of PASSAGE bytes that an
    earlier document (or place) has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    staged, spans = repeated_spans(docs, mode="both", min_len=PASSAGE)
    both = staged.select("row", "doc_id", "z", "n_bytes", "sha").join(spans.select("row", "later"), "row", "left").join(longer_spans(staged, spans), "row", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                removed, n_spans, shas, texts = [], [], [], []
                for z, sha, later, longer in zip(b.column("z"), *(b.column(c).to_pylist() for c in ("sha", "later", "longer")), strict=True):
                    text, cut = unpack.decompress(z.as_py()), _united(longer)
                    removed.append(sum(hi - lo for lo, hi in cut))
                    n_spans.append(len(cut))
                    shas.append(hashlib.sha256(_without(text, cut)).hexdigest() if cut else sha)
                    texts.append(_without(text, _united(later), whole_chars=True).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas), pa.array(texts, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return both.drop("row").mapInArrow(each, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")


def deduplicate(docs: DataFrame, mode: str = "later", min_len: int = PASSAGE, key: str = "doc_id") -> DataFrame:
    """docs with repeated passages (mode every: all copies, later: all but the first) cut out of text (whole characters only); every row stays,
    and other columns pass through. n_chars, where docs has it, follows the text."""
    names = [c for c in docs.columns if c not in (key, "text")]
    rest = F.struct(*names) if names else F.struct(F.lit(0).alias("_"))
    staged, spans = repeated_spans(docs.select(key, "text", rest.alias("_rest")), key, mode, min_len)
    both = staged.select("row", key, "z", "_rest").join(spans, "row", "left").drop("row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts = []
            for z, s in zip(b.column("z"), b.column(mode).to_pylist(), strict=True):
                text = unpack.decompress(z.as_py())
                texts.append(_without(text, _united(s), whole_chars=True).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_rest"), pa.array(texts, pa.string())], names=[key, "_rest", "text"])

    out = both.mapInArrow(each, StructType([both.schema[key], both.schema["_rest"], docs.schema["text"]]))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", F.length("text").cast(kind)))
    return out.select(*[F.col(c) if c in (key, "text") else F.col("_rest")[c].alias(c) for c in docs.columns])
