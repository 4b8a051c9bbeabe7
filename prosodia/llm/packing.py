"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Texts become ids and an end id; longer ones are cut into pieces of the capacity, a shorter rest first.
Only piece lengths matter to packing, and there are at most `capacity` of them. So the plan is made on
the histogram of lengths, whose size does not grow with the data: fill a bin greedily with the
longest length that fits, then, while a gap is left, replace the bin's smallest piece with two unpacked ones
that fit the expanded gap more tightly; then use the same bin as often as the counts allow.

The k-th piece of a length takes the plan's k-th place of that length. Its rank is the number
of such pieces in earlier partitions (a running sum over a small table of counts) and before it in its own,
so no task sees all pieces of a length, however common it is.

Defined results: a null or empty text is a single piece with the end id; repeated rows and null ids are packed
each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Memory, byte_letters, default_path
from .common import publish, release_memory

CAPACITY, END = 1024, 2
#: Pre-tokens remembered in each of two generations by a worker.
REMEMBERED = 100_000
_ENCODERS: dict = {}


def encoder(path: str):
    """Text to ids as little-endian unsigned 32-bit numbers; pre-tokens are remembered. A vocabulary whose ids follow its merges
    goes to tiktoken, which gives the tokenizers library's ids in a fraction of the time and memory; any other to that library."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        if all(vocab[a + b] == 256 + rank for rank, (a, b) in enumerate(pairs)):
            import tiktoken

            letters = byte_letters()
            plain = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocab.items()}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            plain = lambda w: t.encode(w, add_special_tokens=False).ids
        del spec, vocab, pairs
        known = Memory(lambda w: np.array([special[w]] if w in special else plain(w), "<u4").tobytes(), REMEMBERED)
        cut, get = regex.compile(PATTERN).findall, known.__getitem__
        parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

        def ids(text: str) -> bytes:
            if parts and any(s in text for s in special):
                return b"".join(get(w) for p in parts(text) for w in ([p] if p in special else cut(p)))
            return b"".join(map(get, cut(text)))

        _ENCODERS[path] = ids
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, nth): nth counts the pieces of a length in a partition."""
    last = np.array([end], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        ids, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for r, x in enumerate(b.column("_text")):
                raw = ids(x.as_py() or "") + last
                n = len(raw) // 4
                lo = 0
                for p in range(-(-n // capacity)):
                    hi = lo + ((n - 1) % capacity + 1 if p == 0 else capacity)
                    row.append(r)
                    piece.append(p)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(raw[4 * lo : 4 * hi]))
                    nth.append(seen[hi - lo])
                    seen[hi - lo] += 1
                    lo = hi
            cols = [b.column(key).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").alias("_text")).mapInArrow(each, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, number of such bins)] using up all counts of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return out
        held, free = [top], left.copy()
        free[top] -= 1
        gap = capacity - top
        while gap:
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            held.append(n := int(fits[-1]) + 1)
            free[n] -= 1
            gap -= n
        while gap and len(held) > 1:
            small = min(held)
            room, best = gap + small, (small, 0, 0)
            some = np.flatnonzero(free[: room + 1])
            for a in some[::-1]:
                if 2 * a <= best[0]:
                    break
                others = some[: np.searchsorted(some, min(int(a), room - int(a)), side="right")]
                b = 0
                for o in others[::-1]:
                    if o != a or free[a] > 1:
                        b = int(o)
                        break
                if b and a + b > best[0]:
                    best = (int(a) + b, int(a), b)
                if best[0] == room:
                    break
            if not best[1]:
                break
            held.remove(small)
            held += best[1:]
            free[small] += 1
            free[best[1]] -= 1
            free[best[2]] -= 1
            gap = room - best[0]
        lengths, uses = np.unique(held, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        out.append((sorted(held, reverse=True), times))


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for held, times in bins:
        at = 0
        for n in held:
            runs.setdefault(n, []).append((used.get(n, 0), first, at))
            used[n] = used.get(n, 0) + times
            at += n
        first += times
    return {n: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for n, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. `cut` has length, part and nth and must be read from storage, so that
    parts keep their rows."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan_bins(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    from pyspark.sql.types import LongType, StructField, StructType

    keep = [f for f in ranked.schema.fields if f.name != "rank"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                lo, first, offset = where[int(n)]
                run = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at] = first[run] + rank[at] - lo[run]
                off[at] = offset[run]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(seq), pa.array(off)], names=[f.name for f in keep] + ["sequence_id", "offset"])

    return ranked.mapInArrow(each, StructType([*keep, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    cut = publish(pieces(docs, path or default_path(), capacity=capacity, end=end), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
