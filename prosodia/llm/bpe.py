"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

A text is cut into special tokens and pre-tokens; each pre-token starts as its bytes' symbols,
linked both ways. The queue holds (rank, place, left, right) for every mergeable neighbour pair;
the least is taken first, leftmost among equals, and an entry whose symbols have changed since is
stale and skipped. A merge links the new symbol in place and queues its two new pairs, so a pre-token
of n bytes takes O(n log n). Decoding concatenates the vocabulary's byte strings.

Defined results: null is empty, and an empty text has no ids; repeated rows each get a row;
null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of byte-level vocabularies: the pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pre-tokens remembered in each of two generations by a worker.
REMEMBERED = 350_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memory(dict):
    """What `make` gave for a key, kept for two generations of bounded size."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.first = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.first[b[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.remembered = Memory(self.word)

    def word(self, pretoken: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.first[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n, known = len(symbols), self.merges
        if n == 1:
            return symbols
        queue = []
        for i in range(n - 1):
            found = known.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, left, right, merged = pop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = known.get((merged, symbols[k]))
                if found:
                    push(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = known.get((symbols[h], merged))
                if found:
                    push(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.cut(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else self.cut(part)
        return out

    def ids(self, pretoken: str) -> list[int]:
        return [self.specials[pretoken]] if pretoken in self.specials else self.remembered[pretoken]

    def encode(self, text: str) -> list[int]:
        return [i for t in self.pretokens(text) for i in self.ids(t)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of column text as array<int>."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    keep = [f for f in df.schema.fields if f.name != out]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(x.as_py() or "") for x in b.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [ids], names=[f.name for f in keep] + [out])

    return df.select(*[f.name for f in keep]).mapInArrow(each, StructType([*keep, StructField(out, ArrayType(IntegerType()))]))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of column ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    keep = [f for f in df.schema.fields if f.name != out]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = pa.array([c.decode(x.as_py() or []) for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [texts], names=[f.name for f in keep] + [out])

    return df.select(*[f.name for f in keep]).mapInArrow(each, StructType([*keep, StructField(out, StringType())]))


def round_trip_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) in one pass, without moving ids out of the worker. Ids are kept
    as their decimal strings here, which are what is hashed, and decoded from these."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        if not hasattr(c, "decimal"):
            c.decimal = Memory(lambda t: ",".join(map(str, [c.specials[t]] if t in c.specials else c.word(t))).encode())
            c.of_decimal = {str(i).encode(): b for i, b in c.bytes_of.items()}
        get, back = c.decimal.__getitem__, c.of_decimal.__getitem__
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column("_text"):
                joined = b",".join(map(get, c.pretokens(x.as_py() or "")))
                parts = joined.split(b",") if joined else []
                n.append(len(parts))
                ids.append(hashlib.sha256(joined).hexdigest())
                texts.append(hashlib.sha256(b"".join(map(back, parts)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInArrow(each, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
