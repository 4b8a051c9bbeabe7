"""Generated works as a null model, and what they say about the rhymes of real ones."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prosodia.functions import phonology as P
from prosodia.functions import rhyme as R
from prosodia.functions import statistics as S
from prosodia.functions import walk as W
from prosodia.functions.generate import Listed, Source

from . import rhyme

GENERATED = "replicate bigint, line_idx int, metre string, words array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>"

FIELDS = ["metre", "text", "sy", "wb", "mf"]
#: Lines that one task makes, if all works of a source have no more.
SHORT = 10_000
#: Tasks to a part of a source, so that few parts meet in one.
ROOM = 16


def sounded(text: str | None, sy: str | None, wb: str | None, mf: str | None) -> str:
    """The sounds of a word of a line by itself; its letters, where no reading fits."""
    w = P.line_words([{"text": text, "sy": sy, "wb": wb, "mf": None if mf == "SY" else mf}])[0]
    return P.phonemic(w) or P.PUNCT.sub("", (text or "").lower())


def source_words(lines: DataFrame, by: str) -> DataFrame:
    """(by, words): distinct words (metre, text, sy, wb, mf) of a source's lines, packed where they are, in several rows a source."""
    ws = lines.select(by, "metre", F.explode("words").alias("w")).select(by, "metre", "w.text", "w.sy", "w.wb", "w.mf").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            own, at = pc.unique(t.column(by)), t.column(by)
            cols = {k: t.column(k) if k == "text" else pc.dictionary_encode(t.column(k)) for k in FIELDS}
            made = [_written(pa.table(cols).filter(pc.equal(at, x))) for x in own]
            yield pa.RecordBatch.from_arrays([own, pa.array(made, pa.binary())], names=[by, "words"])

    return ws.mapInArrow(packed, f"`{by}` {lines.schema[by].dataType.simpleString()}, words binary")


def _listed(blobs: list[bytes]) -> dict[str, Source]:
    """Sources by metre of packed words, in order of their columns however they were dealt. A word is made, and its sounds worked out, when it is drawn."""
    t = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
    cols, key = {}, np.zeros(t.num_rows, np.int64)
    for k in FIELDS:
        d = t.column(k)
        d = (d.dictionary_encode() if k == "text" else pa.chunked_array(d.chunks, d.type).unify_dictionaries()).combine_chunks()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        number = d.indices.fill_null(-1).to_numpy().astype(np.int64)
        rank = np.zeros(len(d.dictionary) + 1, np.int64)  # nulls first
        rank[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(1, len(rank))
        cols[k], key = (d.dictionary, number), key * len(rank) + rank[number]
    begins = [(x or "")[:2] for x in cols["sy"][0].to_pylist()] + [""]
    codes = {c: i for i, c in enumerate(sorted(set(begins)))}
    first, metre = np.array([codes[c] for c in begins])[cols["sy"][1]], cols["metre"][1]
    order = np.lexsort((key, first, metre))
    cut = np.flatnonzero(np.append(True, (np.diff(first[order]) != 0) | (np.diff(metre[order]) != 0))) if len(order) else []
    known: dict[int, dict] = {}

    def word(row: int) -> dict:
        if row not in known:
            w = {k: cols[k][0][int(cols[k][1][row])].as_py() if cols[k][1][row] >= 0 else None for k in FIELDS[1:]}
            known[row] = {**w, "text": w["text"] or "", "sy": w["sy"] or "", "sound": sounded(*w.values())}
        return known[row]

    names, found = [*codes], {}
    for lo, hi in zip(cut, [*cut[1:], len(order)], strict=True):
        row = order[lo]
        m = cols["metre"][0][int(metre[row])].as_py() if metre[row] >= 0 else None
        found.setdefault(m, {})[names[first[row]]] = Listed(order[lo:hi], word)
    return {m: Source(by, m) for m, by in found.items()}


def generate(lines: DataFrame, n: int, seed: int, by: str, elegiac: bool = False, lines_each: int | None = None, parts: int = 4) -> DataFrame:
    """(by, replicate, line_idx, metre, words): n works of random lines (couplets if elegiac) for each source `by`, as long as the source unless lines_each says
    otherwise. A line's words come from all distinct words of its source. Replicates have seeds of their own and are dealt in `parts` tasks a source (one, if all
    works are short); each reads its source's words, which are kinds of words and not lines, and sounds those that are drawn."""
    keep = lines.where("metre = 'H'") if not elegiac else lines
    words = source_words(keep.where(F.col(by).isNotNull()), by)
    kind = lines.schema[by].dataType.simpleString()
    if lines_each is None:
        words = words.join(lines.groupBy(by).agg(F.count("*").alias("_size")), by)
    parts = 1 if lines_each is not None and n * lines_each <= SHORT else max(1, min(parts, n))
    # the lines are read once; parts that make nothing read nothing
    left = words.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    word = pa.struct([("idx", pa.int32()), *((k, pa.string()) for k in ("text", "sy", "wb", "mf"))])
    own = to_arrow_type(lines.schema[by].dataType)

    def each(key: tuple, table: pa.Table) -> pa.Table:
        source_name, part = key[0].as_py(), key[1].as_py()
        count = lines_each if lines_each is not None else table.column("_size")[0].as_py()
        have, batches = _listed(table.column("words").to_pylist()), []
        for rep in range(part, n, parts):
            rng, place, metre, ends, idx = random.Random(f"{seed}:{source_name}:{rep}"), [], [], [0], []
            cols: dict[str, list] = {k: [] for k in ("text", "sy", "wb", "mf")}
            for i in range(2 * round(count / 2) if elegiac else count):
                m = "HP"[i % 2] if elegiac else "H"
                line = have[m].line(rng) if m in have else None
                if line is not None:
                    place.append(i)
                    metre.append(m)
                    idx += range(len(line))
                    ends.append(len(idx))
                    for w in line:
                        for k, c in cols.items():
                            c.append(w[k])
            words_ = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), *(pa.array(c, pa.string()) for c in cols.values())], fields=list(word))
            batches.append(pa.RecordBatch.from_arrays([pa.array([source_name] * len(place), own), pa.array([rep] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(metre, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words_)], names=[by, "replicate", "line_idx", "metre", "words"]))
        empty = pa.schema([(by, own), ("replicate", pa.int64()), ("line_idx", pa.int32()), ("metre", pa.string()), ("words", pa.list_(word))])
        return pa.Table.from_batches(batches, empty if not batches else None)

    return left.groupBy(by, "_part").applyInArrow(each, f"`{by}` {kind}, {GENERATED}")


def alone(text: str, syllables: int, mf: str | None) -> str:
    """The sounds of a word by itself; its letters, where no reading fits."""
    w = P.line_words([{"text": text, "sy": "1b" * syllables, "wb": None, "mf": mf}])[0]
    return P.phonemic(w) or P.PUNCT.sub("", text.lower())


def _numbered(column: pa.ChunkedArray | pa.Array) -> tuple[list, np.ndarray]:
    """Distinct values of a column, and their numbers by row."""
    d = pc.dictionary_encode(pc.fill_null(column, ""))
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _hashed(xs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf8", "surrogatepass"), digest_size=8).digest(), "little") for x in xs], np.uint64)


_KIND = pa.struct([("n", pa.int32()), ("np", pa.int32()), *((p, pa.struct([(k, pa.string()) for k in ("onset", "nucleus", "coda", "vowel")])) for p in "sf")])


def _written(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _digest(t: pa.Table, word: Callable[[str], dict], needed: bool) -> tuple[bytes, bytes]:
    """(words, kinds) of a source's distinct words: what the walk and the rhymes have to know of them. needed: of all words, not only last and middle ones."""
    texts, text = _numbered(t.column("text"))
    sys_, sy = _numbered(t.column("sy"))
    mfs, mf = _numbered(t.column("mf"))
    metres, metre = _numbered(t.column("metre"))
    syllables = np.array([len(s) // 2 for s in sys_])
    asked, of = np.unique((text * len(mfs) + mf) * 64 + np.minimum(syllables[sy], 63), return_inverse=True)
    told = [alone(texts[(k >> 6) // len(mfs)], k & 63, mfs[(k >> 6) % len(mfs)] or None) for k in asked.tolist()]
    sounds, sound = _numbered(pa.array(told, pa.string()))
    sound = sound[of]
    both = lambda a, n, b, f: (lambda u, i: np.array([f(*divmod(k, n)) for k in u.tolist()], np.int8)[i])(*np.unique(a * n + b, return_inverse=True))
    letters, first_open = np.array([bool(W.LETTER.search(x)) for x in texts]), np.array([x[:1] != "" and x[0] in W.BEGINS_OPEN for x in sounds])
    prodelided = np.array([m == "PE" for m in mfs])[mf]
    begins = np.where(~letters[text], W.NEVER, np.where(prodelided, W.PE, np.where(first_open[sound], 0, 1))).astype(np.int8)
    last_sounds, last_sound = _numbered(pa.array([x[-1:] for x in sounds], pa.string()))
    ends = both(sy * len(mfs) + mf, len(last_sounds), last_sound[sound], lambda a, b: W.closing(sys_[a // len(mfs)], last_sounds[b], mfs[a % len(mfs)] or None))
    codes = np.array([W.codes(s) for s in sys_], np.int8)[sy]
    middle = np.array([s.endswith(("3A", "3b")) for s in sys_])[sy]
    kind = np.full(len(text), -1, np.int64)
    some = np.flatnonzero(middle | np.array([s[-1:] == "X" for s in sys_])[sy]) if not needed else np.arange(len(text))
    had, at = np.unique(text[some], return_inverse=True)
    made = [word(texts[i]) for i in had.tolist()]
    keys = {}
    number = np.array([keys.setdefault(json.dumps(m), len(keys)) for m in made], np.int64)
    kind[some] = number[at] if len(some) else 0
    kinds = pa.table({"kind": pa.array([json.loads(k) for k in keys], _KIND), "hash": pa.array(_hashed(list(keys)), pa.uint64())})
    metre_of = pa.array(np.array(metres, object)[metre] if len(metre) else [], pa.string()).dictionary_encode()
    words = pa.table({"metre": metre_of, "first": codes[:, 0], "last": codes[:, 1], "begins": begins, "ends": ends, "sound": _hashed(sounds)[sound], "kind": kind.astype(np.int32), "middle": middle})
    return _written(words), _written(kinds)


def _source(blobs: list[tuple[bytes, bytes]]) -> tuple[dict[str, W.Walk], W.Ends]:
    """Walks by metre and the words' kinds, the same however the words were dealt."""
    read = lambda raw: pa.ipc.open_stream(raw).read_all()
    words, kinds, hashes, base = [], [], [], 0
    for a, b in blobs:
        w, k = read(a), read(b)
        at = w.column("kind").to_numpy().astype(np.int64)
        words.append((w, np.where(at < 0, -1, at + base)))
        kinds += k.column("kind").combine_chunks().chunks if isinstance(k.column("kind").combine_chunks(), pa.ChunkedArray) else [k.column("kind").combine_chunks()]
        hashes.append(k.column("hash").to_numpy())
        base += k.num_rows
    kind = np.concatenate([k for _, k in words])
    cols = {c: np.concatenate([w.column(c).to_numpy() for w, _ in words]) for c in ("first", "last", "begins", "ends", "sound", "middle")}
    metre = np.concatenate([np.asarray(w.column("metre").cast(pa.string()).to_numpy(zero_copy_only=False)) for w, _ in words])
    h, u = np.append(np.concatenate(hashes), np.uint64(0))[kind], np.uint64
    key = cols["sound"] * u(0x9E3779B97F4A7C15) ^ h * u(0xD6E8FEB86659FD93)
    for c in ("first", "last", "begins", "ends"):
        key = key * u(0x100000001B3) + cols[c].astype(np.uint64)
    walks, of, middle = {}, {}, {}
    for m in "HP":
        rows = np.flatnonzero(metre == m)
        if len(rows):
            # in the order that they are drawn in
            rows = rows[np.lexsort((key[rows], W.group(cols["first"][rows], cols["begins"][rows])))]
            sound = np.unique(cols["sound"][rows], return_inverse=True)[1].astype(np.int32)
            walks[m] = W.Walk(m, *(cols[c][rows] for c in ("first", "last", "begins", "ends")), sound)
            walks[m].rows = rows
            of[m], middle[m] = kind[rows].astype(np.int32), cols["middle"][rows]
    return walks, W.Ends(pa.concat_arrays(kinds) if kinds else pa.array([], _KIND), of, middle)


def generated_hits(lines: DataFrame, n: int, seed: int, by: str, tests: dict, word: Callable[[str], dict] = R.toy, elegiac: bool = False, metre: str = "H", threshold: float = R.THRESHOLD, parts: int = 16) -> DataFrame:
    """(by, replicate, test, t, f): rhyme.scan over n generated works of each source `by`, each as long as the source (see generate), made and counted in one task
    with words as places in arrays. Lines are read once: a source's words are digested where they are (their codes, how they begin and end, the
    numbers of their sounds and rhymes), and only that is sent, `parts` times. A work depends on its seed and on the source's words."""
    kind = lines.schema[by].dataType.simpleString()
    needed = any(p in ("first", "penult") for x in tests.values() for y in x for p in (y[1], y[3]))
    ws = lines.where(F.col(by).isNotNull()).select(by, "metre", F.posexplode_outer("words").alias("_i", "w")).select(by, "metre", "w.text", "w.sy", "w.wb", "w.mf", (F.coalesce("_i", F.lit(0)) == 0).cast("long").alias("_n"))
    ws = ws.repartition("text").groupBy(by, "metre", "text", "sy", "wb", "mf").agg(F.sum("_n").alias("_n"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            own, at = pc.unique(t.column(by)), t.column(by)
            for name in own.to_pylist():
                mine = t.filter(pc.equal(at, pa.scalar(name, own.type)))
                size = pc.sum(mine.column("_n")).as_py()
                mine = mine.filter(pc.is_valid(mine.column("sy"))) if elegiac else mine.filter(pc.and_(pc.is_valid(mine.column("sy")), pc.equal(mine.column("metre"), "H")))
                words, kinds = _digest(mine, word, needed)
                yield pa.RecordBatch.from_arrays([pa.array([name], own.type), pa.array([size], pa.int64()), pa.array([words], pa.binary()), pa.array([kinds], pa.binary())], names=[by, "_n", "words", "kinds"])

    packed = ws.mapInArrow(digested, f"`{by}` {kind}, _n bigint, words binary, kinds binary")
    parts = max(1, min(parts, n))
    # small bytes and long work: Spark would put many parts into one task
    left = packed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(ROOM * parts, by, "_part")
    own = to_arrow_type(lines.schema[by].dataType)

    def each(key: tuple, table: pa.Table) -> pa.Table:
        name, part = key[0].as_py(), key[1].as_py()
        count = pc.sum(table.column("_n")).as_py()
        walks, ends = _source(list(zip(table.column("words").to_pylist(), table.column("kinds").to_pylist(), strict=True)))
        rows: list[tuple] = []
        for rep in range(part, n, parts):
            rng = np.random.default_rng(list(hashlib.sha256(f"{seed}:{name}:{rep}".encode()).digest()))
            for test, (t, f) in W.work_hits(walks, ends, 2 * round(count / 2) if elegiac else count, elegiac, rng, tests, metre, threshold).items():
                if t + f:
                    rows.append((rep, test, t, f))
        a = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({by: pa.array([name] * len(rows), own), "replicate": pa.array(a[0], pa.int64()), "test": pa.array(a[1], pa.string()), "t": pa.array(a[2], pa.int64()), "f": pa.array(a[3], pa.int64())})

    return left.groupBy(by, "_part").applyInArrow(each, f"`{by}` {kind}, replicate bigint, test string, t bigint, f bigint")


def bootstrap_ci(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, l99 ... h99): order statistics of column t over replicates."""
    rows = hits.groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("a"))
    cols = {}
    for p in (0.9, 0.95, 0.99):
        low, mid, high = S.order_interval(F.col("a"), p)
        cols |= {f"l{round(100 * p)}": low, "mid": mid, f"h{round(100 * p)}": high}
    return rows.select(*by, *[c.alias(n) for n, c in cols.items()])


def examinate(observed: DataFrame, intervals: DataFrame, baselines: DataFrame, by: list[str]) -> DataFrame:
    """observed(by, t, f) against intervals of generated works and baselines(by, rate): share of the middle, stars, expected hits, and the exact
    one-sided test. A missing or zero baseline is a half."""
    j = observed.join(intervals, by).join(baselines, by, "left").withColumn("rate", F.coalesce(F.nullif("rate", F.lit(0.0)), F.lit(0.5)))
    s = S.stars(F.col("t"), [F.col("l90"), F.col("l95"), F.col("l99")], F.col("mid"), [F.col("h90"), F.col("h95"), F.col("h99")])
    j = j.withColumns({"pi": F.col("t") / F.nullif("mid", F.lit(0)), "stars": F.repeat(F.lit("*"), s), "sum": F.col("t") + F.col("f")})
    j = j.withColumns({"expected": F.round(F.col("sum") * F.col("rate")).cast("long"), "alternative": F.when(F.col("t") >= F.col("sum") * F.col("rate"), "greater").otherwise("less")})

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series, p: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series([S.binomial_tail(int(a), int(b), float(c), d) for a, b, c, d in zip(t, n, p, alt, strict=True)], dtype=float)

    j = j.withColumn("binom", tail("t", "sum", "rate", "alternative"))
    if "rate_low" not in baselines.columns:
        return j
    # against the bound of the baseline that is nearer to what was seen
    outer = F.when(F.col("alternative") == "greater", F.col("rate_high")).otherwise(F.col("rate_low"))
    return j.withColumn("conservative", tail("t", "sum", F.coalesce(F.nullif(outer, F.lit(0.0)), F.lit(0.5)), "alternative"))


def baselines(ends: DataFrame, position: str, by: list[str], other: str | None = None, within: str | None = None) -> DataFrame:
    """(by, rate): how often words at `position` rhyme by chance, times how often they are there. within H or P: pairs of lines of one metre (presence
    squared); None: words of hexameters with those of pentameters (the product); other: the line's own word there (presence once). Zero is null."""
    word = lambda df, p: df.select(*by, F.col(f"ends.{p}").alias("word"))
    share = lambda df, name: df.groupBy(*by).agg((F.count(f"ends.{position}") / F.count("*")).alias(name))
    if other:
        rate, there = rhyme.rate(word(ends, position), word(ends, other), by), share(ends, "p").withColumn("q", F.lit(1.0))
    elif within:
        rows = ends.where(F.col("metre") == within)
        rate, there = rhyme.rate(word(rows, position), None, by), share(rows, "p").withColumn("q", F.col("p"))
    else:
        h, p = ends.where("metre = 'H'"), ends.where("metre = 'P'")
        rate, there = rhyme.rate(word(h, position), word(p, position), by), share(h, "p").join(share(p, "q"), by)
    made = F.col("hits") / F.nullif("tries", F.lit(0)) * F.col("p") * F.col("q")
    return there.join(rate, by, "left").select(*by, F.nullif(made, F.lit(0.0)).alias("rate"))


def baselines_of(ends: DataFrame, by: list[str], asked: dict[str, tuple]) -> DataFrame:
    """(by, baseline, rate): baselines() for several pairs of positions (as rhyme.rates_of has them), from lines that are read once. Where a side is all lines, its
    presence counts once."""
    found = rhyme.rates_of(ends, by, asked)
    once = F.col("name").isin([k for k, x in asked.items() if x[0] is None])
    made = F.col("hits") / F.nullif("tries", F.lit(0)) * (F.col("there") / F.col("lines")) * F.when(once, F.lit(1.0)).otherwise(F.col("there2") / F.col("lines2"))
    return found.select(*by, F.col("name").alias("baseline"), F.nullif(made, F.lit(0.0)).alias("rate"))


def rate_bounds(one: DataFrame, other: DataFrame, by: list[str], n: int, each: int, seed: int, p: float = 0.95) -> DataFrame:
    """(by, rate, rate_low, rate_high): order statistics of n sampled rates of `each` pairs."""
    drawn = rhyme.sampled_rates(one, other, by, n, each, seed)
    found = drawn.withColumn("r", F.col("hits") / F.col("tries")).groupBy(*by).agg(F.sort_array(F.collect_list("r")).alias("a"))
    low, mid, high = S.order_interval(F.col("a"), p)
    return found.select(*by, mid.alias("rate"), low.alias("rate_low"), high.alias("rate_high"))


def vectorise(examined: DataFrame, columns: list[str], by: list[str], sizes: DataFrame) -> DataFrame:
    """One row a work (by): a column a metre and test with the share of the middle, and `size`. A work of hexameters alone has them for its pentameters
    too."""
    # one pass: `examined` may be costly, and a second reader would work it out anew
    name = F.concat(F.col("metre"), F.lit("-"), F.col("test"))
    cells = [F.first(F.when(name == c, F.col("pi")), ignorenulls=True).alias(c) for c in columns]
    out = examined.groupBy(*by).agg(*cells, F.max(F.col("metre") == "P").alias("_p"))
    twice = {c: F.coalesce(F.col(f"`{c}`"), F.col(f"`H{c[1:]}`")) for c in columns if c[0] == "P" and f"H{c[1:]}" in columns}
    for c, v in twice.items():
        out = out.withColumn(c, F.when(F.col("_p"), F.col(f"`{c}`")).otherwise(v))
    return out.drop("_p").join(sizes.select(*by, "size"), by)


def vector(examined: DataFrame, columns: list[str], by: str = "work") -> DataFrame:
    """One row a work, a column a metre and test: the share of the middle."""
    return examined.withColumn("_k", F.concat(F.col("metre"), F.lit("-"), F.col("test"))).groupBy(by).pivot("_k", columns).agg(F.first("pi"))
