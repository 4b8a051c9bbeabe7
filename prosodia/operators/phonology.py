"""Syllables, sounds and tensors of lines, in Arrow batches. Elision needs a line's neighbours, so a line's words stay together in
one row and nothing is shuffled. Each kind of word (or run of elided words) of a batch is worked out once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from prosodia.functions import phonology as P
from prosodia.functions import space

SYL = "struct<raw:string,onset:string,nucleus:string,coda:string,main_vowel:string,stressed:boolean>"
SYL_WORDS = f"array<struct<pre_punct:string,syls:array<{SYL}>,post_punct:string,stress_idx:int,error:string>>"
_SYL = pa.struct([(n, pa.string()) for n in ("raw", "onset", "nucleus", "coda", "main_vowel")] + [("stressed", pa.bool_())])
_WORD = pa.struct([("pre_punct", pa.string()), ("syls", pa.list_(_SYL)), ("post_punct", pa.string()), ("stress_idx", pa.int32()), ("error", pa.string())])


def _with(lines: DataFrame, fields: str, make) -> DataFrame:
    """lines without words, and the columns that make() gives for a batch's words."""
    keep = [f for f in lines.schema.fields if f.name != "words"]
    more = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in more]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(f.name) for f in keep] + [c if c.type == t else c.cast(t) for c, t in zip(make(b.column("words")), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in [*keep, *more]])

    return lines.mapInArrow(each, StructType([*keep, *more]))


def _mapped(lines: DataFrame, fields: str, make) -> DataFrame:
    """lines without words, and the columns that make() gives for a row's words."""
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(fields)]

    def batch(column: pa.Array) -> list[pa.Array]:
        made = [make(ws or []) for ws in column.to_pylist()]
        return [pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)]

    return _with(lines, fields, batch)


#: Fields of a word that its value may depend on, and runs of words that a worker remembers.
FIELDS = ("text", "sy", "wb", "mf")
REMEMBERED = 1 << 16


class Valued:
    """A batch's words by what a function gives for them. Only elision and prodelision reach over to another word, so words are worked out by the runs
    that these join, each kind of run once: value(raw words, words) gives as many values as the run has words."""

    def __init__(self, column: pa.Array, value):
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        #: Where each line's words begin, and the words' end.
        self.ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.words = column.flatten()
        self.columns = {f: pc.struct_field(self.words, f) for f in FIELDS}
        n, key, mf = len(self.words), np.zeros(len(self.words), np.int64), None
        for f, c in self.columns.items():
            d = c.dictionary_encode(null_encoding="encode")
            at = d.indices.to_numpy(zero_copy_only=False)
            key = key * max(1, len(d.dictionary)) + at
            if f == "mf":
                mf = [np.array([x == k for x in d.dictionary.to_pylist()] or [False], bool)[at] for k in ("SY", "PE")]
            if f == "sy":
                self.sy, self.sy_kinds = at, d.dictionary.to_pylist()
        kind, found = pd.factorize(key)
        place = np.zeros(len(found), np.int64)
        place[kind[::-1]] = np.arange(n)[::-1]
        raws = list(zip(*(c.take(pa.array(place)).to_pylist() for c in self.columns.values()), strict=True))
        start = np.zeros(n + 1, bool)
        start[self.ends] = True
        start[1:n] |= ~(mf[0][:-1] | mf[1][1:])
        start[:1] = True
        #: The number of each word's value.
        self.of, self.values = np.zeros(n, np.int64), []
        number, alone = np.zeros(len(found), np.int64), start[:-1] & start[1:]
        for k in np.unique(kind[alone]).tolist():
            number[k] = len(self.values)
            self.values += value((raws[k],))
        self.of[alone] = number[kind[alone]]
        heads = np.flatnonzero(start[:-1] & ~start[1:])
        tails = np.flatnonzero(start)
        tails = tails[np.searchsorted(tails, heads, "right")] if len(heads) else heads
        runs, listed = {}, kind.tolist()
        for lo, hi in zip(heads.tolist(), tails.tolist(), strict=True):
            run = tuple(listed[lo:hi])
            if run not in runs:
                runs[run] = len(self.values)
                self.values += value(tuple(raws[k] for k in run))
            self.of[lo:hi] = np.arange(runs[run], runs[run] + hi - lo)

    def column(self, values: list, kind: pa.DataType, places: np.ndarray | None = None) -> pa.Array:
        """A value for each word, or for the words at places (null: -1); values are those of the kinds."""
        of = self.of if places is None else np.where(places < 0, -1, self.of[np.maximum(places, 0)] if len(self.of) else -1)
        return pa.array(values, kind).take(pa.array(of, mask=of < 0))

    def lists(self, column: pa.Array, ends: np.ndarray | None = None) -> pa.Array:
        """A column of words as lists by line."""
        return pa.ListArray.from_arrays(pa.array(self.ends if ends is None else ends, pa.int32()), column)


def _raw(run: tuple) -> list[dict]:
    return [{"text": t, "sy": s, "wb": b, "mf": m} for t, s, b, m in run]


@lru_cache(maxsize=REMEMBERED // 4)
def _syllables(run: tuple) -> list[dict]:
    return [{"pre_punct": w.pre, "syls": [{**p, "stressed": i == w.stress} for i, p in enumerate(w.parts)], "post_punct": w.post, "stress_idx": w.stress, "error": w.error} for w in P.line_words(_raw(run))]


def syllabified(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines with syl_words. Words that fit no reading have an error and no syllables; strict fails on them."""

    def make(column: pa.Array) -> list[pa.Array]:
        v = Valued(column, _syllables)
        if strict:
            bad = np.flatnonzero(np.array([w["error"] is not None for w in v.values], bool)[v.of])
            if len(bad):
                raise ValueError(f"{v.columns['text'][int(bad[0])].as_py() or ''}: {v.values[v.of[bad[0]]]['error']}")
        return [v.lists(v.column(v.values, _WORD))]

    return _with(lines, f"syl_words {SYL_WORDS}", make)


@lru_cache(maxsize=REMEMBERED)
def _phonetic(run: tuple) -> list[tuple]:
    return [(P.phonetic([w]), P.phonemic(w)) for w in P.line_words(_raw(run))]


def phonetics(lines: DataFrame) -> DataFrame:
    """lines with phonetic (syllables parted, stress marked) and phonemic text."""

    def make(column: pa.Array) -> list[pa.Array]:
        v = Valued(column, _phonetic)
        phonetic, phonemic = (v.column([x[k] for x in v.values], pa.string()) for k in range(2))
        there = np.array([bool(x[1]) for x in v.values], bool)[v.of]
        ends = np.concatenate([[0], np.cumsum(there)])[v.ends]
        return [pc.binary_join(v.lists(phonetic), " "), pc.binary_join(v.lists(phonemic.filter(pa.array(there)), ends), " ")]

    return _with(lines, "phonetic string, phonemic string", make)


_PART = pa.struct([(n, pa.string()) for n in ("onset", "nucleus", "coda", "vowel")])
_ENDING = pa.struct([("n", pa.int32()), ("np", pa.int32()), ("s", _PART), ("f", _PART)])
_PLACES = ("first", "ult", "penult", "antepenult", "mid")
_PART_DDL = "struct<onset:string,nucleus:string,coda:string,vowel:string>"
ENDS = "struct<" + ", ".join(f"{p}: struct<n:int,np:int,s:{_PART_DDL},f:{_PART_DDL}>" for p in _PLACES) + ">"
AT = "struct<" + ", ".join(f"{p}: int" for p in _PLACES) + ">"


def ending(w: P.Word) -> dict | None:
    """What rhyme takes of a word: its syllables, those after the stressed one, the stressed one (the first, if none is) and the last; null for a
    word without a reading."""
    if not w.parts:
        return None
    part = lambda p: {"onset": p["onset"], "nucleus": p["nucleus"], "coda": p["coda"], "vowel": p["main_vowel"]}
    at = w.stress or 0
    return {"n": len(w.parts), "np": len(w.parts) - 1 - at, "s": part(w.parts[at]), "f": part(w.parts[-1])}


@lru_cache(maxsize=REMEMBERED)
def _endings(run: tuple) -> list[dict | None]:
    return [ending(w) for w in P.line_words(_raw(run))]


def word_ends(lines: DataFrame) -> DataFrame:
    """lines with `ends` and `at` by their real sounds, for operators.rhyme: the words at the line's start, end, last but one, last but two and
    before the third foot's break (the first whose scansion ends in 3A or 3b), and their places."""

    def make(column: pa.Array) -> list[pa.Array]:
        v = Valued(column, _endings)
        n, mid = np.diff(v.ends), np.full(len(column), -1)
        breaks = np.flatnonzero(np.array([(x or "").endswith(("3A", "3b")) for x in v.sy_kinds] or [False], bool)[v.sy])
        line = np.searchsorted(v.ends, breaks, "right") - 1
        mid[line[::-1]] = (breaks - v.ends[line])[::-1]
        at = {"first": np.where(n > 0, 0, -1), "ult": n - 1, "penult": np.maximum(n - 2, -1), "antepenult": np.maximum(n - 3, -1), "mid": mid}
        values = pa.array(v.values, _ENDING)
        ends = [values.take(pa.array(np.where(k < 0, 0, v.of[np.maximum(v.ends[:-1] + k, 0)]) if len(v.of) else np.zeros(len(k), np.int64), mask=k < 0)) for k in at.values()]
        places = [pa.array(k, pa.int32(), mask=k < 0) for k in at.values()]
        return [pa.StructArray.from_arrays(ends, names=list(at)), pa.StructArray.from_arrays(places, names=list(at))]

    return _with(lines, f"ends {ENDS}, at {AT}", make)


def align(rows: list[str]) -> list[str]:
    """Rows of words, one below the other: each column as wide as its widest word, combining marks not counted. Rows must have as many words."""
    split = [r.split(" ") for r in rows]
    if len({len(r) for r in split}) > 1:
        raise ValueError("rows differ in their numbers of words")
    width = lambda w: sum(not unicodedata.combining(c) for c in w)
    most = [max(map(width, column)) for column in zip(*split, strict=True)]
    return [" ".join(w + " " * (m - width(w)) for w, m in zip(r, most, strict=True)).rstrip() for r in split]


@lru_cache(maxsize=REMEMBERED)
def _columns(run: tuple) -> list[tuple]:
    """The three rows of each word, padded to one width."""
    blank = lambda x: x.replace(" ", "") or "-"
    width = lambda w: len(w) if w.isascii() else sum(not unicodedata.combining(c) for c in w)
    out = []
    for (text, sy, *_), w in zip(run, P.line_words(_raw(run)), strict=True):
        rows = blank(text or ""), blank(sy or ""), blank(w.pre + ".".join("`" + s if i == w.stress else s for i, s in enumerate(w.syls)) + w.post)
        widths = [width(r) for r in rows]
        most = max(widths)
        out.append(tuple([r + " " * (most - k) for r, k in zip(rows, widths, strict=True)]))
    return out


def aligned(lines: DataFrame) -> DataFrame:
    """lines with `aligned`: the words, their scansion and their sounds as three rows under one another."""

    def make(column: pa.Array) -> list[pa.Array]:
        v = Valued(column, _columns)
        rows = [pc.utf8_rtrim_whitespace(pc.binary_join(v.lists(v.column([x[k] for x in v.values], pa.string())), " ")) for k in range(3)]
        there = np.diff(v.ends) > 0
        order = (np.flatnonzero(there)[:, None] + np.arange(3) * len(there)).ravel()
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 3 * np.cumsum(there)]), pa.int32()), pa.concat_arrays(rows).take(pa.array(order)))]

    return _with(lines, "aligned array<string>", make)


def phonemic_words(lines: DataFrame) -> DataFrame:
    """lines whose words carry their phonemic form for text (`_` at the end of a word that is elided into the next), for chunks and proper names by
    sound."""

    def make(words: list[dict]) -> tuple:
        out = [{**raw, "text": P.phonemic(w) + ("_" if "_" in w.syls else "")} for raw, w in zip(words, P.line_words(words), strict=True)]
        return (out,)

    return _mapped(lines, "words_ array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>", make).withColumnRenamed("words_", "words")


#: Bits of a syllable's prosody in the compact tensor.
ACCENT, ICTUS, CF, DI, CM, ELISION, LONG = 1, 2, 4, 8, 16, 32, 64
LEFT, RIGHT = 2, 18


def _safe(cluster: str, vowels: bool) -> float:
    known = "".join(c for c in cluster.lower().replace("ü", "y") if c in (space.VOWELS if vowels else space.CONSONANTS))
    return space.place(known, vowels) if known or not vowels else 0.0


def _real(run: tuple) -> Iterator[tuple]:
    """(raw word, word, its syllables with their codes, the number of codes) by word."""
    for raw, w in zip(_raw(run), P.line_words(_raw(run)), strict=True):
        codes = [raw["sy"][i : i + 2] for i in range(0, len(raw["sy"] or ""), 2)]
        yield raw, w, list(zip([p for p in w.parts if p["raw"] != "_"], codes, strict=False)), len(codes)


@lru_cache(maxsize=REMEMBERED)
def compact(run: tuple) -> list[list[tuple]]:
    """By word and syllable: whether it joins the syllable before (never), then onset, nucleus, coda and prosody in hundredths."""
    out = []
    for raw, w, real, n in _real(run):
        rows = []
        for i, (p, code) in enumerate(real):
            bits = ACCENT * (i == w.stress) + ICTUS * (code[1] == "A") + LONG * code[1].isupper()
            if i == n - 1:
                bits += {"CF": CF, "DI": DI, "CM": CM}.get(raw["wb"] or "", 0) + ELISION * (raw["mf"] == "SY")
            rows.append((0.0, _safe(p["onset"], False), _safe(p["nucleus"], True), _safe(p["coda"], False), bits / 99))
        out.append(rows)
    return out


@lru_cache(maxsize=REMEMBERED)
def loose(run: tuple) -> list[list[tuple]]:
    """By word and syllable: whether it joins the syllable before, as two shorts are one metron, then onset, nucleus, coda, length, the three kinds of
    word end, conflict and elision."""
    out = []
    for raw, w, real, n in _real(run):
        rows = []
        for i, (p, code) in enumerate(real):
            last = i == n - 1
            end = [float(last and raw["wb"] == k) for k in ("CF", "DI", "CM")]
            rows.append((float(code[1] == "c"), _safe(p["onset"], False), _safe(p["nucleus"], True), _safe(p["coda"], False), float(code[1].isupper()), *end, float(code[1] == "A" and i != w.stress), float(last and raw["mf"] == "SY")))
        out.append(rows)
    return out


def layers(v: Valued, depth: int, left: int, right: int) -> np.ndarray:
    """(line, layer, place) of a batch. A syllable that joins the one before it in its line is averaged with it in its three sounds; of the rest the
    greater counts."""
    count = np.array([len(x) for x in v.values], np.int64)
    begin, flat = np.concatenate([[0], np.cumsum(count)])[:-1], np.array([r for x in v.values for r in x], float).reshape(-1, depth + 1)
    many = count[v.of]
    upto = np.concatenate([[0], np.cumsum(many)])
    rows = flat[np.repeat(begin[v.of] - upto[:-1], many) + np.arange(upto[-1])]
    ends = upto[v.ends]
    line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    joins = rows[:, 0] > 0
    joins[ends[:-1][np.diff(ends) > 0]] = False
    base = np.maximum.accumulate(np.where(joins, 0, np.arange(len(rows)))) if len(rows) else np.empty(0, np.int64)
    rows, nth = rows[:, 1:], np.arange(len(rows)) - base
    for k in range(1, int(nth.max(initial=0)) + 1):
        at = np.flatnonzero(nth == k)
        to = base[at]
        rows[to] = np.concatenate([(rows[to, :3] + rows[at, :3]) / 2, np.maximum(rows[to, 3:], rows[at, 3:])], axis=1)
    rows, line, first = rows[~joins], line[~joins], np.concatenate([[0], np.cumsum(~joins)])[ends[:-1]]
    place = np.arange(len(rows)) - first[line]
    if place.max(initial=-1) >= right:
        raise ValueError(f"a line has more than {right} places")
    out = np.zeros((len(ends) - 1, depth, left + right))
    out[line, :, left + place] = rows
    return out


def tensors(lines: DataFrame, mapper=compact, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """lines with tensor: layers of left zeros and right places. A longer line fails."""
    depth = {compact: 4, loose: 9}[mapper]

    def make(column: pa.Array) -> list[pa.Array]:
        made = layers(Valued(column, mapper), depth, left, right)
        cut = lambda n, step: pa.array(np.arange(n + 1) * step, pa.int32())
        inner = pa.ListArray.from_arrays(cut(len(made) * depth, left + right), pa.array(made.ravel()))
        return [pa.ListArray.from_arrays(cut(len(made), depth), inner)]

    return _with(lines, "tensor array<array<double>>", make)
