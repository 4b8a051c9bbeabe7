"""Scanned verse out of plain text, for tables that hold none. The tokens of each text line are cut into verses one after another, each as long
as the next template of a fixed cycle has words, which gives them their scansion; hexameters and pentameters take turns, and where a line starts
in the cycle depends on its document and place. So every token is a word of one verse. The verse that a line's end cuts short has the pattern
`corrupt`: it counts for what needs no scansion and is cleaned away elsewhere. Written once as a DataFrame plan and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.operators import cleaning

#: Verses of a text line are numbered from the line's number times this.
APART = 1_000_000


def _codes(metre: str, feet: str) -> list[str]:
    """Codes of a line; feet: D or S of the free feet."""
    two = lambda n, k: [f"{n}A", f"{n}b", f"{n}c"] if k == "D" else [f"{n}A", f"{n}T"]
    if metre == "H":
        return [c for n, k in zip((1, 2, 3, 4), feet, strict=True) for c in two(n, k)] + ["5A", "5b", "5c", "6A", "6X"]
    return [c for n, k in zip((1, 2), feet, strict=True) for c in two(n, k)] + ["3A", "4A", "4b", "4c", "5A", "5b", "5c", "6X"]


def _template(metre: str, feet: str, cuts: list[int], mf: dict[int, str] | None = None, bare: tuple[int, ...] = (), pattern: str | None = "") -> tuple:
    """cuts: syllables of each word (0: none). bare: words without a boundary mark."""
    codes, at, words = _codes(metre, feet), 0, []
    for k, n in enumerate(cuts):
        sy = "".join(codes[at : at + n])
        at += n
        wb = None if k in bare or not sy or k == len(cuts) - 1 else {"A": "CM", "b": "CF"}.get(sy[-1], "DI")
        words.append((sy, wb, (mf or {}).get(k)))
    if at != len(codes):
        raise ValueError(f"{metre} {feet} has {len(codes)} syllables, not {at}")
    made = feet if metre == "H" else f"{feet}-|DD-"
    return metre, made if pattern == "" else pattern, words


TEMPLATES = [
    _template("H", "DDSS", [1, 2, 3, 2, 2, 3, 2]),
    _template("H", "DSDS", [3, 2, 2, 3, 3, 2]),
    _template("H", "SSSS", [2, 3, 2, 1, 3, 2]),
    _template("H", "SDSD", [1, 4, 2, 3, 3, 2]),
    _template("H", "DDDD", [3, 3, 1, 2, 3, 3, 2]),
    _template("H", "DSSD", [1, 3, 2, 2, 2, 3, 2], {2: "SY"}, (2,)),
    _template("H", "SDDS", [2, 2, 0, 3, 3, 3, 2], {2: "SY"}),
    _template("H", "SSDD", [4, 2, 2, 2, 3, 2], {1: "SY", 3: "SY"}, (1, 3)),
    _template("H", "DDDS", [2, 2, 2, 2, 3, 3, 2], {0: "SY"}, (0,)),
    _template("H", "SSSD", [2, 2, 5, 3, 2, 0], {5: "PE"}),
    _template("H", "SDSS", [2, 3, 2, 2, 3, 2], pattern="corrupt"),
    _template("H", "DSDD", [4, 2, 2, 3, 3, 2], pattern=None),
    _template("P", "DD", [3, 3, 1, 3, 2, 2]),
    _template("P", "DS", [2, 3, 1, 2, 3, 2]),
    _template("P", "SD", [1, 2, 3, 1, 4, 2]),
    _template("P", "SS", [2, 3, 3, 3, 1]),
    _template("P", "DD", [1, 4, 2, 2, 3, 2], {1: "SY"}),
    _template("P", "DS", [3, 2, 1, 2, 2, 3], {0: "SY"}, (0,)),
    _template("P", "SS", [4, 1, 1, 2, 2, 2]),
    _template("P", "SD", [2, 2, 2, 2, 3, 2], {3: "SY"}),
    _template("P", "DS", [1, 3, 2, 1, 2, 2, 2]),
    _template("P", "SD", [3, 2, 1, 3, 3, 1]),
    _template("P", "SS", [2, 2, 1, 3, 3, 1], pattern="not scanned"),
    _template("P", "DD", [4, 2, 1, 3, 2, 2]),
]
HALF = len(TEMPLATES) // 2
#: Templates in turn, hexameter and pentameter; where each begins in the cycle, and which one a place of the cycle is of.
CYCLE = [t for k in range(HALF) for t in (TEMPLATES[k], TEMPLATES[HALF + k])]
BEGIN = [sum(len(ws) for *_, ws in CYCLE[:k]) for k in range(len(CYCLE) + 1)]
LENGTH = BEGIN.pop()
OF = [k for k, (*_, ws) in enumerate(CYCLE) for _ in ws]
_BASE = f"cast(2 * ((coalesce(doc_id, 0) * 31 + i) % {HALF}) as int)"


def _q(x: str | None) -> str:
    return "cast(null as string)" if x is None else f"'{x}'"


#: Bytes a core below which a table is dealt anew: small tables come in one or two row groups, which one or two tasks would read.
SMALL = 16 << 20


def _dealt(docs: DataFrame) -> DataFrame:
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(2 * cores, F.xxhash64("doc_id", "text")) if size < SMALL * cores else docs


def _verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its verses in order: an array of line, place in it, where the line starts in the cycle, metre, pattern and tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    ints = lambda xs: f"array({', '.join(map(str, xs))})"
    texts = lambda xs: f"array({', '.join(map(_q, xs))})"
    turn = f"cast((q.base + j) % {len(CYCLE)} as int)"
    start = f"get({ints(BEGIN)}, q.base)"
    end = f"({start} + size(q.toks) - 1)"
    last = f"cast({end} div {LENGTH} * {len(CYCLE)} + get({ints(OF)}, cast({end} % {LENGTH} as int)) - q.base as int)"
    begin = f"cast((q.base + j) div {len(CYCLE)} * {LENGTH} + get({ints(BEGIN)}, {turn}) - {start} as int)"
    size = f"get({ints(len(ws) for *_, ws in CYCLE)}, {turn})"
    # each verse takes its own tokens, so that a document's verses are no larger than its text
    verse = f"named_struct('i', i, 'j', j, 'turn', {turn}, 'own', slice(q.toks, {begin} + 1, {size}), 'metre', get({texts(m for m, *_ in CYCLE)}, {turn}), 'pattern', case when size(q.toks) - {begin} < {size} then 'corrupt' else get({texts(p for _, p, _ in CYCLE)}, {turn}) end)"
    line = f"get(transform(array(named_struct('toks', split(line, ' '), 'base', {_BASE})), q -> transform(sequence(0, {last}), j -> {verse})), 0)"
    return _dealt(docs).withColumn("verses", F.expr(f"flatten(transform(split(text, '\\n'), (line, i) -> {line}))")).drop("text")


def _lined(verses: DataFrame, more: list[str]) -> DataFrame:
    """verses with one verse v a row, as lines."""
    words = ", ".join(f"array({', '.join(f'named_struct({chr(39)}sy{chr(39)}, {_q(s)}, {chr(39)}wb{chr(39)}, {_q(b)}, {chr(39)}mf{chr(39)}, {_q(f)})' for s, b, f in ws)})" for *_, ws in CYCLE)
    rows = verses.withColumn("t", F.expr(f"get(array({words}), v.turn)"))
    at = f"cast(v.i as bigint) * {APART} + v.j"
    made = "transform(v.own, (x, k) -> named_struct('idx', k, 'text', x, 'sy', t[k].sy, 'wb', t[k].wb, 'mf', t[k].mf))"
    return rows.selectExpr("lang as work", "source as author", "doc_id as book_no", "cast(doc_id as string) as book_title", f"{at} as line_idx", f"cast({at} + 1 as string) as line_name", "v.metre as metre", "v.pattern as pattern", f"{made} as words", *more)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, author, book_no, book_title, line_idx, line_name, metre, pattern, words."""
    return _lined(_verses(spark, sf_dir).withColumn("v", F.explode("verses")).drop("verses"), [])


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines, cleaned by document, with places rn from 0. A document's verses are in one row, so they are cleaned there, and nothing is shuffled."""
    rows = _verses(spark, sf_dir).withColumn("verses", F.expr(cleaning.kept("verses")))
    return _lined(rows.select("doc_id", "lang", "source", F.posexplode("verses").alias("rn", "v")), ["rn"])


def _values() -> str:
    v = lambda x: "null" if x is None else f"'{x}'"
    return ", ".join(f"({BEGIN[t] + k}, {t}, {k}, {len(ws)}, '{m}', {v(p)}, '{s}', {v(b)}, {v(f)})" for t, (m, p, ws) in enumerate(CYCLE) for k, (s, b, f) in enumerate(ws))


def prelude(clean: bool = True) -> str:
    """CTEs raw (one row a word) and, if asked, l (cleaned lines, with rn counted from 0 in a book) and w (their words)."""
    sql = f"""with t(place, turn, word_idx, n_words, metre, pattern, sy, wb, mf) as (values {_values()}),
v as (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
g0 as (select doc_id, lang, source, i, {_BASE} as base, string_split(line, ' ') as toks from v),
g1 as (select g0.*, b.place as start, len(toks) as n from g0 join (select turn, place from t where word_idx = 0) b on b.turn = g0.base),
g as (select doc_id, lang, source, i, base, start, n, unnest(toks) as text, start + generate_subscripts(toks, 1) - 1 as at from g1),
raw as (select g.lang as work, g.source as author, g.doc_id as book_no, (g.i * {APART} + g.at // {LENGTH} * {len(CYCLE)} + t.turn - g.base)::bigint as line_idx, t.metre,
  case when g.at - t.word_idx + t.n_words > g.start + g.n then 'corrupt' else t.pattern end as pattern, t.word_idx, t.n_words, g.text, t.sy, t.wb, t.mf from g join t on t.place = g.at % {LENGTH})"""
    if clean:
        sql += """,
s0 as (select distinct work, author, book_no, line_idx, metre, pattern from raw where pattern is not null and pattern not in ('corrupt', 'not scanned')),
s1 as (select *, row_number() over (partition by book_no order by line_idx) as n from s0),
s2 as (select *, max(case when metre = 'P' and n <= 100 then 1 else 0 end) over (partition by book_no) as elegiac,
  lead(metre) over (partition by book_no order by line_idx) as nxt, lag(metre) over (partition by book_no order by line_idx) as prv from s1),
l as (select work, author, book_no, line_idx, metre, pattern, row_number() over (partition by book_no order by line_idx) - 1 as rn from s2
  where elegiac = 0 or (metre = 'H' and (nxt is null or nxt <> 'H')) or (metre = 'P' and prv = 'H')),
w as (select raw.*, l.rn from raw join l using (book_no, line_idx))"""
    return sql
