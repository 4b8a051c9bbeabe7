"""Quality rules whose cut-offs are learnt from the corpus, per language and source.

Each document gets integer measures (symbols and capitals per mille, repeated lines per mille,
mean word length). Every measure of every (lang, source) group is summed up in a log-linear
histogram: buckets one wide up to 63, then 32 to each power of two. Such a sketch has a bounded
number of buckets, a relative error below 1/32, does not depend on the order of rows, and two of
them merge by adding counts. So one small aggregation gives the sketches of groups, their sums
those of languages and of the corpus, and the quantiles of all three. A group's quantiles are
drawn towards its language's, and these towards the corpus's, as if PRIOR documents more had those: the fewer
documents, the more, and no count at which a verdict jumps.

A fence lies `k` half-spreads from the median, and the spread is measured on the side where
rejects do not lie (median less the 10 % quantile for upper fences), so that up to half of a
group may be junk before it moves its own fence. No fixed share of documents is rejected.

Everything is DataFrame expressions. Defined results: a null text has no words and fails the
base rules; null lang or source is a group of its own; repeated rows each get their verdict;
an empty table gives an empty result; columns of the input are passed on untouched, whatever their names, but for those of
the results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, publish, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRIOR = 200
K = 4
#: measure: (side of the fence, least spread)
MEASURES = {"m_symbols": ("upper", 15), "m_capitals": ("upper", 60), "m_dup_lines": ("upper", 75), "m_word_len": ("both", 100)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A thresholds table of at most this many groups is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 20_000


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _once(df: DataFrame, names: list[str]) -> DataFrame:
    """df with columns that are worked out once a row: a filter above is not pushed through a generator, which would put a copy of
    their expressions into each place that names them, lambda bodies included."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_o")).select(*rest, "_o.*")


def cheap_measures(docs: DataFrame) -> DataFrame:
    """Measures that need no sorting: one pass over the text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_t", t).withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    out = out.withColumns(
        {
            "n_words": F.size(words(F.col("_t"))).cast("long"),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
            "n_symbols": _removed(F.col("_t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_caps": _removed(F.col("_t"), UPPER).cast("long"),
            "_n_lines": F.size("_l").cast("long"),
        }
    )
    per = lambda a, b, unit: F.expr(f"coalesce({a} * {unit} div nullif({b}, 0), 0)")
    return out.withColumns(
        {
            "m_symbols": per("n_symbols", "word_chars", 1000),
            "m_capitals": per("_caps", "word_chars", 1000),
            "m_dup_lines": per("n_dup_lines", "_n_lines", 1000),
            "m_word_len": per("word_chars", "n_words", 100),
        }
    ).drop("_t", "_l", "_caps", "_n_lines")


def repeat_words(docs: DataFrame, window: int = 5) -> DataFrame:
    """n_repeat_words: words lying in windows found twice or more in the same text. The windows'
    hashes are sorted with their places; equal neighbours are repeats; the union of their spans
    is summed over the places in order."""
    w = docs.withColumn("_w", words(F.col("text")))
    w = w.withColumn(
        "_s",
        F.when(
            F.size("_w") > window,
            F.sort_array(F.transform(F.sequence(F.lit(1), F.size("_w") - (window - 1)), lambda i: F.struct(F.xxhash64(F.slice("_w", i, window)).alias("h"), i.alias("i")))),
        ),
    )
    at = lambda i: F.get(F.col("_s"), i)["h"]
    w = w.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, j) -> x.h <=> get(_s, j - 1).h or x.h <=> get(_s, j + 1).h), x -> x.i))"))
    w = w.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform(_p, (p, j) -> least({window}, coalesce(get(_p, j + 1) - p, {window}))), 0L, (a, x) -> a + x), 0L)"))
    return w.drop("_w", "_s", "_p")


def bucket(v: str) -> Column:
    """Log-linear bucket of a whole number from 0."""
    return F.expr(f"case when {v} < 64 then {v} else (length(bin({v})) - 6) * 32 + shiftright({v}, cast(length(bin({v})) - 6 as int)) end")


def bucket_low(b: str) -> Column:
    """The least number in a bucket."""
    return F.expr(f"case when {b} < 64 then {b} else shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 as int)) end")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by summing n."""
    rows = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")) for m in MEASURES])).alias("x"))
    return rows.select("lang", "source", "x.measure", F.col("x.v").alias("v")).withColumn("bucket", bucket("v").cast("long")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    merged = sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    run, whole = Window.partitionBy(*keys, "measure").orderBy("bucket"), Window.partitionBy(*keys, "measure")
    merged = merged.withColumns({"cum": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    q = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("bucket"))).alias(f"q{p}")
    out = merged.groupBy(*keys, "measure").agg(F.max("total").alias("total"), q(10), q(50), q(90))
    return out.withColumns({f"q{p}": bucket_low(f"q{p}").cast("long") for p in (10, 50, 90)})


def thresholds(sk: DataFrame, prior: int = PRIOR, k: int = K) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>): one row for each group seen."""
    own, lang, all_ = _quantiles(sk, ["lang", "source"]), _quantiles(sk, ["lang"]), _quantiles(sk, [])
    g, l, a = own.alias("g"), lang.alias("l"), all_.alias("a")
    j = g.join(F.broadcast(a), F.col("g.measure") == F.col("a.measure")).join(l, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.measure") == F.col("l.measure")))
    drawn = lambda p: F.expr(_drawn(p, prior)).alias(f"q{p}")
    t = j.select("g.lang", "g.source", "g.measure", drawn(10), drawn(50), drawn(90))
    aggs = []
    for m, (side, slack) in MEASURES.items():
        high = F.col("q50") + k * F.greatest(F.col("q50") - F.col("q10"), F.lit(slack))
        low = F.col("q50") - k * F.greatest(F.col("q90") - F.col("q50"), F.lit(slack))
        aggs.append(F.max(F.when(F.col("measure") == m, high)).alias(f"high_{m}"))
        if side == "both":
            aggs.append(F.max(F.when(F.col("measure") == m, low)).alias(f"low_{m}"))
    return t.groupBy("lang", "source").agg(*aggs)


def _drawn(p: int, prior: int, div: str = "div") -> str:
    """A group's quantile, drawn towards the language's and this towards the corpus's."""
    parent = f"((l.total * l.q{p} + {prior} * a.q{p}) {div} (l.total + {prior}))"
    return f"(g.total * g.q{p} + {prior} * {parent}) {div} (g.total + {prior})"


def verdict(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """rows(lang, source, BASE, MEASURES) with base_failed and kept; fences as of thresholds, written down."""
    cut = fences.withColumnsRenamed({"lang": "_fl", "source": "_fs"})
    if fences.count() <= BROADCAST_GROUPS:
        cut = F.broadcast(cut)
    rows = rows.join(cut, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")), "left")
    bad = F.lit(False)
    for m, (side, _) in MEASURES.items():
        bad = bad | (F.col(m) > F.col(f"high_{m}"))
        if side == "both":
            bad = bad | (F.col(m) < F.col(f"low_{m}"))
    rows = rows.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))


def measures(rows: DataFrame) -> DataFrame:
    """rows(text, lang, source, ...) with BASE and MEASURES."""
    return _once(repeat_words(cheap_measures(rows)), [*BASE, *MEASURES])


def apply_quality_rules(docs: DataFrame, prior: int = PRIOR, k: int = K) -> DataFrame:
    """docs with BASE, MEASURES, base_failed and kept. Columns of these names in docs are replaced. Texts are read twice: for the sketches only the
    measures that need no sorting are worked out."""
    told = [*BASE, *MEASURES, "base_failed", "kept"]
    names = [c for c in docs.columns if c not in told]
    fences = publish(thresholds(sketches(cheap_measures(docs.select("text", "lang", "source"))), prior, k), "fences")
    # a row's own columns stand apart, so that no name of theirs can clash with one of here
    rows = docs.select(F.struct(*names).alias("_row"), "text", "lang", "source")
    return verdict(measures(rows), fences).select(*[F.col("_row")[c].alias(c) for c in names], *told)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures are worked out once and written down; the sketches and the verdict are made of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = publish(measures(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measures")
    fences = publish(thresholds(sketches(rows)), "fences")
    return verdict(rows, fences).select("doc_id", *BASE, "base_failed", "kept", *MEASURES)


def _sql_quantiles(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    low = "case when {b} < 64 then {b} else ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1) end"
    qs = ", ".join(low.format(b=f"min(case when cum * 100 >= total * {p} then bucket end)") + f" as q{p}" for p in (10, 50, 90))
    return f"""{name} as (select {by}measure, max(total) as total, {qs} from (
  select {by}measure, bucket, sum(n) over (partition by {by}measure order by bucket) as cum, sum(n) over (partition by {by}measure) as total
  from (select {by}measure, bucket, sum(n) as n from sk group by {by}measure, bucket)) group by {by}measure)"""


def oracle() -> str:
    fences = []
    for m, (side, slack) in MEASURES.items():
        fences.append(f"max(case when measure = '{m}' then q50 + {K} * greatest(q50 - q10, {slack}) end) as high_{m}")
        if side == "both":
            fences.append(f"max(case when measure = '{m}' then q50 - {K} * greatest(q90 - q50, {slack}) end) as low_{m}")
    bad = " or ".join([f"{m} > high_{m}" for m in MEASURES] + [f"{m} < low_{m}" for m, (s, _) in MEASURES.items() if s == "both"])
    picks = ", ".join(f"{_drawn(p, PRIOR, '//')} as q{p}" for p in (10, 50, 90))
    legs = " union all ".join(f"select lang, source, '{m}' as measure, {m} as v from m" for m in MEASURES)
    return f"""with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
b as (select r, doc_id, lang, source, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols, length(t) - length(translate(t, '{UPPER}', '')) as caps,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines from w),
g as (select r, i, array_to_string(ws[i:i+4], ' ') as s from (select r, ws, unnest(range(1, len(ws) - 3)) as i from b)),
c as (select r, i from (select r, i, count(*) over (partition by r, s) as n from g) where n > 1),
u as (select r, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words from (select r, i, lead(i) over (partition by r order by i) as nxt from c) group by r),
m as (select b.*, coalesce(u.n_repeat_words, 0) as n_repeat_words,
  coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) as m_symbols, coalesce(caps * 1000 // nullif(word_chars, 0), 0) as m_capitals,
  coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) as m_dup_lines, coalesce(word_chars * 100 // nullif(n_words, 0), 0) as m_word_len
  from b left join u using (r)),
sk as (select lang, source, measure, bucket, count(*) as n from (select lang, source, measure,
  case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end as bucket from ({legs})) group by all),
{_sql_quantiles('qg', 'lang, source')}, {_sql_quantiles('ql', 'lang')}, {_sql_quantiles('qa', '')},
th as (select lang, source, {', '.join(fences)} from (select g.lang, g.source, g.measure, {picks} from qg g join ql l on g.lang is not distinct from l.lang and g.measure = l.measure join qa a on g.measure = a.measure) group by lang, source),
v as (select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {bad} as bad from m join th on m.lang is not distinct from th.lang and m.source is not distinct from th.source)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, not base_failed and not bad as kept, {', '.join(f'{m}::bigint as {m}' for m in MEASURES)} from v"""
