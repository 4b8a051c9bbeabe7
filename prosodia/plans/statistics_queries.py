"""Queries of resampling statistics, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosodia.functions import metre as M
from prosodia.functions import space
from prosodia.functions import statistics as S
from prosodia.operators import features, resampling

from .verse_queries import _FEATS, QUERIES, cleaned, query

_PER_BOOK = "select author, book_no, count(*) as v from l group by author, book_no"
_AT = lambda s: f"a[least(floor(len(a) * {s} + 1e-9)::bigint, len(a) - 1) + 1]"
_CI = ", ".join(f"{_AT((1 - p) / 2)} as l{int(100 * p)}, {_AT((1 + p) / 2)} as h{int(100 * p)}" for p in (0.9, 0.95, 0.99))


def _books(spark, d):
    return cleaned(spark, d, False).groupBy("author", "book_no").agg(F.count("*").alias("v"))


def _intervals(books):
    """Order statistics of the lines of an author's books."""
    rows = books.groupBy("author").agg(F.sort_array(F.collect_list("v")).alias("a"))
    cols = {}
    for p in (0.9, 0.95, 0.99):
        low, mid, high = S.order_interval(F.col("a"), p)
        cols |= {f"l{int(100 * p)}": low, "mid": mid, f"h{int(100 * p)}": high}
    return rows.select("author", *[c.alias(n) for n, c in cols.items()])


@query("order_statistics_ci", f"select author, {_AT(0.5)} as mid, {_CI} from (select author, list_sort(list(v)) as a from ({_PER_BOOK}) group by author)")
def order_statistics_ci(spark, d):
    return _intervals(_books(spark, d))


@query("stars", f"select author, book_no, v / mid as pi, case when v >= mid then (h90 < v)::int + (h95 < v)::int + (h99 < v)::int else 3 - ((l90 < v)::int + (l95 < v)::int + (l99 < v)::int) end as stars from ({_PER_BOOK}) join (select author, {_AT(0.5)} as mid, {_CI} from (select author, list_sort(list(v)) as a from ({_PER_BOOK}) group by author)) using (author)")
def stars(spark, d):
    """How far each book's length lies out among its author's: its share of the middle one, and stars."""
    books = _books(spark, d)
    j = books.join(_intervals(books), "author")
    s = S.stars(F.col("v"), [F.col("l90"), F.col("l95"), F.col("l99")], F.col("mid"), [F.col("h90"), F.col("h95"), F.col("h99")])
    return j.select("author", "book_no", (F.col("v") / F.col("mid")).alias("pi"), s.alias("stars"))


_CELLS = [f"{m}-{c}" for m in "HP" for c in ("S", "W", "Q", "-")]


@query("pivot_vector", f"select author, {', '.join(f'max(case when k = {chr(39)}{c}{chr(39)} then share end) as {chr(34)}{c}{chr(34)}' for c in _CELLS)} from (select author, metre || '-' || c as k, round(count(*) / sum(count(*)) over (partition by author, metre), 9) as share from (select work, author, metre, book_no, line_idx, arg_min(c, word_idx) as c from (select x.*, {M.caesura_code(3, False, 'x')} as c from w x) where c is not null group by all) group by author, metre, c) group by author")
def pivot_vector(spark, d):
    """Shares of third-foot caesurae by metre, a column a cell."""
    from pyspark.sql import Window

    rows = cleaned(spark, d, False).select("author", "metre", F.expr(M.caesura(3)).alias("c")).where("c is not null").groupBy("author", "metre", "c").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("author", "metre")), 9)
    return rows.select("author", F.concat_ws("-", "metre", "c").alias("k"), share.alias("share")).groupBy("author").pivot("k", _CELLS).agg(F.first("share"))


_C = "case s {} end".format(" ".join(f"when '{k}' then {v!r}" for k, v in space.CONSONANTS.items() if k))


@query("locate_cluster", f"select distinct c, round(list_reduce(list_transform(string_split(c, ''), lambda s: ({_C})::double), lambda a, x: (a + x * 3e0) / 4e0), 12) as place from (select regexp_extract(lower(text), '^([bcdfghjklmnpqrstvwxz]+)', 1) as c from raw) where regexp_matches(c, '^[pbmwftdnlrszgkjxh]+$')", clean=False)
def locate_cluster(spark, d):
    """Places of the onsets that words start with."""
    from . import bridge

    words = bridge.lines(spark, d).select(F.explode("words.text").alias("t")).select(F.regexp_extract(F.lower("t"), "^([bcdfghjklmnpqrstvwxz]+)", 1).alias("c")).distinct().where("c rlike '^[pbmwftdnlrszgkjxh]+$'")
    return words.select("c", F.round(F.expr(space.place_expr("c")), 12).alias("place"))


def sampled_distribution(spark, d):
    feats = features.distribution(cleaned(spark, d, False).where("metre = 'H'"))
    return resampling.sampled_distribution(feats, 50, 200, seed=7)


def mahalanobis(spark, d):
    """Each author's centroid against drawn means of fifty hexameters of all."""
    feats = features.distribution(cleaned(spark, d, False).where("metre = 'H'"))
    return resampling.explain_each(features.centroid(feats, ["author"]), resampling.sampled_distribution(feats, 50, 400, seed=7), ["author"])


_OF = [("1SP", 0), ("2CF", 1), ("4DI", 2), ("ELC", 3)]


@query("mahalanobis_books", "select book_no, round(sum(power(v - m, 2) / (0.9 * s + 0.1 * t)), 6) as distance from (select book_no, f.name, f.v, g.m, g.s, avg(g.s) over (partition by book_no) as t from (unpivot (select book_no, {a} from (FEATS) group by book_no) on {n} into name name value v) f join (select name, avg(v) as m, var_pop(v) as s from (unpivot (select {n} from (FEATS)) on {n} into name name value v) group by name) g using (name)) group by book_no".replace("{a}", ", ".join(f'avg("{f}") as "{f}"' for f, _ in _OF)).replace("{n}", ", ".join(f'"{f}"' for f, _ in _OF)).replace("FEATS", _FEATS))
def mahalanobis_books(spark, d):
    """Each book's distance from all lines by four features, covariances left out: shrunk variances alone, so that SQL has it."""
    feats = features.distribution(cleaned(spark, d, False), keys=["book_no"])
    cs = [f for f, _ in _OF]
    whole = feats.agg(*[F.avg(c).alias(f"m_{c}") for c in cs], *[F.var_pop(c).alias(f"s_{c}") for c in cs])
    books = feats.groupBy("book_no").agg(*[F.avg(c).alias(c) for c in cs]).join(F.broadcast(whole), F.lit(True))
    mean = sum((F.col(f"s_{c}") for c in cs), F.lit(0.0)) / len(cs)
    parts = [F.pow(F.col(c) - F.col(f"m_{c}"), F.lit(2)) / (0.9 * F.col(f"s_{c}") + 0.1 * mean) for c in cs]
    return books.select("book_no", F.round(sum(parts, F.lit(0.0)), 6).alias("distance"))


QUERIES["sampled_distribution"] = sampled_distribution
QUERIES["mahalanobis"] = mahalanobis
