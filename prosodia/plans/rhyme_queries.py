"""Queries over rhymes, with the toy phonology of plain tokens, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosodia.functions import rhyme as R
from prosodia.operators import rhyme

from . import bridge
from .verse_queries import ORACLES, QUERIES, cleaned, query

_E = "select book_no, author, work, metre, line_idx, rn"
#: SQL: by line, its words at the positions with their toy words.
_ENDS = f"""e0 as (select book_no, author, work, metre, line_idx, rn, word_idx, n_words, sy, text, {R.toy_word('text', False)} as word, min(case when sy like '%3A' or sy like '%3b' then word_idx end) over (partition by book_no, line_idx) as mid_at from w),
e as (select book_no, author, work, metre, line_idx, rn, max(n_words) as n_words, max(mid_at) as mid_at, any_value(word) filter (where word_idx = 0) as first, any_value(word) filter (where word_idx = n_words - 1) as ult, any_value(word) filter (where word_idx = n_words - 2) as penult, any_value(word) filter (where word_idx = mid_at) as mid,
 any_value(text) filter (where word_idx = n_words - 1) as ult_text, any_value(text) filter (where word_idx = mid_at) as mid_text from e0 group by book_no, author, work, metre, line_idx, rn)"""
_AT = {"first": "0", "ult": "n_words - 1", "penult": "n_words - 2", "mid": "mid_at"}


def ends(spark, d):
    return rhyme.with_ends(cleaned(spark, d, False), R.toy_word("x.text"))


@query("syl_parts", f"select distinct text, x.n, x.np, x.s.onset as s_onset, x.s.nucleus as s_nucleus, x.s.coda as s_coda, x.f.onset as f_onset, x.f.nucleus as f_nucleus, x.f.coda as f_coda, x.f.vowel as f_vowel from (select text, {R.toy_word('text', False)} as x from raw)", clean=False)
def syl_parts(spark, d):
    rows = bridge.lines(spark, d).select(F.explode("words.text").alias("text")).distinct().withColumn("x", F.expr(R.toy_word("text")))
    return rows.select("text", "x.n", "x.np", *[F.col(f"x.{a}.{b}").alias(f"{a}_{b}") for a in "sf" for b in ("onset", "nucleus", "coda")], F.col("x.f.vowel").alias("f_vowel"))


_NEXT = f"{_ENDS}, p as (select a.*, b.ult as other from e a join e b on a.book_no = b.book_no and b.rn = a.rn + 1)"


@query("nucleus_scores", f"select book_no, line_idx, {R.nucleus_score('ult.f', 'other.f', False)} as score from p")
def nucleus_scores(spark, d):
    w = rhyme._window(["book_no"], "line_idx")
    rows = ends(spark, d).select("book_no", "line_idx", F.col("ends.ult").alias("a"), F.lead("ends.ult").over(w).alias("b")).where("b is not null")
    return rows.select("book_no", "line_idx", F.expr(R.nucleus_score("a.f", "b.f")).alias("score"))


@query("word_rhyme_pairs", f"select book_no, line_idx, round({R.word_score('ult', 'other')}, 9) as score from p")
def word_rhyme_pairs(spark, d):
    w = rhyme._window(["book_no"], "line_idx")
    rows = ends(spark, d).select("book_no", "line_idx", F.col("ends.ult").alias("a"), F.lead("ends.ult").over(w).alias("b")).where("b is not null")
    return rhyme.scored(rows, {"score": ("a", "b")}).select("book_no", "line_idx", F.round("score", 9).alias("score"))


for _n in ("nucleus_scores", "word_rhyme_pairs"):
    ORACLES[_n] = ORACLES[_n].replace("\nselect", f",\n{_NEXT}\nselect", 1)


def _with_ends(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("\nselect", f",\n{_ENDS}\nselect", 1)


_HIT = R.d(R.THRESHOLD)


@query("rhyme_baseline_bruteforce", f"select author, sum(case when greatest({R.word_score('p', 'q')}, {R.word_score('q', 'p')}) >= {_HIT} then 1 else 0 end)::bigint as hits, count(*)::bigint as tries from (select author, a.ult as p, b.ult as q from e a join e b using (author) where a.metre = 'P' and b.metre = 'P' and (a.book_no, a.line_idx) < (b.book_no, b.line_idx)) group by author")
def rhyme_baseline_bruteforce(spark, d):
    return rhyme.rate(ends(spark, d).where("metre = 'P'").select("author", F.col("ends.ult").alias("word")), None, ["author"])


@query("rhyme_baseline_cross", f"select author, sum(case when {R.word_score('a.ult', 'b.mid')} >= {_HIT} then 1 else 0 end)::bigint as hits, count(*)::bigint as tries from e a join e b using (author) where a.metre = 'H' and b.metre = 'P' and b.mid is not null group by author")
def rhyme_baseline_cross(spark, d):
    rows = ends(spark, d)
    return rhyme.rate(rows.where("metre = 'H'").select("author", F.col("ends.ult").alias("word")), rows.where("metre = 'P'").select("author", F.col("ends.mid").alias("word")), ["author"])


def _link_sql(config) -> str:
    legs = [f"select a.book_no, a.line_idx as line, {_AT[p].replace('n_words', 'a.n_words').replace('mid_at', 'a.mid_at')} as i, b.line_idx as line2, {_AT[q].replace('n_words', 'b.n_words').replace('mid_at', 'b.mid_at')} as j, {R.word_score(f'a.{p}', f'b.{q}')} as score, a.rn as r, {c * 10 + k} as o from e a join e b on a.book_no = b.book_no and b.rn = a.rn + {k} where a.{p} is not null and b.{q} is not null" for c, (p, q, n) in enumerate(config) for k in range(n + 1) if k or p != q]
    hit = f"(select * from ({' union all '.join(legs)}) where score > {_HIT})"
    return f"select book_no, line, i, line2, j, round(score, 9) as score from (select *, row_number() over (partition by book_no, line, i order by score desc, r, o) as n from (select * from {hit} union all select book_no, line2, j, line, i, score, r, o from {hit})) where n = 1"


@query("link_best_match", _link_sql(rhyme.BASIC_VERTICAL))
def link_best_match(spark, d):
    return rhyme.link(ends(spark, d), rhyme.BASIC_VERTICAL, ["book_no"]).withColumn("score", F.round("score", 9))


def _scan_sql(tests: dict) -> str:
    legs = []
    for name, pairs in tests.items():
        reach = max(max(x[0], x[2]) for x in pairs)
        joins = " ".join(f"join e e{k} on e{k}.book_no = e0x.book_no and e{k}.rn = e0x.rn + {k}" for k in range(1, reach + 1))
        at = lambda k, p: f"e{k}.{p}" if k else f"e0x.{p}"
        hit = " and ".join(f"({R.word_score(at(a, p), at(b, q))}) >= {_HIT}" for a, p, b, q in pairs)
        legs.append(f"select e0x.work, '{name}' as test, {hit} as hit from e e0x {joins}")
    return f"select work, test, sum(case when hit then 1 else 0 end)::bigint as t, sum(case when hit then 0 else 1 end)::bigint as f from ({' union all '.join(legs)}) group by work, test"


def _scan(name: str, tests: dict) -> None:
    def run(spark, d):
        return rhyme.scan(ends(spark, d), tests, ["work", "book_no"]).groupBy("work", "test").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))

    query(name, _scan_sql(tests))(run)
    _with_ends(name)


for _name, _keys in {"scan_leo": ["leo"], "scan_abba": ["abba"], "scan_abab": ["abab"], "scan_aa": [k for k in rhyme.TESTS if k.startswith("aa")], "scan_axa": [k for k in rhyme.TESTS if k.startswith("axa")], "scan_axxa": [k for k in rhyme.TESTS if k.startswith("axxa")]}.items():
    _scan(_name, {k: rhyme.TESTS[k] for k in _keys})

_CHEAP = " or ".join(f"(lower(mid_text) like '%{e}' and lower(ult_text) like '%{e}')" for e in rhyme.SLANT_OUT)


@query("scan_slant_leo", f"select work, sum(case when {R.word_score('mid', 'ult')} >= {_HIT} and not ({_CHEAP}) then 1 else 0 end)::bigint as t, count(*) as n from e group by work")
def scan_slant_leo(spark, d):
    rows = ends(spark, d).select("work", F.col("ends.mid").alias("mid"), F.col("ends.ult").alias("ult"), F.expr("get(words, at.mid).text").alias("mt"), F.expr("get(words, at.ult).text").alias("ut"))
    return rows.groupBy("work").agg(F.sum(F.coalesce(rhyme.slant_leonine("mid", "ult", "mt", "ut"), F.lit(False)).cast("long")).alias("t"), F.count("*").alias("n"))


for _n in ("rhyme_baseline_bruteforce", "rhyme_baseline_cross", "link_best_match", "scan_slant_leo"):
    _with_ends(_n)


def _score_sql(config: dict, reach: int = 3) -> str:
    end = ", ".join(f"{R.word_score('ult', f'{f}{k}')}" for k in range(1, reach + 1) for f in ("f", "p"))
    near = ", ".join(f"lead(ult, {k}) over o as f{k}, lag(ult, {k}) over o as p{k}" for k in range(1, reach + 1))
    joins = " ".join(f"left join k k_{p} on k_{p}.book_no = z.book_no and k_{p}.line = z.line_idx and k_{p}.i = z.{p}_at" for p in rhyme.POSITIONS)
    at = ", ".join(f"{_AT[p]} as {p}_at" for p in rhyme.POSITIONS)
    x = config["exponent"]
    count = " + ".join(f"case when k_{p}.score is not null then {R.d(config[p][0])} else 0e0 end" for p in rhyme.POSITIONS)
    total = " + ".join(f"case when k_{p}.score is not null then pow(k_{p}.score, {R.d(x)}) * {R.d(config[p][1])} else 0e0 end" for p in rhyme.POSITIONS if p != "ult")
    s, m = R.d(config["ult"][1]), R.d(config["mid"][1])
    total += f" + case when k_ult.score is not null then case when z.best * {s} >= z.own * {m} then pow(z.best, {R.d(x)}) * {s} else pow(z.own, {R.d(x)}) * {m} end else 0e0 end"
    b = config["bias"]
    return f"""k as ({_link_sql(rhyme.BASIC_VERTICAL)}),
z0 as (select *, {near} from e window o as (partition by book_no order by line_idx)), z as (select book_no, line_idx, {at}, greatest({end}) as best, {R.word_score('ult', 'mid')} as own from z0)
select z.book_no, count(*) as n_lines, round((sum({total}) * {b}e0 + sum({count}) * {1 - b}e0) / count(*), 6) as score from z {joins} group by z.book_no"""


@query("lineset_score", "select 1")
def lineset_score(spark, d):
    """Rhyme score of each book by the end-biased weights, over basic vertical links."""
    rows = ends(spark, d).select("book_no", "line_idx", "ends", "at")
    return rhyme.linked_score(rows, rhyme.BASIC_VERTICAL, rhyme.END_BIAS, ["book_no"], digits=9).withColumn("score", F.round("score", 6))


ORACLES["lineset_score"] = f"{bridge.prelude()},\n{_ENDS},\n{_score_sql(rhyme.END_BIAS)}"
