"""Queries over cleaned verse, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.functions import metre as M
from prosodia.operators import cleaning, features, search

from . import bridge

BOOK = ["work", "author", "book_no"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def cleaned(spark: SparkSession, sf_dir: str, rn: bool = True) -> DataFrame:
    rows = bridge.cleaned(spark, sf_dir)
    return rows if rn else rows.drop("rn")


def query(name: str, sql: str | None, clean: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{bridge.prelude(clean)}\n{sql}"
        return f

    return add


def _first(code: str, rows: str = "w x") -> str:
    """SQL: by line, the first non-null answer of the words."""
    return f"(select book_no, line_idx, arg_min(c, word_idx) as c from (select x.*, {code} as c from {rows}) where c is not null group by book_no, line_idx)"


def _per_line(cols: dict[str, str]) -> str:
    """SQL CTE body: line keys and first answers of several codes."""
    aggs = ", ".join(f"arg_min({n}, word_idx) filter (where {n} is not null) as {n}" for n in cols)
    return f"select work, author, book_no, line_idx, rn, metre, pattern, {aggs} from (select x.*, {', '.join(f'{c} as {n}' for n, c in cols.items())} from w x) group by work, author, book_no, line_idx, rn, metre, pattern"


@query("third_foot_rate", f"select work, count(*) as n_lines, sum(case when c is null or c = '-' then 1 else 0 end)::bigint as n_without from (select * from l where metre = 'H') left join {_first(M.caesura_code(3, True, 'x'))} using (book_no, line_idx) group by work")
def third_foot_rate(spark, d):
    """Hexameters, and those without a strict third-foot caesura, by work."""
    rows = cleaned(spark, d, False).where("metre = 'H'").select("work", F.expr(M.third_foot_caesura()).alias("c"))
    return rows.groupBy("work").agg(F.count("*").alias("n_lines"), F.sum(F.when(F.coalesce("c", F.lit(False)), 0).otherwise(1)).alias("n_without"))


_CAES = {f"c{n}": M.caesura_code(n, False, "x") for n in range(1, 6)}


@query("caesura_counts", f"select foot::int as foot, c as class, count(*) as n from ({' union all '.join(f'select {n} as foot, c{n} as c from ({_per_line(_CAES)})' for n in range(1, 6))}) group by foot, c")
def caesura_counts(spark, d):
    rows = cleaned(spark, d, False).select(F.explode(F.array(*[F.struct(F.lit(n).alias("foot"), F.expr(M.caesura(n)).alias("class")) for n in range(1, 6)])).alias("x"))
    return rows.groupBy("x.foot", "x.class").agg(F.count("*").alias("n"))


@query("caesurae_strings", f"select book_no, line_idx, c2 || c3 || c4 as nucleus from ({_per_line(_CAES)})")
def caesurae_strings(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", F.expr(M.caesurae()).alias("nucleus"))


_ELI = {f"e{n}": M.elision_code(n, "x") for n in range(1, 6)}


@query("elision_after_foot", f"select work, {', '.join(f'sum(case when e{n} then 1 else 0 end)::bigint as foot{n}' for n in range(1, 6))} from ({_per_line(_ELI)}) group by work")
def elision_after_foot(spark, d):
    return cleaned(spark, d, False).groupBy("work").agg(*[F.sum(F.expr(f"cast({M.elision_after_foot(n)} as int)")).alias(f"foot{n}") for n in range(1, 6)])


@query("elision_count", f"select book_no, line_idx, sum(case when {M.elided('x')} then 1 else 0 end)::int as elisions from w x group by book_no, line_idx")
def elision_count(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", F.expr(M.elision_count()).alias("elisions"))


def _dia(n: int) -> str:
    return f"bool_or({M.diaeresis_word(n, 'x')})"


@query("diaereses", f"select book_no, line_idx, {' || '.join(f'case when {_dia(n)} then {chr(39)}T{chr(39)} else {chr(39)}F{chr(39)} end' for n in range(1, 6))} as diaereses from w x group by book_no, line_idx")
def diaereses(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", F.expr(M.diaereses()).alias("diaereses"))


@query("has_bd_rate", f"select work, metre, count(*) as n, sum(case when b then 1 else 0 end)::bigint as n_bd from (select work, metre, book_no, line_idx, {_dia(4)} as b from w x group by all) group by work, metre")
def has_bd_rate(spark, d):
    return cleaned(spark, d, False).groupBy("work", "metre").agg(F.count("*").alias("n"), F.sum(F.expr(f"cast({M.bucolic_diaeresis()} as int)")).alias("n_bd"))


@query("stress_scansion", f"select book_no, line_idx, string_agg({M.word_scansion('x')}, ' ' order by word_idx) as scansion from w x group by book_no, line_idx")
def stress_scansion(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", F.expr(M.raw_scansion()).alias("scansion"))


_CON = {f"k{n}": M.conflict_code(n, "x") for n in range(1, 7)}


@query("harmony", f"select book_no, line_idx, {' || '.join(f'case when k{n} then {chr(39)}C{chr(39)} else {chr(39)}H{chr(39)} end' for n in range(1, 5))} as harmony from ({_per_line(_CON)}) where metre = 'H'")
def harmony(spark, d):
    return cleaned(spark, d, False).where("metre = 'H'").select("book_no", "line_idx", F.expr(M.harmony()).alias("harmony"))


@query("ictus_conflicts", f"select book_no, line_idx, ({' + '.join(f'k{n}::int' for n in range(1, 7))})::int as conflicts from ({_per_line(_CON)}) where metre = 'H'")
def ictus_conflicts(spark, d):
    return cleaned(spark, d, False).where("metre = 'H'").select("book_no", "line_idx", F.expr(M.ictus_conflicts()).alias("conflicts"))


@query("caps", "select work, sum(case when substr(text, 1, 1) <> lower(substr(text, 1, 1)) then 1 else 0 end)::bigint as n_caps from w group by work")
def caps(spark, d):
    return cleaned(spark, d, False).groupBy("work").agg(F.sum(F.expr(M.capitals())).alias("n_caps"))


_FINAL = "select book_no, line_idx, work, author, metre, rn, case when max(case when word_idx = n_words - 1 then sy end) <> '' then length(max(case when word_idx = n_words - 1 then sy end)) / 2.0 when max(case when word_idx = n_words - 1 then mf end) = 'PE' then length(max(case when word_idx = n_words - 2 then sy end)) / 2.0 end::double as syls from w group by all"


@query("final_word_syllables", f"select work, metre, syls, count(*) as n from ({_FINAL}) group by all")
def final_word_syllables(spark, d):
    return cleaned(spark, d, False).groupBy("work", "metre", F.expr(f"cast({M.final_syllables()} as double)").alias("syls")).agg(F.count("*").alias("n"))


@query("ceccarelli", f"select c as class, count(*) as n from (select * from l where metre = 'H') left join {_first(M.fourth_foot_code('x'))} using (book_no, line_idx) group by c")
def ceccarelli(spark, d):
    return cleaned(spark, d, False).where("metre = 'H'").groupBy(F.expr(M.first(M.fourth_foot_code())).alias("class")).agg(F.count("*").alias("n"))


_BOTH = _per_line({**_CAES, **_CON, **_ELI})
_BD = f"(select book_no, line_idx, {_dia(4)} as bd, {', '.join(f'{_dia(n)} as d{n}' for n in range(1, 6))} from w x group by book_no, line_idx)"
_CH = lambda n: f"case when k{n} then 'C' else 'H' end"


@query("predictors_by_foot", f"select book_no, line_idx, substr(pattern, 1, 1) || {_CH(1)} as f1, substr(pattern, 2, 1) || {_CH(2)} || c2 as f2, substr(pattern, 3, 1) || {_CH(3)} || c3 as f3, substr(pattern, 4, 1) || {_CH(4)} || c4 || case when bd then 'T' else 'F' end as f4 from ({_BOTH}) join {_BD} using (book_no, line_idx) where metre = 'H'")
def predictors_by_foot(spark, d):
    part = lambda n, *more: F.expr(f"concat(substr(pattern, {n}, 1), if({M.conflict(n)}, 'C', 'H'){''.join(', ' + m for m in more)})").alias(f"f{n}")
    return cleaned(spark, d, False).where("metre = 'H'").select("book_no", "line_idx", part(1), part(2, M.caesura(2)), part(3, M.caesura(3)), part(4, M.caesura(4), f"if({M.bucolic_diaeresis()}, 'T', 'F')"))


@query("predictors_by_feature", f"select book_no, line_idx, substr(pattern, 1, 4) as f1, {' || '.join(_CH(n) for n in (1, 2, 3, 4))} as f2, c2 || c3 || c4 as f3, case when bd then 'T' else 'F' end as f4 from ({_BOTH}) join {_BD} using (book_no, line_idx) where metre = 'H'")
def predictors_by_feature(spark, d):
    return cleaned(spark, d, False).where("metre = 'H'").select("book_no", "line_idx", F.expr("substr(pattern, 1, 4)").alias("f1"), F.expr(M.harmony()).alias("f2"), F.expr(M.caesurae()).alias("f3"), F.expr(f"if({M.bucolic_diaeresis()}, 'T', 'F')").alias("f4"))


def _sql_feature(f: str) -> str:
    n, kind = int(f[0]), f[1:]
    if kind == "SP":
        return f"(substr(replace(replace(pattern, '-', ''), '|', ''), {n}, 1) = 'S')::int"
    h, p = M.FEET["H"][n - 1], M.FEET["P"][n - 1]
    of = {"CF": lambda k: f"k{k}", "DI": lambda k: f"d{k}", "SC": lambda k: f"c{k} = 'S'", "WC": lambda k: f"c{k} = 'W'"}[kind]
    return f"coalesce(case when metre = 'H' then {of(h)} else {of(p)} end, false)::int"


_FEATS = f"select x1.*, {', '.join(f'{_sql_feature(f)} as {chr(34)}{f}{chr(34)}' for f in M.FEATURES)}, elc as \"ELC\" from ({_BOTH}) x1 join {_BD} using (book_no, line_idx) join (select book_no, line_idx, sum(case when mf = 'SY' then 1 else 0 end)::int as elc from w group by book_no, line_idx) using (book_no, line_idx)"
_NAMES = [*M.FEATURES, "ELC"]
_LIST = ", ".join(f'"{f}"' for f in _NAMES)


@query("binary_features", f"select work, author, book_no, line_idx, {_LIST} from ({_FEATS})")
def binary_features(spark, d):
    return features.distribution(cleaned(spark, d, False))


def _means(digits: int = 4) -> str:
    return ", ".join(f'round(avg("{f}"), {digits}) as "{f}"' for f in _NAMES)


@query("chunked_features", f"select work, author, book_no, rn // 4 as chunk, {_means()} from ({_FEATS}) group by work, author, book_no, rn // 4 having count(*) = 4")
def chunked_features(spark, d):
    return features.chunk_means(features.distribution(cleaned(spark, d)), 4, BOOK, "rn")


@query("centroid", f"select work, metre, {', '.join(f'round(avg({chr(34)}{f}{chr(34)}), 9) as {chr(34)}{f}{chr(34)}' for f in _NAMES)} from ({_FEATS}) group by work, metre")
def centroid(spark, d):
    feats = features.distribution(cleaned(spark, d, False), keys=["work", "metre"])
    return features.centroid(feats, ["work", "metre"]).select("work", "metre", *[F.round(f, 9).alias(f) for f in _NAMES])


@query("rechunk", f"select author, chunk, {_means()} from (select *, (row_number() over (partition by author order by book_no, line_idx) - 1) // 50 as chunk from ({_FEATS})) group by author, chunk having count(*) = 50")
def rechunk(spark, d):
    return features.rechunk(features.distribution(cleaned(spark, d, False)), 50, "author")


_SIDES = ", ".join(f'max(case when rn % 2 = {k} then "{f}" end) as "{p}{f}"' for k, p in ((0, "H"), (1, "P")) for f in M.FEATURES if p + f not in ("P3SP", "P4SP"))
_COUPLETS = f'select work, author, book_no, rn // 2 as couplet, {_SIDES}, sum("ELC")::bigint as "ELC" from ({_FEATS}) group by work, author, book_no, rn // 2 having count(*) = 2'


@query("metre_vectors", _COUPLETS)
def metre_vectors(spark, d):
    return features.couplets(cleaned(spark, d))


_CNAMES = [p + f for p in "HP" for f in M.FEATURES if p + f not in ("P3SP", "P4SP")]


@query("elegy_vector_metrical", f"select work, author, book_no, {', '.join(f'round(avg({chr(34)}{f}{chr(34)}), 9) as {chr(34)}{f}{chr(34)}' for f in _CNAMES)}, count(*) * 2 as \"LEN\" from ({_COUPLETS}) group by work, author, book_no")
def elegy_vector_metrical(spark, d):
    return features.couplets(cleaned(spark, d)).groupBy(*BOOK).agg(*[F.round(F.avg(f), 9).alias(f) for f in _CNAMES], (F.count("*") * 2).alias("LEN"))


@query("pf_sd", f"select work, round(stddev_samp(syls), 9) as pfsd from ({_FINAL}) where metre = 'P' group by work")
def pf_sd(spark, d):
    rows = cleaned(spark, d, False).where("metre = 'P'").select("work", F.expr(M.final_syllables()).cast("double").alias("s"))
    return rows.groupBy("work").agg(F.round(F.stddev_samp("s"), 9).alias("pfsd"))


@query("feature_moments", f"select work, name, round(avg(v), 9) as mean, round(var_pop(v), 9) as variance from (unpivot (select work, {_LIST} from ({_FEATS})) on {_LIST} into name name value v) group by work, name")
def feature_moments(spark, d):
    m = features.moments(features.distribution(cleaned(spark, d, False)), ["work"], [(f, f) for f in _NAMES])
    return m.select("work", F.col("a").alias("name"), F.round("mean_a", 9).alias("mean"), F.round("covariance", 9).alias("variance"))


_PAIRS = [("1SP", "2SP"), ("1CF", "4SC"), ("4DI", "3SC"), ("2WC", "ELC")]


@query("covariance_long", " union all ".join(f"select work, '{a}' as a, '{b}' as b, round(covar_pop(\"{a}\", \"{b}\"), 9) + 0.0 as covariance from f group by work" for a, b in _PAIRS).join(["with f as (" + _FEATS + ") select * from (", ")"]))
def covariance_long(spark, d):
    m = features.moments(features.distribution(cleaned(spark, d, False)), ["work"], _PAIRS)
    return m.select("work", "a", "b", (F.round("covariance", 9) + F.lit(0.0)).alias("covariance"))


ORACLES["covariance_long"] = ORACLES["covariance_long"].replace("\nwith f as (", ",\nf as (", 1)


@query("clean_counts", "select work, metre, count(*) as n from l group by work, metre")
def clean_counts(spark, d):
    """By the operator for lines in rows, which shuffles by book."""
    return cleaning.clean(bridge.lines(spark, d), ["book_no"]).groupBy("work", "metre").agg(F.count("*").alias("n"))


@query("orphan_filter", "select book_no, line_idx, metre from l")
def orphan_filter(spark, d):
    return cleaning.numbered(cleaning.clean(bridge.lines(spark, d), ["book_no"]), ["book_no"]).select("book_no", "line_idx", "metre")


@query("bookinate_counts", "select work || ' ' || book_no as title, count(*) as n_lines, max(case when metre = 'P' then 1 else 0 end)::int as elegiac from l group by work, book_no")
def bookinate_counts(spark, d):
    return cleaned(spark, d, False).groupBy(F.concat_ws(" ", "work", F.col("book_no").cast("string")).alias("title")).agg(F.count("*").alias("n_lines"), F.max(F.expr("cast(metre = 'P' as int)")).alias("elegiac"))


def _sql_pattern() -> str:
    n = lambda k: f"(length(sys) - length(replace(sys, '{k}', '')))"
    f = lambda k: f"case {n(k)} when 2 then 'S' when 3 then 'D' end"
    return f"case when {n(3)} = 1 then {f(1)} || {f(2)} || '-|' || {f(4)} || {f(5)} || '-' else {f(1)} || {f(2)} || {f(3)} || {f(4)} end"


@query("fix_meters_pattern", f"select book_no, line_idx, case when contains(sys, '6A6X') or contains(sys, '6A6T7') then 'H' when not contains(sys, '6A') then 'P' end as metre, {_sql_pattern()} as pattern from (select book_no, line_idx, string_agg(sy, '' order by word_idx) as sys from raw where pattern is not null and pattern not in ('corrupt', 'not scanned') group by book_no, line_idx)", clean=False)
def fix_meters_pattern(spark, d):
    return cleaning.fix_meters(cleaning.usable(bridge.lines(spark, d))).select("book_no", "line_idx", "metre", "pattern")


@query("grep_lines", "select distinct book_no, line_idx from raw where regexp_matches(text, '(?i)th?ion')", clean=False)
def grep_lines(spark, d):
    return search.grep(bridge.lines(spark, d), "th?ion").select("book_no", "line_idx")


@query("plain_lines", "select book_no, line_idx, string_agg(text, ' ' order by word_idx) as text from w group by book_no, line_idx")
def plain_lines(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", search.plain_text().alias("text"))


@query("numbered_lines", "select book_no, line_idx, case when n % 5 = 0 then lpad(n::varchar, width, ' ') else repeat(' ', width) end || '  ' || text as text from (select *, rn + 1 as n, length((count(*) over (partition by book_no) + 1)::varchar)::int as width from (select book_no, line_idx, rn, string_agg(text, ' ' order by word_idx) as text from w group by book_no, line_idx, rn))")
def numbered_lines(spark, d):
    return search.numbered_text(cleaned(spark, d, False), 5, 1, ["book_no"]).select("book_no", "line_idx", "text")


@query("bookref_format", "select book_no, line_idx, format('{:>2}:{:<3}', book_no::varchar, (line_idx + 1)::varchar) as ref from l")
def bookref_format(spark, d):
    return cleaned(spark, d, False).select("book_no", "line_idx", search.bookref().alias("ref"))


@query("by_ref", "select work, book_no, line_idx from (select *, dense_rank() over (partition by work order by book_no) as b from l) where b = 2 and rn = 2")
def by_ref(spark, d):
    return search.by_ref(cleaned(spark, d, False), 2, 3, ["book_no"]).select("work", "book_no", "line_idx")


@query("bookrange", "select author, arg_min(book_no, (book_no, line_idx)) || ':' || arg_min(line_idx + 1, (book_no, line_idx)) || '--' || case when min(book_no) = max(book_no) then '' else max(book_no) || ':' end || arg_max(line_idx + 1, (book_no, line_idx)) as range from l group by author")
def bookrange(spark, d):
    return search.bookrange(cleaned(spark, d, False), ["author"])


@query("indices_to_bookref", 'select b.work, q.idx, b.book, (q.idx - b.start)::bigint as "offset" from (select work, book_no, row_number() over (partition by work order by book_no) as book, (sum(n) over (partition by work order by book_no) - n)::bigint as start, n from (select work, book_no, count(*) as n from l group by work, book_no)) b join (select work, unnest(range(0, 200, 7)) as idx from (select distinct work from l)) q on q.work = b.work and q.idx >= b.start and q.idx < b.start + b.n')
def indices_to_bookref(spark, d):
    rows = cleaned(spark, d, False)
    wanted = rows.select("work").distinct().select("work", F.explode(F.expr("sequence(0L, 196L, 7L)")).alias("idx"))
    return search.indices_to_bookref(rows, wanted)


@query("chunk_lines", "select book_no, start, count(*) as n, arg_min(line_idx + 1, line_idx)::varchar as first_line, arg_max(line_idx + 1, line_idx)::varchar as last_line from (select l.*, s.start from l join (select book_no, rn as start from l where rn % 3 = 0) s on s.book_no = l.book_no and l.rn between s.start and s.start + 5) group by book_no, start")
def chunk_lines(spark, d):
    return search.chunk_lines(cleaned(spark, d, False), 6, 3, ["book_no"])


_DEPUNCT = "translate(text, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')"


@query("common_wordstems", f"select work, substr(lower({_DEPUNCT}), 1, 5) as stem, count(*) as n from w group by all")
def common_wordstems(spark, d):
    return search.word_stems(cleaned(spark, d, False), ["work"])


@query("string_chunks", f"select book_no, chunk, string_agg(t, chr(10) order by line_idx) as text from (select book_no, line_idx, rn // 4 as chunk, lower(translate(string_agg(text, ' ' order by word_idx), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')) as t from w group by book_no, line_idx, rn) group by book_no, chunk having count(*) = 4")
def string_chunks(spark, d):
    return search.string_chunks(cleaned(spark, d, False), 4, ["book_no"])


_PC = r"[!-/:-@\[-`{-~]"


@query("propers_removed", f"""select work, author, book_no, line_idx, string_agg(case when p.name is not null and word <> '' then '8' else lower(word) end, ' ' order by word_idx) as text from
 (select *, upper(substr(word, 1, 1)) || lower(substr(word, 2)) as name from z) z1 left join (select distinct upper(substr(word, 1, 1)) || lower(substr(word, 2)) as name from z where word_idx > 0 and length(word) >= 4 and regexp_matches(word, '^[A-Z]') and not regexp_matches(coalesce(before, ''), '[?.]$') and not regexp_matches(pre, '["'']$')) p on p.name = z1.name group by work, author, book_no, line_idx""")
def propers_removed(spark, d):
    return search.without_propers(cleaned(spark, d, False))


ORACLES["propers_removed"] = ORACLES["propers_removed"].replace("\nselect work, author", f""",
z as (select *, lag(post) over (partition by book_no order by line_idx, word_idx) as before from (select work, author, book_no, line_idx, word_idx, {_DEPUNCT} as word, regexp_extract(text, '^({_PC}*)', 1) as pre, regexp_extract(text, '({_PC}*)$', 1) as post from w))
select work, author""", 1)


@query("punct_split", f"""select text, case when n = 3 or (n = 2 and parts[1] = '') then runs[1] else '' end as pre, case when n = 3 or (n = 2 and parts[1] = '') then parts[2] else parts[1] end as word,
 case when n = 3 then runs[2] when n = 2 and parts[1] <> '' then runs[1] else '' end as post from (select text, regexp_split_to_array(text, '{_PC}+') as parts, len(regexp_split_to_array(text, '{_PC}+')) as n, regexp_extract_all(text, '{_PC}+') as runs from (select distinct text from raw))""", clean=False)
def punct_split(spark, d):
    words = bridge.lines(spark, d).select(F.explode("words.text").alias("text")).distinct()
    return words.select("text", *search.punct_split("text"))


@query("scansion_strings", "select distinct text, list_filter(range(0, length(text)), lambda i: text[i + 1] <> ' ')::int[] as marks, list_filter(range(0, length(text)), lambda i: text[i + 1] = ' ')::int[] as blanks from (select string_agg(sy, ' ' order by word_idx) as text from raw group by book_no, line_idx)", clean=False)
def scansion_strings(spark, d):
    """Places of marks and blanks in the distinct scansions."""
    from prosodia.functions import strings

    rows = bridge.lines(spark, d).select(F.array_join(F.transform("words", lambda w: w["sy"]), " ").alias("text")).distinct()
    return rows.select("text", F.to_json(strings.mark_places(F.col("text"))).alias("marks"), F.to_json(strings.blank_places(F.col("text"))).alias("blanks"))


ORACLES["scansion_strings"] = ORACLES["scansion_strings"].replace("::int[] as marks", "::int[]::json::varchar as marks").replace("::int[] as blanks", "::int[]::json::varchar as blanks")
