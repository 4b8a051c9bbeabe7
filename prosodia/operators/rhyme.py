"""Rhyme between words of nearby lines: links, scores of passages, pattern scans and rates.

Lines carry `ends: struct<first, ult, penult, mid>` of words (functions.rhyme), each null where the line has no such word. Links and scans score whole groups
in Arrow batches (operators.nearby); elsewhere lines look at those that follow by lead() over their group, never by a self-join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions import closeness as C
from prosodia.functions import rhyme as R

from . import nearby

POSITIONS = nearby.POSITIONS
#: Fixed values: (position, position in a later line, lines ahead at most), in the order that ties go by.
BASIC_VERTICAL = [("ult", "mid", 0), ("ult", "ult", 3), ("penult", "penult", 3), ("mid", "mid", 2)]
VERTICAL_PLUS = [("first", "first", 3), *BASIC_VERTICAL]
VERTICAL_INIT = [("first", "first", 2), ("ult", "mid", 0), ("ult", "ult", 2), ("penult", "penult", 2), ("mid", "mid", 2)]
LEONINE = [("mid", "ult", 0)]
#: Patterns over consecutive lines: (line, position, line, position) that must all rhyme.
TESTS = {
    "leo": [(0, "ult", 0, "mid")],
    "abba": [(0, "ult", 3, "ult"), (1, "ult", 2, "ult")],
    "abab": [(0, "ult", 2, "ult"), (1, "ult", 3, "ult")],
    **{f"aa {p}": [(0, k, 1, k)] for p, k in (("-1", "ult"), ("-2", "penult"), ("mid", "mid"), ("0", "first"))},
    **{f"axa {p}": [(0, k, 2, k)] for p, k in (("-1", "ult"), ("-2", "penult"), ("mid", "mid"), ("0", "first"))},
    **{f"axxa {p}": [(0, k, 3, k)] for p, k in (("-1", "ult"), ("-2", "penult"), ("mid", "mid"), ("0", "first"))},
}
#: Endings whose agreement is too cheap for a slant rhyme.
SLANT_OUT = ("os", "is", "as", "us", "es", "um", "ae", "am")


def with_ends(lines: DataFrame, word: str) -> DataFrame:
    """word: SQL for a word of the lambda variable x (a struct of text, sy and more)."""
    pick = lambda w: f"transform(filter(array({w}), x -> x is not null), x -> {word})"
    mid = "get(filter(words, x -> x.sy like '%3A' or x.sy like '%3b'), 0)"
    at = {"first": "get(words, 0)", "ult": "get(words, size(words) - 1)", "penult": "get(words, size(words) - 2)", "mid": mid}
    out = lines.withColumn("ends", F.struct(*[F.get(F.expr(pick(w)), F.lit(0)).alias(p) for p, w in at.items()]))
    return out.withColumn("at", F.struct(F.lit(0).alias("first"), (F.size("words") - 1).alias("ult"), (F.size("words") - 2).alias("penult"), F.expr(f"{mid}.idx").alias("mid")))


def scored(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with the score of two words for each name. The last syllables are scored in a projection of their own, as the word's score names them
    several times: so they are worked out once, and the generated code stays small."""
    ends = {f"_f_{n}": F.expr(R.final_score(f"{a}.f", f"{b}.f")) for n, (a, b) in pairs.items()}
    words = {n: F.expr(R.word_score(a, b, True, f"`_f_{n}`")) for n, (a, b) in pairs.items()}
    return rows.withColumns(ends).withColumns(words).drop(*ends)


def _window(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def link(ends: DataFrame, config: list[tuple[str, str, int]], by: list[str], threshold: float = R.THRESHOLD, order: str = "line_idx") -> DataFrame:
    """(by, line, i, line2, j, score): the best partner above the threshold of each word; of equal ones the first met."""
    return nearby.link(ends, config, by, threshold, order)


def _holds(score: Column, op: str = ">=", threshold: float = R.THRESHOLD) -> Column:
    return {">=": score >= threshold, ">": score > threshold, "<": score < threshold, "<=": score <= threshold}[op]


def build_filter(tests: list[tuple], length: int, name: str, baseline: tuple[str, str] | None = None, cross: bool = False) -> dict:
    """A pattern over `length` consecutive lines: tuples (line, position, line, position[, operator, threshold]) that must all hold. baseline:
    positions whose words' rate is what chance would give; cross: that of words of the two metres."""
    if any(not 0 <= x[k] < length for x in tests for k in (0, 2)):
        raise ValueError(f"{name}: a line is outside of the window")
    return {"name": name, "tests": tests, "length": length, "baseline": baseline or (tests[0][1], tests[0][3]), "cross": cross}


def gather(ends: DataFrame, made: dict, by: list[str], order: str = "line_idx") -> DataFrame:
    """(by, start, score): windows that show a pattern of build_filter, with the sum of its scores."""
    w = _window(by, order)
    rows = ends.withColumns({f"_e{k}": F.lead("ends", k).over(w) for k in range(1, made["length"])}).withColumns({"_e0": F.col("ends"), "_end": F.lead(order, made["length"] - 1).over(w)})
    names = {f"_s{k}": (f"_e{x[0]}.{x[1]}", f"_e{x[2]}.{x[3]}") for k, x in enumerate(made["tests"])}
    rows = scored(rows.where("_end is not null"), names)
    hit, total = F.lit(True), F.lit(0.0)
    for n, x in zip(names, made["tests"], strict=True):
        hit, total = hit & _holds(F.col(n), *x[4:]), total + F.col(n)
    return rows.where(hit).select(*by, F.col(order).alias("start"), total.alias("score"))


def scan_report(ends: DataFrame, made: dict, by: list[str], least: int = 20, share: float = 0.1, order: str = "line_idx") -> DataFrame:
    """(by, start, score, place): of each group the best windows of a pattern, `least` of them or that share, whichever is more. A top-k report."""
    found = gather(ends, made, by, order)
    w = Window.partitionBy(*by)
    rows = found.withColumns({"place": F.row_number().over(w.orderBy(F.col("score").desc(), "start")), "_n": F.count("*").over(w)})
    return rows.where(F.col("place") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share))).drop("_n")


def scan(ends: DataFrame, tests: dict, by: list[str], order: str = "line_idx", metre: str | None = None, compat: bool = False) -> DataFrame:
    """(by, test, t, f): windows of consecutive lines that show each pattern, and those that do not. metre: windows that start so; compat
    leaves a group's last window out."""
    return nearby.scan(ends, tests, by, R.THRESHOLD, order, metre, compat)


def slant_leonine(mid: str, ult: str, mid_text: str, ult_text: str) -> Column:
    """A rhyme of middle and end that is more than a shared common ending."""
    cheap = " or ".join(f"(lower({mid_text}) like '%{e}' and lower({ult_text}) like '%{e}')" for e in SLANT_OUT)
    return F.expr(f"({R.word_score(mid, ult, True)}) >= {R.d(R.THRESHOLD)} and not ({cheap})")


_FLAT = ["n", "np", *[f"{x}_{k}" for x in "sf" for k in ("onset", "nucleus", "coda", "vowel")]]


def _flat(word: str) -> list[Column]:
    """The parts of a word that scores read."""
    part = lambda x, k: F.lit("") if x + k == "sonset" else F.col(f"{word}.{x}.{k}")
    return [F.least(f"{word}.n", F.lit(2)).alias("n"), F.col(f"{word}.np").alias("np"), *[part(x, k).alias(f"{x}_{k}") for x in "sf" for k in ("onset", "nucleus", "coda", "vowel")]]


def _deal(parts: int) -> Column:
    return F.pmod(F.xxhash64("f_onset", "f_nucleus", "f_coda", "np"), F.lit(parts)).cast("int")


def _met(left: pd.DataFrame, right: pd.DataFrame, threshold: float, alone: bool) -> tuple[int, int]:
    """(hits, tries) of kinds of words, with their counts c; alone: of one side with itself, in either order, each pair twice."""
    tuples = lambda df: [(r[0], r[1], r[2:6], r[6:10]) for r in zip(*[df[c].tolist() for c in _FLAT], strict=True)]
    own = tuples(left)
    h = C.hits(C.Parts(own, left["c"].to_numpy()), C.Parts(tuples(right), right["c"].to_numpy()), threshold, alone)
    m = int(left["c"].sum()) * int(right["c"].sum())
    if alone:  # a word with itself
        h -= sum(c for w, c in zip(own, left["c"].tolist(), strict=True) if C.word(w, w) >= threshold)
        m -= int(left["c"].sum())
    return h, m


def rates_of(ends: DataFrame, by: list[str], asked: dict[str, tuple], threshold: float = R.THRESHOLD, parts: int = 8) -> DataFrame:
    """(by, name, hits, tries, there, lines, there2, lines2): rate() for several pairs of positions at once, over lines that are read once. asked: by name
    (metre, position, metre, position), a null metre for all lines; where both sides are one, it is met with itself. there: lines with such a word, of all."""
    positions = list(dict.fromkeys(p for x in asked.values() for p in (x[1], x[3])))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"ends.{p}").alias("w")) for p in positions])).alias("_x")
    rows = ends.select(*by, "metre", each).select(*by, "metre", F.col("_x.p").alias("_p"), F.col("_x.w").isNotNull().alias("_w"), *_flat("_x.w"))
    kinds = rows.groupBy(*by, "metre", "_p", "_w", *_FLAT).agg(F.count("*").alias("c")).withColumn("_deal", _deal(parts)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = ["name", "h", "m", "there", "lines", "there2", "lines2"]

    def met(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, (m, p, m2, p2) in asked.items():
            sides = [df[(df["_p"] == q) & ((df["metre"] == k) if k else True)] for k, q in ((m, p), (m2, p2))]
            words = [x[x["_w"]] for x in sides]
            n = [int(x["c"].sum()) for x in (words[0], sides[0], words[1], sides[1])]
            if n[1] and n[3]:
                own = words[0][words[0]["_deal"] == df["_part"].iloc[0]]
                out.append([*[df[k].iloc[0] for k in by], name, *(_met(own, words[1], threshold, (m, p) == (m2, p2)) if len(own) and len(words[1]) else (0, 0)), *n])
        return pd.DataFrame(out, columns=[*by, *names])

    kind = {f.name: f.dataType.simpleString() for f in ends.select(*by).schema.fields}
    schema = ", ".join([*(f"`{k}` {t}" for k, t in kind.items()), "name string", *(f"{n} bigint" for n in names[1:])])
    half = F.when(F.col("name").isin([k for k, x in asked.items() if x[:2] == x[2:]]), 2).otherwise(1)
    found = kinds.groupBy(*by, "_part").applyInPandas(met, schema).groupBy(*by, "name").agg(F.sum("h").alias("h"), F.sum("m").alias("m"), *[F.max(n).alias(n) for n in names[3:]])
    return found.withColumn("_half", half).selectExpr(*[f"`{k}`" for k in by], "name", "h div _half as hits", "m div _half as tries", *names[3:])


def rate(one: DataFrame, other: DataFrame | None, by: list[str], word: str = "word", threshold: float = R.THRESHOLD, parts: int = 8) -> DataFrame:
    """(by, hits, tries) over all pairs of one's words with the other's, or of one's with each other, in either order. Equal words are counted
    first. A group's kinds are dealt in `parts` and met by all kinds of the other side, so a task holds kinds of words, never rows; there pairs of endings are
    scored once, and words are compared only where their endings are near enough (functions.closeness). What no score reads does not tell kinds apart:
    the onset of the stressed syllable, and numbers of syllables above one."""
    flat = _flat(word)

    def kinds(df: DataFrame) -> DataFrame:
        return df.where(f"{word} is not null").select(*by, *flat).groupBy(*by, *_FLAT).agg(F.count("*").alias("c"))

    alone = other is None
    a = kinds(one)
    b = a if alone else kinds(other)
    a, b = a.withColumn("_part", _deal(parts)), b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*[F.col(c).alias(c) for c in [*b.columns, "_part"]])
    keys = [*by, "_part"]
    kind = {f.name: f.dataType.simpleString() for f in one.select(*by).schema.fields}

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*by, "h", "m"])

        h, m = _met(left, right, threshold, alone)
        return pd.DataFrame([[*[left[k].iloc[0] for k in by], h, m]], columns=[*by, "h", "m"])

    schema = ", ".join(f"`{k}` {t}" for k, t in kind.items()) + ", h bigint, m bigint"
    pairs = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(met, schema)
    half = 2 if alone else 1
    return pairs.groupBy(*by).agg(F.expr(f"sum(h) div {half}").alias("hits"), F.expr(f"sum(m) div {half}").alias("tries")).where("tries > 0")


def sampled_rates(one: DataFrame, other: DataFrame, by: list[str], n: int, each: int, seed: int, word: str = "word", threshold: float = R.THRESHOLD) -> DataFrame:
    """(by, replicate, hits, tries): n times the rate of `each` pairs drawn with replacement from a word of one and a word of the other. A sampling
    operator: what is drawn are places among the kinds of words by their running counts, and only kinds are joined."""

    def kinds(df: DataFrame, c: str) -> DataFrame:
        found = df.where(f"{word} is not null").groupBy(*by, F.col(word).alias(c)).agg(F.count("*").alias("k"))
        run = Window.partitionBy(*by).orderBy(F.xxhash64(c), F.to_json(c))
        return found.select(*by, c, (F.sum("k").over(run) - F.col("k")).alias(f"lo_{c}"), F.sum("k").over(run).alias(f"hi_{c}"))

    a, b = kinds(one, "a"), kinds(other, "b")
    sizes = a.groupBy(*by).agg(F.max("hi_a").alias("na")).join(b.groupBy(*by).agg(F.max("hi_b").alias("nb")), by)
    drawn = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    drawn = drawn.withColumns({f"p{c}": F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *by, "replicate", "k"), F.col(f"n{c}")) for c in "ab"})

    def found(rows: DataFrame, side: DataFrame, c: str) -> DataFrame:
        """rows with the kind at place p: places and the kinds' ends in one order, each place taking the next end."""
        ends = side.select(*by, F.col(f"hi_{c}").alias(f"p{c}"), c, F.lit(0).alias("_o"))
        both = rows.withColumns({c: F.lit(None).cast(side.schema[c].dataType), "_o": F.lit(1)}).unionByName(ends, allowMissingColumns=True)
        after = Window.partitionBy(*by).orderBy(F.col(f"p{c}").desc(), "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # an end hi belongs to places below it; going down, the last end met is the least one above a place
        return both.withColumn(c, F.last(c, ignorenulls=True).over(after)).where("_o = 1").drop("_o")

    rows = found(drawn, a.withColumn("hi_a", F.col("hi_a") - 1), "a")
    rows = found(rows, b.withColumn("hi_b", F.col("hi_b") - 1), "b")
    pairs = scored(rows, {"score": ("a", "b")})
    return pairs.groupBy(*by, "replicate").agg(F.sum((F.col("score") >= threshold).cast("long")).alias("hits"), F.count("*").alias("tries"))


def sampled_rate(one: DataFrame, other: DataFrame, by: list[str], n: int, seed: int, word: str = "word", threshold: float = R.THRESHOLD) -> DataFrame:
    """(by, hits, tries): the rate of n pairs drawn with replacement."""
    return sampled_rates(one, other, by, 1, n, seed, word, threshold).drop("replicate")


def brute_or_sampled(one: DataFrame, other: DataFrame, by: list[str], most: int, seed: int, word: str = "word") -> DataFrame:
    """(by, hits, tries): the exact rate of groups with fewer than `most` pairs, a sampled one of most / 100 pairs of the others (a reference's
    option; `rate` itself has no such limit)."""
    count = lambda df, c: df.where(f"{word} is not null").groupBy(*by).agg(F.count("*").alias(c))
    large = count(one, "x").join(count(other, "y"), by).where(F.col("x") * F.col("y") >= most).select(*by)
    few = lambda df: df.join(large, by, "left_anti")
    many = lambda df: df.join(large, by, "left_semi")
    return rate(few(one), few(other), by, word).unionByName(sampled_rate(many(one), many(other), by, max(1, most // 100), seed, word))


def linked_score(ends: DataFrame, links: list[tuple[str, str, int]], config: dict, by: list[str], order: str = "line_idx", reach: int = 3, digits: int | None = None) -> DataFrame:
    """(by, n_lines, score): score() over link() of the config `links`, in one pass. digits: of links' scores."""
    return nearby.passages(ends, links, config, by, R.THRESHOLD, order, reach, digits)


#: Weights by position (count, score), the share of the score, and the exponent of a match.
NEUTRAL = {"first": (1.0, 1.0), "mid": (1.0, 1.0), "penult": (1.0, 1.0), "ult": (1.0, 1.0), "bias": 0.5, "exponent": 2.4}
END_BIAS = {"first": (1.0, 0.5), "mid": (1.0, 0.5), "penult": (0.8, 0.8), "ult": (1.2, 1.0), "bias": 0.5, "exponent": 2.4}
END_RHYMES = {"first": (0.0, 0.0), "mid": (0.0, 0.0), "penult": (0.0, 0.0), "ult": (1.0, 1.0), "bias": 0.5, "exponent": 2.4}
MID_RHYMES = {"first": (0.0, 0.0), "mid": (1.0, 1.0), "penult": (0.0, 0.0), "ult": (0.0, 0.0), "bias": 0.5, "exponent": 2.4}


def score(ends: DataFrame, links: DataFrame, config: dict, by: list[str], order: str = "line_idx", reach: int = 3) -> DataFrame:
    """(by, n_lines, score) of passages: linked words count by position, and score by their best match; a linked last word scores by its best end
    rhyme within `reach` lines or its rhyme with its own middle, whichever weighs more. A word's own line is no partner of its end. Positions
    that are the same word count each."""
    w = _window(by, order)
    near = [F.lead("ends.ult", k).over(w) for k in range(1, reach + 1)], [F.lag("ends.ult", k).over(w) for k in range(1, reach + 1)]
    rows = ends
    names = []
    for k, (ahead, behind) in enumerate(zip(*near, strict=True), 1):
        rows = rows.withColumns({f"_f{k}": ahead, f"_p{k}": behind})
        names += [f"_f{k}", f"_p{k}"]
    rows = rows.withColumn("_u", F.col("ends.ult"))
    rows = scored(rows, {**{f"_s{n}": ("_u", n) for n in names}, "_own": ("_u", "ends.mid")})
    rows = rows.withColumn("_end", F.greatest(*[F.col(f"_s{n}") for n in names]))
    match = links.groupBy(*by, "line").agg(F.map_from_entries(F.collect_list(F.struct("i", "score"))).alias("_m"))
    rows = rows.join(match.withColumnRenamed("line", order), [*by, order], "left")
    count, total = F.lit(0.0), F.lit(0.0)
    for p in POSITIONS:
        c, s = config[p]
        linked = F.try_element_at("_m", F.col(f"at.{p}"))
        count = count + F.when(linked.isNotNull(), F.lit(c)).otherwise(0.0)
        if p == "ult":
            mid_weight = config["mid"][1]
            chosen = F.when(F.col("_end") * s >= F.col("_own") * mid_weight, F.pow("_end", F.lit(config["exponent"])) * s).otherwise(F.pow("_own", F.lit(config["exponent"])) * mid_weight)
            total = total + F.when(linked.isNotNull(), chosen).otherwise(0.0)
        else:
            total = total + F.when(linked.isNotNull(), F.pow(linked, F.lit(config["exponent"])) * s).otherwise(0.0)
    b = config["bias"]
    return rows.groupBy(*by).agg(F.count("*").alias("n_lines"), ((F.sum(total) * b + F.sum(count) * (1 - b)) / F.count("*")).alias("score"))
