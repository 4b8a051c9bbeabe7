"""Search, references, chunks of lines and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation.
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def grep(lines: DataFrame, pattern: str, distinct_text: bool = False) -> DataFrame:
    """Lines with a word that the pattern matches, case ignored; never across words. distinct_text: equal lines count once."""
    hit = lines.where(F.exists("words", lambda w: w["text"].rlike(f"(?i){pattern}")))
    return hit.dropDuplicates(["line_name", "metre", "pattern", "words"]) if distinct_text else hit


def plain_text() -> Column:
    return F.array_join(F.transform("words", lambda w: w["text"]), " ")


def bookref() -> Column:
    return F.format_string("%2s:%-3d", F.col("book_title"), F.col("line_name").cast("bigint"))


def numbered_text(lines: DataFrame, every: int, start_at: int, by: list[str]) -> DataFrame:
    """text, with its number before each `every`-th line and blanks of the same width before the others."""
    whole = Window.partitionBy(*by)
    n = F.row_number().over(whole.orderBy("line_idx")) + (start_at - 1)
    width = F.length((F.count("*").over(whole) + start_at).cast("string"))
    rows = lines.withColumns({"_n": n, "_w": width})
    mark = F.when(F.col("_n") % every == 0, F.lpad(F.col("_n").cast("string"), F.col("_w"), " ")).otherwise(F.repeat(F.lit(" "), F.col("_w")))
    return rows.withColumn("text", F.concat(mark, F.lit("  "), plain_text())).drop("_n", "_w")


def by_ref(lines: DataFrame, book: int, line: int, by: list[str]) -> DataFrame:
    """The line-th line (from 1; 0 is the last) of the book-th book of each work."""
    books = Window.partitionBy("work").orderBy("book_no")
    rows = lines.withColumns({"_b": F.dense_rank().over(books), "_l": F.row_number().over(Window.partitionBy(*by).orderBy("line_idx")), "_last": F.count("*").over(Window.partitionBy(*by))})
    return rows.where((F.col("_b") == book) & (F.col("_l") == (F.col("_last") if line == 0 else F.lit(line)))).drop("_b", "_l", "_last")


def bookrange(lines: DataFrame, by: list[str]) -> DataFrame:
    """`b:l--l` of each group, or `b:l--b:l` over books."""
    at = F.struct("book_no", "line_idx")
    ends = lines.groupBy(*by).agg(F.min_by(F.struct("book_title", "line_name"), at).alias("a"), F.max_by(F.struct("book_title", "line_name"), at).alias("z"))
    same = F.col("a.book_title") == F.col("z.book_title")
    return ends.select(*by, F.concat("a.book_title", F.lit(":"), "a.line_name", F.lit("--"), F.when(same, F.lit("")).otherwise(F.concat("z.book_title", F.lit(":"))), "z.line_name").alias("range"))


def indices_to_bookref(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(work, idx): (book, offset) of a running index over a work's lines: a join on ranges of the books' running counts."""
    counts = lines.groupBy("work", "book_no").agg(F.count("*").alias("n"))
    run = Window.partitionBy("work").orderBy("book_no")
    spans = counts.withColumns({"stop": F.sum("n").over(run), "book": F.row_number().over(run)}).withColumn("start", F.col("stop") - F.col("n"))
    w, s = wanted.alias("w"), spans.alias("s")
    return w.join(s, (F.col("w.work") == F.col("s.work")) & (F.col("w.idx") >= F.col("s.start")) & (F.col("w.idx") < F.col("s.stop"))).select("w.work", "w.idx", "s.book", (F.col("w.idx") - F.col("s.start")).alias("offset"))


def chunk_lines(lines: DataFrame, size: int, step: int, by: list[str], strict: bool = False, compat: bool = False) -> DataFrame:
    """Sliding chunks of `size` lines at every step-th line: (by, start, n, first_line, last_line). strict drops short chunks; compat starts
    none in the last `step` lines. Each line goes to the chunks that hold it, which are at most size / step, rounded up."""
    if step > size:
        raise ValueError("step is larger than size")
    rn = F.row_number().over(Window.partitionBy(*by).orderBy("line_idx")) - 1
    rows = lines.withColumns({"_rn": rn, "_all": F.count("*").over(Window.partitionBy(*by))})
    lo = F.greatest(F.ceil((F.col("_rn") - (size - 1)) / step), F.lit(0))
    rows = rows.withColumn("k", F.explode(F.sequence(lo, F.floor(F.col("_rn") / step)))).withColumn("start", F.col("k") * step)
    if compat:
        rows = rows.where(F.col("start") < F.col("_all") - step)
    out = rows.groupBy(*by, "start").agg(F.count("*").alias("n"), F.min_by("line_name", "line_idx").alias("first_line"), F.max_by("line_name", "line_idx").alias("last_line"))
    return out.where(F.col("n") == size) if strict else out


def word_stems(lines: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """How often each stem occurs: words without punctuation, lower-cased, cut to `most` letters; empty ones count too."""
    stem = F.substring(F.lower(F.translate("x.text", PUNCT, "")), 1, most)
    return lines.select(*by, F.explode("words").alias("x")).groupBy(*by, stem.alias("stem")).agg(F.count("*").alias("n"))


def without_propers(lines: DataFrame, least: int = 4) -> DataFrame:
    """(book keys, line_idx, text): lower-cased words, 8 for proper names. A proper name is seen where a capitalised word of `least` letters
    does not start a line, nor follow a full stop, question mark or quotation mark; then every word that is one once capitalised counts."""
    at = ["work", "author", "book_no", "line_idx"]
    ws = lines.select(*at, F.posexplode("words").alias("i", "w")).select(*at, "i", F.translate("w.text", PUNCT, "").alias("word"), F.regexp_extract("w.text", f"^({PUNCT_CLASS}*)", 1).alias("pre"), F.regexp_extract("w.text", f"({PUNCT_CLASS}*)$", 1).alias("post"))
    ws = ws.withColumn("before", F.lag("post").over(Window.partitionBy("book_no").orderBy("line_idx", "i")))
    seen = ws.where((F.col("i") > 0) & (F.length("word") >= least) & F.col("word").rlike("^[A-Z]") & ~F.coalesce(F.col("before"), F.lit("")).rlike("[?.]$") & ~F.col("pre").rlike("[\"']$"))
    proper = seen.select(F.initcap(F.lower("word")).alias("name")).distinct()
    marked = ws.withColumn("name", F.initcap(F.lower("word"))).join(proper.withColumn("p", F.lit(True)), "name", "left")
    word = F.when(F.col("p") & (F.col("word") != ""), F.lit("8")).otherwise(F.lower("word"))
    return marked.groupBy(*at).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", word.alias("t")))), lambda x: x["t"]), " ").alias("text"))


def string_chunks(lines: DataFrame, size: int, by: list[str], keep: str = "") -> DataFrame:
    """(by, chunk, text): lower-cased text of `size` consecutive lines, a line each, without punctuation but for `keep`; a short last chunk is
    dropped."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy("line_idx")) - 1
    rows = lines.select(*by, "line_idx", F.floor(rn / size).alias("chunk"), F.lower(F.translate(plain_text(), "".join(c for c in PUNCT if c not in keep), "")).alias("t"))
    out = rows.groupBy(*by, "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return out.where(F.col("n") == size).drop("n")


def punct_split(text: str) -> list[Column]:
    """pre, word and post of a word's text; text after punctuation inside a word is lost."""
    parts = F.split(F.col(text), f"{PUNCT_CLASS}+", -1)
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({PUNCT_CLASS}+)"), F.lit(1))
    n = F.size(parts)
    at_start = (n == 2) & (F.get(parts, F.lit(0)) == "")
    pre = F.when((n == 3) | at_start, F.get(runs, F.lit(0))).otherwise(F.lit(""))
    word = F.when((n == 3) | at_start, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    post = F.when(n == 3, F.get(runs, F.lit(1))).when((n == 2) & ~at_start, F.get(runs, F.lit(0))).otherwise(F.lit(""))
    return [pre.alias("pre"), word.alias("word"), post.alias("post")]
