"""Scanned poems in XML: document, divisions (optional), lines, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = "word array<struct<_sy:string,_wb:string,_mf:string,_VALUE:string>>"
LINE = f"struct<_name:string,_metre:string,_meter:string,_pattern:string,{WORD.replace('word ', 'word:')}>"
DIVISION = f"_title string, line array<{LINE}>"


def _lines(rows: DataFrame) -> DataFrame:
    words = F.transform("l.word", lambda w, i: F.struct(i.alias("idx"), F.trim(w["_VALUE"]).alias("text"), F.coalesce(w["_sy"], F.lit("")).alias("sy"), w["_wb"].alias("wb"), w["_mf"].alias("mf")))
    return rows.select("work", "author", "book_no", "book_title", "line_idx", F.col("l._name").alias("line_name"), F.col("l._metre").alias("metre"), F.col("l._meter").alias("meter"), F.col("l._pattern").alias("pattern"), F.coalesce(words, F.expr("cast(array() as array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>)")).alias("words"))


def read_poem(spark: SparkSession, paths: str | list[str], work: str | None = None, author: str | None = None) -> DataFrame:
    """lines of one work, of one or several files: the schema is fixed, so nothing is inferred. Files without divisions are one book. A
    file's divisions are numbered in order; several files follow one another."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("a work has a file at least")
    named = F.lit(work if work is not None else paths[0].rsplit("/", 1)[-1])
    parts = []
    for i, path in enumerate(paths):
        load = lambda tag, ddl, path=path: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
        books = load("division", DIVISION)
        if books.isEmpty():
            books = load("line", StructType.fromDDL(f"x {LINE}")["x"].dataType).select(F.struct("*").alias("l"), F.monotonically_increasing_id().alias("_i"), F.lit(0).alias("_k"), F.lit(None).cast("string").alias("book_title"))
        else:  # readers keep the order of a file
            books = books.withColumn("_k", F.monotonically_increasing_id()).select("_k", F.col("_title").alias("book_title"), F.posexplode("line").alias("_i", "l"))
        parts.append(books.select(F.lit(i).alias("_rank"), F.col("_k").cast("bigint").alias("_k"), F.col("_i").cast("bigint").alias("_i"), "book_title", F.col("l").cast(LINE).alias("l")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    work_ = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"book_no": F.dense_rank().over(work_.orderBy("_rank", "_k")), "line_idx": F.row_number().over(work_.orderBy("_rank", "_k", "_i")) - 1})
    return _lines(rows.withColumns({"work": named, "author": F.lit(author)}))


def read_corpus(spark: SparkSession, works: list[tuple[str | list[str], str, str]]) -> DataFrame:
    """lines of several works: (paths, work, author)."""
    out = None
    for paths, work, author in works:
        part = read_poem(spark, paths, work, author)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a corpus has a work at least")
    return out


def hexameter_frame(lines: DataFrame) -> DataFrame:
    """LN (digits of the line's name), Book, Work, Author and the line."""
    ln = F.nullif(F.regexp_replace("line_name", "[^0-9]", ""), F.lit("")).cast("int")
    rows = lines.select(ln.alias("LN"), F.col("book_no").alias("Book"), F.col("work").alias("Work"), F.col("author").alias("Author"), F.struct(*lines.columns).alias("XML"))
    spurious = (F.col("Book") == 8) & (F.col("Author") == "Silius") & F.col("LN").between(144, 223)
    return rows.withColumn("Author", F.when(spurious, F.lit("PsSilius")).otherwise(F.col("Author")))


def books_as_works(lines: DataFrame) -> DataFrame:
    """Each book as a work of its own, named by its work and number; the books of several works may stand together."""
    return lines.withColumn("work", F.concat_ws(" ", "work", F.col("book_no").cast("string")))


def write_text(lines: DataFrame, path: str, aligned: bool = False) -> None:
    """Lines as text, a blank line after each; overwrites. aligned: with their scansion and sounds below, word under word."""
    from prosodia.operators import phonology, search

    if aligned:
        rows = phonology.aligned(lines.select("work", "book_no", "line_idx", "words"))
        text = F.array_join("aligned", "\n")
    else:
        rows, text = lines, search.plain_text()
    rows.orderBy("work", "book_no", "line_idx").select(F.concat(text, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
