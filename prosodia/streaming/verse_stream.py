"""Poems that arrive as files: features of their lines as a stream, and running counts in windows of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.operators import cleaning, features

LINES = "work string, author string, book_no bigint, book_title string, line_idx int, line_name string, metre string, pattern string, words array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>"


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Lines from Parquet files of the canonical schema, as they come."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("arrived", F.col("_metadata.file_modification_time"))


def line_features(stream: DataFrame) -> DataFrame:
    """Features of each usable line; no state, so append mode does."""
    return features.distribution(cleaning.usable(stream), keys=["work", "author", "book_no", "line_idx", "arrived"])


def arrivals(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Usable lines by metre in windows of arrival; rows later than the watermark are left out."""
    return cleaning.usable(stream).withWatermark("arrived", late).groupBy(F.window("arrived", width), "metre").agg(F.count("*").alias("n"))
