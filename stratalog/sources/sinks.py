"""Sinks: year chunks with manifests, single artefacts, encoding repair, slim payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import repair_encoding


def with_year(rows: DataFrame, year: Column, *fallbacks: Column) -> DataFrame:
    """``year`` as text: the year, else the first four digits of a fallback's beginning, else `unknown`."""
    options = [F.nullif(year.cast("string"), F.lit("0")), *[F.nullif(F.regexp_extract(f, r"^(\d{4})", 1), F.lit("")) for f in fallbacks]]
    return rows.withColumn("year", F.coalesce(*options, F.lit("unknown")))


def year_manifest(rows: DataFrame, post: str | None = None) -> DataFrame:
    """Per year, latest first: rows (and distinct posts)."""
    counts = [F.count("*").alias("n")] + ([F.count_distinct(post).alias("posts")] if post else [])
    return rows.groupBy("year").agg(*counts).orderBy(F.desc("year"))


def write_year_chunks(rows: DataFrame, path: str, post: str | None = None) -> DataFrame:
    """Rows as JSON by year; returns the manifest, which is written beside them."""
    rows.write.mode("overwrite").partitionBy("year").json(f"{path}/chunks")
    manifest = year_manifest(rows, post)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_both(rows: DataFrame, full: str, public: str, hidden: list[str]) -> None:
    """The whole table in one place, without hidden columns in another."""
    rows.write.mode("overwrite").parquet(full)
    rows.drop(*hidden).write.mode("overwrite").parquet(public)


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """Rows with repaired encoding and whether that changed them."""
    fixed = rows.withColumn("fixed_", repair_encoding(F.col(column)))
    return fixed.withColumn("changed", ~F.col("fixed_").eqNullSafe(F.col(column))).withColumn(column, F.col("fixed_")).drop("fixed_")


def post_summary(posts: DataFrame) -> DataFrame:
    """Posts with their first image only, and counts."""
    return posts.withColumn("image_count", F.coalesce(F.size("images"), F.lit(0))).withColumn("images", F.slice("images", 1, 1))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, keys sorted."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
