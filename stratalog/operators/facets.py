"""Facets and calendars: counts by year, season, theme; the category cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(rows: DataFrame, key: Column, spine: DataFrame | None = None, keep_zero: bool = True) -> DataFrame:
    """Counts of a key; with a ``spine`` (id, label) its ids only, zeros kept or dropped."""
    counts = rows.select(key.alias("id")).groupBy("id").agg(F.count("*").alias("n_"))
    if spine is None:
        return counts.withColumnRenamed("n_", "n")
    out = spine.join(counts, "id", "left" if keep_zero else "inner")
    return out.select(*spine.columns, F.coalesce("n_", F.lit(0)).alias("n"))


def calendar_cube(rows: DataFrame, category: str, year: Column, month: Column, season: Column) -> DataFrame:
    """Counts by category with year and month, year and season, month, season, and in all; rows without year or month are left out."""
    keyed = rows.select(F.col(category).alias("category"), year.alias("year"), month.alias("month"), season.alias("season")).where("year is not null and month is not null")
    view = keyed.groupingSets([["category", "year", "month"], ["category", "year", "season"], ["category", "month"], ["category", "season"], ["category"]], "category", "year", "month", "season")
    return view.agg(F.count("*").alias("n"))


def dense_years(cube: DataFrame) -> DataFrame:
    """Every (category, year) between a category's first and last year, with its total."""
    totals = cube.where("year is not null and month is not null").groupBy("category", "year").agg(F.sum("n").alias("n_"))
    spans = totals.groupBy("category").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    spine = spans.select("category", F.explode(F.sequence("lo", "hi")).alias("year"))
    return spine.join(totals, ["category", "year"], "left").select("category", "year", F.coalesce("n_", F.lit(0)).alias("n"))


def month_arrays(cube: DataFrame) -> DataFrame:
    """Per category twelve counts of all years."""
    cells = cube.where("year is null and month is not null").groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("m"))
    return cells.select("category", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("months"))


def group_confidences(tags: DataFrame) -> DataFrame:
    """Per candidate: total, and counts by confidence as a map. tags: candidate_id, label, type, confidence, pos (the last label stands)."""
    each = tags.groupBy("candidate_id", "confidence").agg(F.count("*").alias("n"))
    names = tags.groupBy("candidate_id").agg(F.max_by("label", "pos").alias("label"), F.max_by("type", "pos").alias("type"))
    counts = each.groupBy("candidate_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("confidence", "n")))).alias("confidence_counts"))
    return counts.join(names, "candidate_id")
