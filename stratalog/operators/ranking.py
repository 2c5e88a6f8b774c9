"""Gapless ranks over whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = 256


def global_rank(rows: DataFrame, primary: Column, order: list, name: str, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``name``: rank from 0 by a numeric or time ``primary`` (nulls last), then ``order``.

    Bounds that cut the rows about evenly are read once (at most ``buckets`` numbers); each range is
    ranked by itself and moved by the rows of the ranges before it. Rows that are equal in ``primary``
    are in one range.
    """
    value = F.unix_micros(primary.cast("timestamp")).cast("double") if dict(rows.select(primary.alias("p")).dtypes)["p"] in ("date", "timestamp", "timestamp_ntz") else primary.cast("double")
    keyed = rows.withColumn("p_", -value if descending else value)
    cuts = keyed.agg(F.percentile_approx("p_", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    bucket = F.when(F.col("p_").isNull(), buckets).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("p_"))))
    keyed = keyed.withColumn("b_", bucket)
    counts = keyed.groupBy("b_").agg(F.count("*").alias("c_"))
    before = counts.select("b_", F.coalesce(F.sum("c_").over(W.orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o_"))
    place = F.row_number().over(W.partitionBy("b_").orderBy(F.col("p_").asc_nulls_last(), *order)) - 1
    return keyed.withColumn("r_", place).join(F.broadcast(before), "b_").withColumn(name, (F.col("o_") + F.col("r_")).cast("long")).drop("p_", "b_", "r_", "o_")


def around(rows: DataFrame, order: Column, key: str, viewer) -> DataFrame:
    """One row: the keys right before and behind a row in an order (a struct that ends with the key), by two aggregates."""
    at = rows.where(F.col(key) == viewer).select(order.alias("at_"))
    both = rows.select(key, order.alias("o_")).crossJoin(F.broadcast(at))
    return both.agg(F.max_by(F.when(F.col("o_") < F.col("at_"), F.col(key)), F.when(F.col("o_") < F.col("at_"), F.col("o_"))).alias("previous"), F.min_by(F.when(F.col("o_") > F.col("at_"), F.col(key)), F.when(F.col("o_") > F.col("at_"), F.col("o_"))).alias("next"))
