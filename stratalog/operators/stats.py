"""Activity statistics: rollups, distributions, streaks, gaps and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.operators.ranking import global_rank


def totals(rows: DataFrame, sums: dict[str, str], flags: dict[str, str], percentiles: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: count, sums, conditional counts, and nearest-rank percentiles (no interpolation)."""
    out = [F.count("*").alias("n")]
    out += [F.sum(c).alias(k) for k, c in sums.items()]
    out += [F.count_if(F.expr(c)).alias(k) for k, c in flags.items()]
    out += [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").alias(k) for k, (c, p) in percentiles.items()]
    return rows.agg(*out)


def year_rollup(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """Per year: rows, active days and months, sum, and mean rounded to 2 places."""
    return (
        rows.where(F.col(ts).isNotNull())
        .groupBy(F.year(ts).alias("year"))
        .agg(F.count("*").alias("n"), F.countDistinct(F.to_date(ts)).alias("active_days"), F.countDistinct(F.month(ts)).alias("active_months"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 2).alias("mean"))
    )


def dense(rows: DataFrame, key: Column, low: int, high: int, name: str) -> DataFrame:
    """Counts of an integer key, zeros included from ``low`` to ``high``."""
    counts = rows.groupBy(key.cast("int").alias(name)).agg(F.count("*").alias("n_"))
    spine = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(name))
    return spine.join(counts, name, "left").select(name, F.coalesce("n_", F.lit(0)).alias("n"))


def weekday_hour(rows: DataFrame, ts: str) -> DataFrame:
    """All 7 x 24 cells (0: Sunday); rows at hour 0 are left out, since a missing time reads as midnight."""
    hit = rows.where(F.hour(ts) != 0).groupBy((F.dayofweek(ts) - 1).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n_"))
    spine = rows.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return spine.join(hit, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n_", F.lit(0)).alias("n"))


#: Lower edges and labels of the length and count buckets.
LENGTHS = ((0, "< 500"), (500, "500–1k"), (1000, "1k–2k"), (2000, "2k–4k"), (4000, "4k+"))
COUNTS = ((0, "0"), (1, "1"), (2, "2–3"), (4, "4–7"), (8, "8+"))


def buckets(rows: DataFrame, value: str, edges: Sequence[tuple[int, str]]) -> DataFrame:
    """Counts in half-open buckets, empty ones included."""
    at = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e, _ in edges[1:]), F.lit(0))
    return dense(rows.where(F.col(value).isNotNull()), at, 0, len(edges) - 1, "bucket").select("bucket", F.get(F.array(*[F.lit(x) for _, x in edges]), F.col("bucket")).alias("label"), "n")


def topic_rollup(rows: DataFrame, topic: str, value: str, top: int = 14) -> DataFrame:
    out = rows.groupBy(topic).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.round(F.avg(value), 4).alias("mean"))
    return out.orderBy(F.desc("n"), topic).limit(top)


def active_days(rows: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).select(*by, F.to_date(ts).alias("ad")).distinct()


def longest_streak(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Longest run of consecutive days per key of (key, ad); the earliest on a tie."""
    island = F.date_sub("ad", F.row_number().over(W.partitionBy(*by).orderBy("ad")))
    runs = days.withColumn("island", island).groupBy(*by, "island").agg(F.count("*").alias("days"), F.min("ad").alias("first_day"), F.max("ad").alias("last_day"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("days", "first_day", "last_day"), F.struct("days", F.datediff(F.lit("9999-12-31"), F.col("first_day")))).alias("b"))
    return best.select(*by, "b.*")


def longest_gap(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Longest span without activity between two active days per key, bounds exclusive; the earliest on a tie."""
    before = F.lag("ad").over(W.partitionBy(*by).orderBy("ad"))
    gaps = days.withColumn("before", before).where("before is not null").select(*by, (F.datediff("ad", "before") - 1).alias("days"), F.date_add("before", 1).alias("first_day"), F.date_sub("ad", 1).alias("last_day")).where("days > 0")
    best = gaps.groupBy(*by).agg(F.max_by(F.struct("days", "first_day", "last_day"), F.struct("days", F.datediff(F.lit("9999-12-31"), F.col("first_day")))).alias("b"))
    return best.select(*by, "b.*")


def busiest_days(rows: DataFrame, ts: str, value: str, top: int = 8) -> DataFrame:
    out = rows.groupBy(F.to_date(ts).alias("ad")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.orderBy(F.desc("n"), F.desc("total"), "ad").limit(top)


def mean_active_gap(rows: DataFrame, ts: str) -> DataFrame:
    """Mean days between active days, one place; 0 for fewer than two days."""
    d = active_days(rows, ts)
    span = F.datediff(F.max("ad"), F.min("ad")) / F.nullif(F.count("*") - 1, F.lit(0))
    return d.agg(F.coalesce(F.round(span, 1), F.lit(0.0)).alias("mean_gap"))


def top_by(rows: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def quiet_and_long(rows: DataFrame, quiet: Column, length: str, share: float = 0.8, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Quiet rows at or over the nearest-rank percentile of length, longest first."""
    limit = rows.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {length})").alias("limit_"))
    return rows.where(quiet).join(F.broadcast(limit), F.col(length) >= F.col("limit_")).drop("limit_").orderBy(F.desc(length), key).limit(k)


def intensity(rows: DataFrame, value: str) -> DataFrame:
    """Value over the maximum, and its step: 4 over 0.7, 3 over 0.4, 2 over 0.2, 1 over 0."""
    top = rows.agg(F.max(value).alias("top_"))
    share = F.coalesce(F.try_divide(F.col(value), F.col("top_")), F.lit(0.0))
    step = F.when(share > 0.7, 4).when(share > 0.4, 3).when(share > 0.2, 2).when(share > 0, 1).otherwise(0)
    return rows.crossJoin(F.broadcast(top)).withColumn("intensity", F.round(share, 6)).withColumn("step", step).drop("top_")


def floor_quantile(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """share, value: the value at place floor(n * share) from 0, the last one at most."""
    ranked = global_rank(rows.where(F.col(value).isNotNull()).select(value), F.col(value), [], "i_")
    total = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("n_"))
    asked = total.select(F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "n_").select("share", F.least(F.floor(F.col("n_") * F.col("share")), F.col("n_") - 1).alias("i_"))
    return ranked.join(F.broadcast(asked), "i_").select("share", F.col(value).alias("value"))
