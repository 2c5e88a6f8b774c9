"""Series, chronology and neighbours in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.functions import dates
from stratalog.operators.ranking import global_rank


def members(series: DataFrame, posts: DataFrame, ids: str = "postIds", key: str = "id") -> DataFrame:
    """One row per series member in its order: series_id, pos, and the post's columns."""
    bridge = series.select(F.col("id").alias("series_id"), F.posexplode(ids).alias("pos", "member_"))
    return bridge.join(posts, F.col("member_") == posts[key]).drop("member_")


def units(series: DataFrame, posts: DataFrame) -> DataFrame:
    """Browse units: series as such, and `post-<id>` for posts outside of any; parts in order."""
    parts = members(series, posts)
    grouped = parts.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "title"))).alias("p"), F.sum("imageCount").alias("image_count"))
    of_series = grouped.select(F.col("series_id").alias("unit_id"), F.transform("p", lambda x: x["id"]).alias("post_ids"), F.get("p", F.lit(0))["title"].alias("title"), "image_count", F.lit(True).alias("is_series"))
    rest = posts.join(parts.select("id").distinct(), "id", "left_anti")
    single = rest.select(F.concat(F.lit("post-"), "id").alias("unit_id"), F.array("id").alias("post_ids"), "title", F.col("imageCount").cast("long").alias("image_count"), F.lit(False).alias("is_series"))
    return of_series.unionByName(single)


def aggregate(parts: DataFrame, key: str, pos: str, sums: list[str], ordered: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """Per key: row count, sums, values in order, and array values distinct in order of first appearance."""
    columns = [F.count("*").alias("parts"), *[F.sum(c).alias(c) for c in sums]]
    columns += [F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), c.alias("v")))), lambda x: x["v"]).alias(k) for k, c in ordered.items()]
    columns += [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), c.alias("v")))), lambda x: x["v"]))).alias(k) for k, c in distinct.items()]
    return parts.groupBy(key).agg(*columns)


def archive_summary(items: DataFrame, iso: str = "isoDate") -> DataFrame:
    """Counts of items, series, posts and images, and of the years that dates begin with."""
    year = dates.year_key(F.col(iso))
    return items.agg(F.count("*").alias("items"), F.count_if("is_series").alias("series"), F.sum("parts").alias("posts"), F.sum("images").alias("images"), F.countDistinct(F.when(year != dates.UNDATED, year)).alias("years"))


def neighbours(rows: DataFrame, by: list[str], order: list, key: str, earlier: int = 1, later: int = 2) -> DataFrame:
    """Keys before and behind in an order: next_i are later rows, prev_i earlier ones."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.select("*", *[F.lag(key, k).over(w).alias(f"prev_{k}") for k in range(1, earlier + 1)], *[F.lead(key, k).over(w).alias(f"next_{k}") for k in range(1, later + 1)])


def newest_first(items: DataFrame, value: Column, title: str = "title") -> DataFrame:
    """By date downwards, undated last, then by title in Dutch order."""
    return items.orderBy(dates.parsed(value).desc_nulls_last(), F.expr(f"{title} COLLATE nl"))


def chronology(items: DataFrame, value: Column, newest: bool = True) -> DataFrame:
    """Month groups: key, year, rows, first index in chronological order (undated last), and whether the group begins its year.

    Indexes follow from the months' counts; items are not sorted.
    """
    months = items.groupBy(dates.month_key(value).alias("month_key"), dates.year_key(value).alias("year")).agg(F.count("*").alias("n"))
    undated = F.col("year") == dates.UNDATED
    order = [undated, F.desc("month_key") if newest else F.asc("month_key")]
    before = F.coalesce(F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(W.partitionBy("year").orderBy(*order)) == 1
    return months.withColumn("first_index", before).withColumn("starts_year", first)


def grid_rows(rows: DataFrame, by: list[str], order: list, columns: int) -> DataFrame:
    """Row and column of each item in grids of ``columns`` per group."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("grid_row", F.floor(place / columns).cast("int")).withColumn("grid_col", (place % columns).cast("int"))


def even_spread(rows: DataFrame, by: list[str], pos: str, k: int) -> DataFrame:
    """At most ``k`` rows per group at even distances, ends included (halves to even)."""
    sized = rows.withColumn("i_", F.row_number().over(W.partitionBy(*by).orderBy(pos)) - 1).withColumn("n_", F.count("*").over(W.partitionBy(*by)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n_") - 1) / F.lit(float(max(1, k - 1))), 0).cast("int"))
    return sized.where((F.col("n_") <= k) | F.array_contains(places, F.col("i_"))).drop("i_", "n_")


def round_robin(rows: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    """``n`` rows, one of every stratum in turn; large strata first in each turn. No stratum sorts more than ``n`` rows per task."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size_"))
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.join(sizes, stratum).orderBy("turn", F.desc("size_"), stratum).limit(n).drop("size_")


def circular(rows: DataFrame, primary: Column, order: list, key: str, offsets: tuple[int, ...] = (1, 2, 3, -1), descending: bool = False) -> DataFrame:
    """Keys at circular offsets of every row of an ordered list."""
    placed = global_rank(rows, primary, order, "i", descending).select(key, "i")
    total = rows.agg(F.count("*").alias("n_"))
    asked = placed.crossJoin(F.broadcast(total)).select(F.col(key), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("off"), "i", "n_").withColumn("j", F.pmod(F.col("i") + F.col("off"), F.col("n_")))
    return asked.join(placed.select(F.col(key).alias("target"), F.col("i").alias("j")), "j").select(key, "off", "target")


def rotate(rows: DataFrame, primary: Column, order: list, key: str, start, descending: bool = False) -> DataFrame:
    """Order that begins at ``start`` and wraps around: key, place."""
    placed = global_rank(rows, primary, order, "i", descending).select(key, "i")
    head = placed.where(F.col(key) == start).select(F.col("i").alias("s_")).crossJoin(rows.agg(F.count("*").alias("n_")))
    return placed.crossJoin(F.broadcast(head)).select(key, F.pmod(F.col("i") - F.col("s_"), F.col("n_")).alias("place"))


def active_at(rows: DataFrame, offset: float) -> DataFrame:
    """The first row that ends behind an offset, else the last."""
    return rows.orderBy((F.col("start") + F.col("size") > offset).desc(), F.when(F.col("start") + F.col("size") > offset, F.col("start")).otherwise(-F.col("start"))).limit(1)
