"""Statistics, chronology, series and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import dates
from stratalog.operators import facets, series, stats
from stratalog.plans.registry import query, table


@query("year_rollup", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
  count(DISTINCT month(o_orderdate)) AS active_months, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1""")
def year_rollup(spark, d):
    return stats.year_rollup(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("month_spine", """
SELECT CAST(m AS INTEGER) AS month, count(o_orderkey) AS n FROM range(1, 13) r(m) LEFT JOIN orders ON month(o_orderdate) = m AND o_orderstatus = 'P' GROUP BY 1""")
def month_spine(spark, d):
    return stats.dense(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.month("o_orderdate"), 1, 12, "month")


@query("weekday_spine", """
SELECT CAST(w AS INTEGER) AS weekday, count(event_id) AS n FROM range(0, 7) r(w) LEFT JOIN events ON dayofweek(ts) = w GROUP BY 1""")
def weekday_spine(spark, d):
    return stats.dense(table(spark, d, "events"), dates.weekday(F.col("ts")), 0, 6, "weekday")


@query("weekday_hour_matrix", """
SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, count(event_id) AS n FROM range(0, 7) a(w) CROSS JOIN range(0, 24) b(h)
LEFT JOIN events ON dayofweek(ts) = w AND hour(ts) = h AND h <> 0 GROUP BY 1, 2""")
def weekday_hour_matrix(spark, d):
    return stats.weekday_hour(table(spark, d, "events"), "ts")


@query("totals_percentiles", """
SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars > 2000) AS long_docs,
  quantile_disc(n_chars, 0.5) AS median_chars, quantile_disc(n_chars, 0.95) AS p95_chars FROM documents""")
def totals_percentiles(spark, d):
    return stats.totals(table(spark, d, "documents"), {"chars": "n_chars"}, {"long_docs": "n_chars > 2000"}, {"median_chars": ("n_chars", 0.5), "p95_chars": ("n_chars", 0.95)})


@query("length_buckets", """
WITH b AS (SELECT CASE WHEN n_chars >= 4000 THEN 4 WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS k FROM documents)
SELECT CAST(i AS INTEGER) AS bucket, ['< 500', '500–1k', '1k–2k', '2k–4k', '4k+'][i + 1] AS label, count(k) AS n FROM range(0, 5) r(i) LEFT JOIN b ON k = i GROUP BY 1, 2""")
def length_buckets(spark, d):
    return stats.buckets(table(spark, d, "documents"), "n_chars", stats.LENGTHS)


@query("reply_buckets", """
WITH c AS (SELECT conv_id, count(*) - 1 AS v FROM conversations GROUP BY 1),
b AS (SELECT CASE WHEN v >= 8 THEN 4 WHEN v >= 4 THEN 3 WHEN v >= 2 THEN 2 WHEN v >= 1 THEN 1 ELSE 0 END AS k FROM c)
SELECT CAST(i AS INTEGER) AS bucket, ['0', '1', '2–3', '4–7', '8+'][i + 1] AS label, count(k) AS n FROM range(0, 5) r(i) LEFT JOIN b ON k = i GROUP BY 1, 2""")
def reply_buckets(spark, d):
    return stats.buckets(table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") - 1).alias("v")), "v", stats.COUNTS)


_ISLANDS = """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS ad FROM events),
r AS (SELECT user_id, ad, ad - CAST(row_number() OVER (PARTITION BY user_id ORDER BY ad) AS INTEGER) AS island FROM d),
s AS (SELECT user_id, island, count(*) AS days, min(ad) AS first_day, max(ad) AS last_day FROM r GROUP BY user_id, island)
SELECT user_id, days, first_day, last_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, first_day) AS k FROM s) WHERE k = 1"""


@query("longest_streak", _ISLANDS)
def longest_streak(spark, d):
    return stats.longest_streak(stats.active_days(table(spark, d, "events"), "ts", ["user_id"]), ["user_id"])


@query("longest_gap", """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS ad FROM orders),
g AS (SELECT o_custkey, lag(ad) OVER (PARTITION BY o_custkey ORDER BY ad) AS b, ad FROM d),
s AS (SELECT o_custkey, CAST(ad - b - 1 AS INTEGER) AS days, b + 1 AS first_day, ad - 1 AS last_day FROM g WHERE ad - b > 1)
SELECT o_custkey, days, first_day, last_day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY days DESC, first_day) AS k FROM s) WHERE k = 1""")
def longest_gap(spark, d):
    return stats.longest_gap(stats.active_days(table(spark, d, "orders"), "o_orderdate", ["o_custkey"]), ["o_custkey"])


@query("busiest_days", """
SELECT CAST(ts AS DATE) AS ad, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY n DESC, total DESC, ad LIMIT 8""")
def busiest_days(spark, d):
    return stats.busiest_days(table(spark, d, "events"), "ts", "value")


@query("mean_active_gap", """
SELECT round((max(ad) - min(ad)) / (count(*) - 1), 1) AS mean_gap FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ad FROM orders)""")
def mean_active_gap(spark, d):
    return stats.mean_active_gap(table(spark, d, "orders"), "o_orderdate")


@query("top_longest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def top_longest(spark, d):
    return stats.top_by(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")])


@query("quiet_longreads", """
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars >= (SELECT quantile_disc(n_chars, 0.8) FROM documents)
ORDER BY n_chars DESC, doc_id LIMIT 10""")
def quiet_longreads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return stats.quiet_and_long(docs, F.col("hit").isNull(), "n_chars").select("doc_id", "n_chars")


@query("topic_rollup", """
SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 14""")
def topic_rollup(spark, d):
    return stats.topic_rollup(table(spark, d, "documents"), "source", "n_chars")


@query("dashboard_rankings", """
SELECT l_shipmode_year AS year, round(100.0 * late / n, 4) AS late_per_100, n FROM (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipmode_year, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS late FROM lineitem GROUP BY 1)
ORDER BY late_per_100 DESC, year LIMIT 10""")
def dashboard_rankings(spark, d):
    by = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.expr("l_returnflag = 'R'")).alias("late"))
    return stats.top_by(by.select("year", F.round(100.0 * F.col("late") / F.col("n"), 4).alias("late_per_100"), "n"), [F.desc("late_per_100"), F.col("year")])


@query("cell_intensity", """
WITH c AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(n) AS top FROM c)
SELECT event_type, hour, n, round(n / top, 6) AS intensity,
  CAST(CASE WHEN n / top > 0.7 THEN 4 WHEN n / top > 0.4 THEN 3 WHEN n / top > 0.2 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS INTEGER) AS step FROM c, m""")
def cell_intensity(spark, d):
    return stats.intensity(table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n")), "n")


@query("series_aggregate", """
SELECT conv_id, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def series_aggregate(spark, d):
    parts = table(spark, d, "conversations").withColumn("chars", F.char_length("text").cast("long"))
    return series.aggregate(parts, "conv_id", "turn", ["chars"], {"roles": F.col("role")}, {}).withColumn("roles", F.array_join("roles", ">"))


@query("series_distinct_roles", """
SELECT conv_id, count(*) AS parts, string_agg(role, ',' ORDER BY first) AS roles FROM (
  SELECT conv_id, role, min(turn) AS first, count(*) AS c FROM conversations GROUP BY 1, 2) GROUP BY conv_id""".replace("count(*) AS parts", "CAST(sum(c) AS BIGINT) AS parts"))
def series_distinct_roles(spark, d):
    return series.aggregate(table(spark, d, "conversations"), "conv_id", "turn", [], {}, {"roles": F.array("role")}).withColumn("roles", F.array_join("roles", ","))


@query("series_neighbors", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_1, lead(o_orderkey) OVER w AS next_1, lead(o_orderkey, 2) OVER w AS next_2 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)""")
def series_neighbors(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return series.neighbours(orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], "o_orderkey").drop("o_custkey", "o_orderdate")


@query("chronology_groups", """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS idx FROM orders WHERE o_orderstatus = 'P'),
g AS (SELECT 'm-' || ym AS month_key, substr(ym, 1, 4) AS year, count(*) AS n, min(idx) AS first_index FROM o GROUP BY ym)
SELECT month_key, year, n, CAST(first_index AS INTEGER) AS first_index, row_number() OVER (PARTITION BY year ORDER BY first_index) = 1 AS starts_year FROM g""")
def chronology_groups(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return series.chronology(orders, F.col("iso"))


@query("grid_rows", """
SELECT p_partkey, CAST(floor((row_number() OVER w - 1) / 5) AS INTEGER) AS grid_row, CAST((row_number() OVER w - 1) % 5 AS INTEGER) AS grid_col FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def grid_rows(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return series.grid_rows(part, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 5).select("p_partkey", "grid_row", "grid_col")


@query("even_spread_sample", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE n <= 3 OR i IN (0, CAST(round_even((n - 1) / 2, 0) AS BIGINT), n - 1)""")
def even_spread_sample(spark, d):
    return series.even_spread(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 3)


@query("stratified_round_robin", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS turn, count(*) OVER (PARTITION BY lang) AS size FROM documents)
SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, size DESC, lang LIMIT 50""")
def stratified_round_robin(spark, d):
    return series.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", [F.sha2(F.col("doc_id").cast("string"), 256)], 50)


@query("slideshow_offsets", """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT a.s_suppkey, CAST(o AS INTEGER) AS off, b.s_suppkey AS target FROM p a CROSS JOIN (VALUES (1), (2), (3), (-1)) v(o) JOIN p b ON b.i = (a.i + o + a.n) % a.n""")
def slideshow_offsets(spark, d):
    return series.circular(table(spark, d, "supplier"), F.col("s_acctbal"), ["s_suppkey"], "s_suppkey", descending=True)


@query("slideshow_rotation", """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT p.s_suppkey, CAST((p.i - s.i + p.n) % p.n AS BIGINT) AS place FROM p, (SELECT i FROM p WHERE s_suppkey = 5) s""")
def slideshow_rotation(spark, d):
    return series.rotate(table(spark, d, "supplier"), F.col("s_acctbal"), ["s_suppkey"], "s_suppkey", 5, descending=True).withColumn("place", F.col("place").cast("long"))


_CUBE = """
WITH k AS (SELECT {cat} AS category, CAST(year({ts}) AS INTEGER) AS year, CAST(month({ts}) AS INTEGER) AS month,
  CASE WHEN month({ts}) BETWEEN 3 AND 5 THEN 'lente' WHEN month({ts}) BETWEEN 6 AND 8 THEN 'zomer' WHEN month({ts}) BETWEEN 9 AND 11 THEN 'herfst' ELSE 'winter' END AS season FROM {t})
SELECT category, year, month, season, count(*) AS n FROM k GROUP BY GROUPING SETS ((category, year, month), (category, year, season), (category, month), (category, season), (category))"""


@query("category_calendar", _CUBE.format(cat="event_type", ts="ts", t="events"))
def category_calendar(spark, d):
    return facets.calendar_cube(table(spark, d, "events"), "event_type", F.year("ts"), F.month("ts"), dates.season(F.month("ts")))


@query("order_calendar", _CUBE.format(cat="o_orderpriority", ts="o_orderdate", t="orders"))
def order_calendar(spark, d):
    return facets.calendar_cube(table(spark, d, "orders"), "o_orderpriority", F.year("o_orderdate"), F.month("o_orderdate"), dates.season(F.month("o_orderdate")))


@query("calendar_years", """
WITH t AS (SELECT o_orderpriority AS category, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT category, unnest(range(min(year), max(year) + 1)) AS year FROM t GROUP BY 1)
SELECT s.category, CAST(s.year AS INTEGER) AS year, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN t ON t.category = s.category AND t.year = s.year""")
def calendar_years(spark, d):
    return facets.dense_years(order_calendar(spark, d))


@query("calendar_months", """
SELECT o_orderpriority AS category, string_agg(CAST(n AS VARCHAR), ',' ORDER BY m) AS months FROM (
  SELECT p AS o_orderpriority, m, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN range(1, 13) r(m)
  LEFT JOIN orders ON o_orderpriority = p AND month(o_orderdate) = m GROUP BY 1, 2) GROUP BY 1""")
def calendar_months(spark, d):
    return facets.month_arrays(order_calendar(spark, d)).withColumn("months", F.array_join(F.transform("months", lambda x: x.cast("string")), ","))


@query("date_labels", """
SELECT o_orderkey, lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || ' ' || ['januari','februari','maart','april','mei','juni','juli','augustus','september','oktober','november','december'][month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS label,
  'm-' || strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'lente' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'zomer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'herfst' ELSE 'winter' END AS season
FROM orders""")
def date_labels(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("raw"))
    iso = raw.withColumn("iso", dates.iso_text(F.concat(F.lit("op "), F.col("raw"))))
    return iso.select("o_orderkey", dates.long_label(F.col("iso")).alias("label"), dates.month_key(F.col("iso")).alias("month_key"), "iso", dates.season(F.month(dates.parsed(F.col("iso")))).alias("season"))
