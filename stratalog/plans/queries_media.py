"""Gallery, atlas, spatial and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import cluster, gallery, ranking, vectors
from stratalog.plans.query_specs import AtlasQuery, GalleryQuery
from stratalog.plans.registry import query, table

_IMAGES_SQL = """
WITH im AS (SELECT p_partkey AS id, p_name AS title, p_brand, p_type, 1990 + p_size AS year, CASE p_size % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'lente' WHEN 2 THEN 'zomer' ELSE 'herfst' END AS season,
  [CASE WHEN p_size % 2 = 0 THEN 'fruit' ELSE 'mensen' END, CASE WHEN p_size % 3 = 0 THEN 'tuin' ELSE 'wolken' END] AS tags FROM part)
"""


def images(spark, d):
    part = table(spark, d, "part")
    season = F.when(F.col("p_size") % 4 == 0, "winter").when(F.col("p_size") % 4 == 1, "lente").when(F.col("p_size") % 4 == 2, "zomer").otherwise("herfst")
    both = F.array(F.when(F.col("p_size") % 2 == 0, "fruit").otherwise("mensen"), F.when(F.col("p_size") % 3 == 0, "tuin").otherwise("wolken"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("postTitle"), F.col("p_type").alias("caption"), F.col("p_brand").alias("visualClusterId"), (F.col("p_size") + 1990).alias("year"), season.alias("season"), both.alias("visualTags"), F.lit(None).cast("array<string>").alias("imageTagIds"), F.col("p_partkey").alias("pos"))


@query("gallery_filter", _IMAGES_SQL + "SELECT id FROM im WHERE season = 'lente' AND list_contains(tags, 'tuin') AND contains(lower(title || ' ' || p_type || ' ' || tags[1] || ' ' || tags[2]), 'small')")
def gallery_filter(spark, d):
    return gallery.filter_images(images(spark, d), GalleryQuery.from_query_string("q=Small&season=lente&theme=tuin")).select("id")


@query("gallery_people_plants", _IMAGES_SQL + "SELECT id, year FROM im WHERE year = 2000 AND (list_contains(tags, 'fruit') OR list_contains(tags, 'mensen') OR list_contains(tags, 'tuin'))")
def gallery_people_plants(spark, d):
    return gallery.filter_images(images(spark, d), GalleryQuery.from_query_string("year=2000&peoplePlants=1")).select("id", "year")


@query("gallery_species", _IMAGES_SQL + "SELECT id FROM im WHERE p_brand IN (SELECT p_brand FROM im WHERE id % 7 = 0) AND id % 7 = 0")
def gallery_species(spark, d):
    rows = images(spark, d)
    species = rows.select(F.col("id").alias("image_id"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("candidate_id"), F.col("caption").alias("label"))
    return gallery.filter_images(rows, GalleryQuery(species="c0"), species).select("id")


@query("gallery_shows", _IMAGES_SQL + "SELECT count(*) FILTER (WHERE list_contains(tags, 'mensen')) AS people, count(*) FILTER (WHERE list_contains(tags, 'fruit') OR list_contains(tags, 'tuin')) AS plants FROM im")
def gallery_shows(spark, d):
    fine, coarse = F.col("imageTagIds"), F.col("visualTags")
    return images(spark, d).agg(F.count_if(gallery.shows_people(fine, coarse)).alias("people"), F.count_if(gallery.shows_plants(fine, coarse)).alias("plants"))


@query("gallery_themes", _IMAGES_SQL + "SELECT id, upper(id) AS label, n FROM (SELECT unnest(tags) AS id, count(*) AS n FROM im WHERE season = 'zomer' GROUP BY 1) WHERE id IN ('fruit', 'tuin', 'zee')")
def gallery_themes(spark, d):
    themes = spark.createDataFrame([(x, x.upper()) for x in ("fruit", "tuin", "zee")], "id string, label string")
    return gallery.visible_themes(gallery.filter_images(images(spark, d), GalleryQuery(season="zomer")), themes)


@query("gallery_neighbours", _IMAGES_SQL + "SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM im WHERE season = 'winter' WINDOW w AS (ORDER BY year DESC, id)")
def gallery_neighbours(spark, d):
    return gallery.viewer_neighbours(gallery.filter_images(images(spark, d), GalleryQuery(season="winter")), F.col("year"), ["id"])


@query("gallery_viewer", _IMAGES_SQL + "SELECT previous, next FROM (SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM im WHERE season = 'winter' WINDOW w AS (ORDER BY year DESC, id)) WHERE id = (SELECT min(id) FROM im WHERE season = 'winter' AND year = 2002)")
def gallery_viewer(spark, d):
    rows = gallery.filter_images(images(spark, d), GalleryQuery(season="winter"))
    first = rows.where("year = 2002").agg(F.min("id")).first()[0]
    return ranking.around(rows, F.struct((-F.col("year")).alias("y"), F.col("id")), "id", first)


@query("gallery_related", _IMAGES_SQL + """SELECT id FROM (SELECT id, min(r) AS r FROM (SELECT id, id - 1000 AS r FROM im WHERE id IN (40, 30, 20) UNION ALL SELECT id, id FROM im WHERE p_brand = (SELECT p_brand FROM im WHERE id = 10)) WHERE id <> 10 GROUP BY id) ORDER BY r LIMIT 10""")
def gallery_related(spark, d):
    direct = spark.createDataFrame([(20, 0), (30, 1), (40, 2), (999_999_999, 3)], "id long, pos int")
    rows = images(spark, d)
    return gallery.related(rows.withColumn("pos", F.col("id").cast("int")), direct, 10)


_POINTS_SQL = "WITH pt AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) / 2 + 0.5 AS x, CAST(embedding[2] AS DOUBLE) / 2 + 0.5 AS y FROM embeddings) "


def points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.get("embedding", F.lit(0)).cast("double") / 2 + 0.5).alias("x"), (F.get("embedding", F.lit(1)).cast("double") / 2 + 0.5).alias("y"))




@query("viewport_query", _POINTS_SQL + "SELECT id FROM pt WHERE x BETWEEN 0.45 AND 0.55 AND y BETWEEN 0.4 AND 0.52")
def viewport_query(spark, d):
    return gallery.viewport(points(spark, d), 0.45, 0.55, 0.4, 0.52).select("id")


@query("grid_index", _POINTS_SQL + "SELECT id, CAST(least(greatest(floor(x * 32), 0), 31) AS INTEGER) AS cx, CAST(least(greatest(floor(y * 32), 0), 31) AS INTEGER) AS cy FROM pt")
def grid_index(spark, d):
    return gallery.with_cells(points(spark, d)).select("id", "cx", "cy")


@query("bbox", _POINTS_SQL + "SELECT label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pt GROUP BY 1")
def bbox(spark, d):
    return gallery.bounds(points(spark, d), "label")


@query("density_grid", _POINTS_SQL + "SELECT label, CAST(least(greatest(floor(x * 34), 0), 33) AS INTEGER) AS cx, CAST(least(greatest(floor(y * 24), 0), 23) AS INTEGER) AS cy, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM pt GROUP BY 1, 2, 3")
def density_grid(spark, d):
    return gallery.density(points(spark, d), ["label"])


@query("kernel_density", _POINTS_SQL + """, c AS (SELECT CAST(least(greatest(floor(x * 56), 0), 55) AS INTEGER) AS cx, CAST(least(greatest(floor(y * 36), 0), 35) AS INTEGER) AS cy, count(*) AS n FROM pt GROUP BY 1, 2),
o AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy, sqrt(a * a + b * b) AS dist FROM range(-2, 3) r(a) CROSS JOIN range(-2, 3) s(b) WHERE a * a + b * b <= 2.25 * 2.25)
SELECT cx + dx AS cx, cy + dy AS cy, round(sum(n * (1 / (1 + 1.35 * dist))), 6) AS density FROM c, o WHERE cx + dx BETWEEN 0 AND 55 AND cy + dy BETWEEN 0 AND 35 GROUP BY 1, 2""")
def kernel_density(spark, d):
    return gallery.kernel_density(points(spark, d))


@query("nearest_points", _POINTS_SQL + "SELECT id, round((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5), 9) AS d2 FROM pt ORDER BY d2, id LIMIT 10")
def nearest_points(spark, d):
    return gallery.nearest_points(points(spark, d), 0.5, 0.5).select("id", "d2")


@query("hit_test", _POINTS_SQL + "SELECT id FROM pt WHERE round((x - 0.52) * (x - 0.52) + (y - 0.5) * (y - 0.5), 9) < 0.0025 ORDER BY round((x - 0.52) * (x - 0.52) + (y - 0.5) * (y - 0.5), 9), id LIMIT 1")
def hit_test(spark, d):
    return gallery.nearest_points(points(spark, d), 0.52, 0.5, 1, radius=0.05).select("id")


@query("density_peaks")
def density_peaks(spark, d):
    cells = gallery.density(points(spark, d), ["label"]).select("label", "n", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"))
    return gallery.suppress_peaks(cells, "label", 0.05, 4)


@query("atlas_filter", """SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995 AND month(o_orderdate) IN (6, 7, 8)""")
def atlas_filter(spark, d):
    orders = table(spark, d, "orders")
    from stratalog.functions.dates import season

    rows = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("array<string>").alias("categoryIds"), F.col("o_orderpriority").alias("topicId"), F.year("o_orderdate").alias("year"), season(F.month("o_orderdate")).alias("season"))
    return gallery.filter_points(rows, AtlasQuery.from_query_string("topic=1-URGENT&year=1995&season=zomer")).select("id")


@query("cluster_summary", """
WITH p AS (SELECT o_custkey, o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS season, o_orderkey % 3 AS images FROM orders),
s AS (SELECT o_custkey, season, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(id)) AS k FROM p GROUP BY o_custkey, season)
SELECT p.o_custkey, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (WHERE images > 0) AS with_images, min(id) AS representative, any_value(s.season) AS season
FROM p JOIN s ON s.o_custkey = p.o_custkey AND k = 1 GROUP BY 1""")
def cluster_summary(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("season"), (F.col("o_orderkey") % 3).alias("imageCount"))
    return gallery.cluster_summary(rows, "o_custkey", "id")


@query("knn_exact", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM n),
s AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
SELECT key, neighbour, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, neighbour) AS rank FROM s) WHERE rank <= 5""")
def knn_exact(spark, d):
    rows = table(spark, d, "embeddings")
    found = vectors.neighbours(rows, "vec_id", "embedding", 5, rows.where("vec_id % 20 = 0"))
    return found.select("key", "neighbour", F.round("sim", 6).alias("sim"), "rank")


_CENTERS = """
WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(m * m)) AS l FROM c GROUP BY 1),
vn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS l FROM x GROUP BY 1)
"""


@query("centroid_reps", _CENTERS + """, s AS (SELECT x.label, x.vec_id, round(sum(CAST(x AS DOUBLE) * m) / any_value(vn.l) / any_value(cn.l), 6) AS sim FROM x JOIN c ON c.label = x.label AND c.i = x.i JOIN cn ON cn.label = x.label JOIN vn ON vn.vec_id = x.vec_id GROUP BY 1, 2)
SELECT label, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 8""")
def centroid_reps(spark, d):
    return cluster.representatives(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("zero_shot_label", _CENTERS + """, s AS (SELECT x.vec_id, c.label, round(sum(CAST(x AS DOUBLE) * m) / any_value(vn.l) / any_value(cn.l), 6) AS sim FROM x JOIN c ON c.i = x.i JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = x.vec_id GROUP BY 1, 2)
SELECT vec_id, label, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rank FROM s) WHERE rank <= 3""")
def zero_shot_label(spark, d):
    rows = table(spark, d, "embeddings")
    labels = vectors.mean_vectors(rows.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")), ["label"], "v").select("label", F.col("centroid").alias("lv"))
    return vectors.labels_by_vector(rows.drop("label"), "vec_id", "embedding", labels)


@query("map_clip", _POINTS_SQL + """, q AS (SELECT quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh, quantile_cont(y, 0.01) AS yl, quantile_cont(y, 0.99) AS yh FROM pt)
SELECT id, round((least(greatest(x, xl), xh) - xl) / (xh - xl), 6) AS x, round((least(greatest(y, yl), yh) - yl) / (yh - yl), 6) AS y FROM pt, q""")
def map_clip(spark, d):
    return vectors.clipped(points(spark, d).select("id", "x", "y"), ["x", "y"])


@query("map_pad", _POINTS_SQL + """SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 0.92 + 0.04, 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 0.92 + 0.04, 6) AS y FROM pt""")
def map_pad(spark, d):
    return vectors.padded(points(spark, d).select("id", "x", "y"), ["x", "y"])


@query("pca_map")
def pca_map(spark, d):
    return vectors.padded(vectors.pca_map(table(spark, d, "embeddings"), "vec_id", "embedding"), ["x", "y"])


@query("kmeans_sizes")
def kmeans_sizes(spark, d):
    return cluster.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10).groupBy("label").agg(F.count("*").alias("n"))


@query("agglomerative_labels")
def agglomerative_labels(spark, d):
    rows = table(spark, d, "embeddings").withColumn("bucket", F.col("label"))
    return cluster.agglomerative(rows, "bucket", "vec_id", "embedding")


@query("merged_clusters")
def merged_clusters(spark, d):
    rows = table(spark, d, "embeddings")
    return cluster.merge_tiny(rows, "vec_id", "label", "embedding", rows.count() // 10)
