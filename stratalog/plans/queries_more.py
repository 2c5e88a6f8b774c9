"""Joins, images, publishing, checks and vectors: queries on stand-ins for what the tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import scalars, urls
from stratalog.functions import text as X
from stratalog.operators import checks, cluster, images, publish, scoring, series, stats, vectors
from stratalog.plans.registry import query, table


def _conversations(spark, d):
    return table(spark, d, "conversations")


@query("browse_units", """
WITH p AS (SELECT doc_id, doc_id // 4 AS s FROM documents), s AS (SELECT s FROM p WHERE s % 2 = 0 GROUP BY s HAVING count(*) >= 2)
SELECT 'series-' || CAST(s AS VARCHAR) AS unit_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id DESC) AS post_ids, true AS is_series FROM p WHERE s IN (SELECT s FROM s) GROUP BY s
UNION ALL SELECT 'post-' || CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), false FROM p WHERE s NOT IN (SELECT s FROM s)""")
def browse_units(spark, d):
    posts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 10).alias("title"), F.lit(1).alias("imageCount"), F.floor(F.col("doc_id") / 4).alias("s"), "doc_id")
    found = posts.where("s % 2 = 0").groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("doc_id")).alias("m"), "id"))), lambda x: x["id"]).alias("postIds")).where(F.size("postIds") >= 2)
    units = series.units(found.select(F.concat(F.lit("series-"), F.col("s").cast("string")).alias("id"), "postIds"), posts.drop("s", "doc_id"))
    return units.select("unit_id", F.array_join("post_ids", ",").alias("post_ids"), "is_series")


@query("archive_summary", """
SELECT count(*) AS items, count(*) FILTER (WHERE n > 1) AS series, CAST(sum(n) AS BIGINT) AS posts, CAST(sum(n * 2) AS BIGINT) AS images, count(DISTINCT y) AS years
FROM (SELECT o_custkey, count(*) AS n, min(strftime(o_orderdate, '%Y')) AS y FROM orders GROUP BY 1)""")
def archive_summary(spark, d):
    items = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("parts"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("isoDate"))
    return series.archive_summary(items.select((F.col("parts") > 1).alias("is_series"), "parts", (F.col("parts") * 2).alias("images"), "isoDate"))


@query("series_violations", """
WITH p AS (SELECT doc_id, doc_id // 3 AS s FROM documents),
m AS (SELECT s, CAST(doc_id AS VARCHAR) AS id FROM p UNION ALL SELECT s + 1, CAST(doc_id AS VARCHAR) FROM p WHERE doc_id % 20 = 0)
SELECT 'short series' AS "check", CAST(s AS VARCHAR) AS key FROM m GROUP BY s HAVING count(*) < 2
UNION ALL SELECT 'unknown member', id FROM (SELECT DISTINCT id FROM m) WHERE CAST(id AS BIGINT) % 50 = 0
UNION ALL SELECT 'member of two series', id FROM m GROUP BY id HAVING count(*) > 1""")
def series_violations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("s"), F.col("doc_id").cast("string").alias("id"))
    members = docs.select("s", "id").union(docs.where("doc_id % 20 = 0").select(F.col("s") + 1, "id"))
    found = members.groupBy(F.col("s").alias("id")).agg(F.collect_list("id").alias("postIds"))
    return checks.series_rules(found, docs.where("doc_id % 50 <> 0").select("id"))


@query("score_violations", """SELECT 'score outside of 0..1' AS "check", CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS key FROM lineitem WHERE l_discount * 12 > 1""")
def score_violations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("tag_id"), (F.col("l_discount") * 12).alias("score"))
    return checks.score_rules(rows)


@query("vector_violations", """SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0""")
def vector_violations(spark, d):
    """Vectors that are cut short, zero or have a NaN are planted."""
    v, i = F.col("embedding"), F.col("vec_id")
    broken = F.when(i % 7 == 0, F.slice(v, 1, 63)).when(i % 11 == 0, F.transform(v, lambda x: x * 0)).when(i % 13 == 0, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).otherwise(v)
    return vectors.invalid_vectors(table(spark, d, "embeddings").select("vec_id", broken.alias("embedding")), "embedding").select("vec_id")


@query("source_drift", """SELECT 'source changed' AS "check", CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 50 = 0""")
def source_drift(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return checks.drift(docs, docs.withColumn("h", F.when(F.col("doc_id") % 50 == 0, "old").otherwise(F.col("h"))), "doc_id", "h")


@query("carried_labels", """SELECT d.doc_id, coalesce(l.quality, CAST(d.doc_id % 2 AS INTEGER)) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def carried_labels(spark, d):
    sample = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return scoring.carry_over(sample, table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", ["quality"])


def _images(spark, d):
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"), F.col("l_orderkey").alias("post_id"), (F.col("l_linenumber") - 1).alias("index"), F.concat(F.lit("/i/"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("src"))


@query("caption_ranges", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS image_id, 'numbered_caption' AS kind, '2-3 ' || o_orderpriority AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 2 AND 3""")
def caption_ranges(spark, d):
    captions = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.concat(F.lit("2-3 "), F.col("o_orderpriority")).alias("text"))
    return images.caption_links(_images(spark, d), captions).select("image_id", "kind", "text")


@query("caption_fan_out", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS image_id, p_name AS caption FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 2 = 0""")
def caption_fan_out(spark, d):
    captions = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("src"), F.col("p_name").alias("caption"), F.lit("m").alias("model"))
    return images.observations(_images(spark, d), captions).select("image_id", "caption")


@query("uncaptioned_images", """SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)""")
def uncaptioned_images(spark, d):
    captions = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("src"))
    return images.uncaptioned(_images(spark, d), captions).agg(F.count("*").alias("n"))


@query("featured_images", """SELECT '/i/' || CAST(p AS VARCHAR) || '.jpg' AS src FROM (SELECT l_partkey AS p, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY 1) ORDER BY k LIMIT 12""")
def featured_images(spark, d):
    posts = _images(spark, d).groupBy(F.col("post_id").alias("pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "src"))), lambda x: x["src"]).alias("images"))
    return images.featured(posts, 12)


@query("first_images", """SELECT l_orderkey, count(*) AS image_count, split_part(min(CAST(l_linenumber AS VARCHAR) || '|/i/' || CAST(l_partkey AS VARCHAR) || '.jpg'), '|', 2) AS image FROM lineitem GROUP BY 1""")
def first_images(spark, d):
    from stratalog.sources.sinks import post_summary

    posts = _images(spark, d).groupBy(F.col("post_id").alias("l_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "src"))), lambda x: x["src"]).alias("images"))
    return post_summary(posts).select("l_orderkey", F.col("image_count").cast("long").alias("image_count"), F.get("images", F.lit(0)).alias("image"))


@query("related_posts", """
WITH c AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id FROM conversations),
f AS (SELECT conv_id, min_by(id, turn) AS id FROM c GROUP BY 1),
r AS (SELECT a.id AS post_id, b.id AS id, 0 AS part, b.turn AS pos FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn
      UNION ALL SELECT a.id, f.id, 1, k FROM c a CROSS JOIN (VALUES (1), (2), (3)) v(k) JOIN f ON f.conv_id = a.conv_id + k),
o AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY part, pos) AS place FROM r)
SELECT post_id, string_agg(id, ',' ORDER BY place) AS related FROM o WHERE place <= 6 GROUP BY 1""")
def related_posts(spark, d):
    rows = _conversations(spark, d)
    units = rows.groupBy(F.col("conv_id").cast("string").alias("unit_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws("/", "conv_id", "turn").alias("id")))), lambda x: x["id"]).alias("post_ids"))
    # the three conversations behind one are its neighbours
    near = rows.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
    near = near.select(F.col("conv_id").cast("string").alias("key"), (F.col("conv_id") + F.col("rank")).cast("string").alias("neighbour"), "rank")
    return publish.related_posts(units, near).where(F.size("related") > 0).select("post_id", F.array_join("related", ",").alias("related"))


@query("category_starts", """SELECT o_orderpriority, coalesce(min(o_orderkey) FILTER (WHERE o_orderkey % 3 = 1), min(o_orderkey)) AS start FROM orders GROUP BY 1""")
def category_starts(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 1).cast("int").alias("imageCount"))
    return publish.category_starts(rows, "o_orderpriority", "id")


@query("member_categories", """SELECT CAST(o_custkey AS VARCHAR) AS unit_id, string_agg(p, ',' ORDER BY p) AS category_ids FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1""")
def member_categories(spark, d):
    orders = table(spark, d, "orders")
    posts = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.array("o_orderpriority").alias("categoryIds"))
    units = orders.groupBy(F.col("o_custkey").cast("string").alias("unit_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("post_ids"))
    return publish.member_categories(posts, units).select("unit_id", F.array_join("category_ids", ",").alias("category_ids"))


@query("topics_in_order", "SELECT source AS id, count(*) AS \"postCount\" FROM documents GROUP BY 1")
def topics_in_order(spark, d):
    return publish.topics_in_order(table(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("postCount")))


@query("voted_terms", """
WITH v AS (SELECT o_custkey, o_orderpriority AS term, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
s AS (SELECT o_custkey, term, CAST(sum(greatest(3 - place, 0)) AS BIGINT) AS votes, min(place) AS first FROM v GROUP BY 1, 2)
SELECT o_custkey, term, votes, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, first, term) AS rank FROM s) WHERE rank <= 4""")
def voted_terms(spark, d):
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("term"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("place"))
    return cluster.voted_terms(rows, "o_custkey")


@query("mean_vectors", """
SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def mean_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.mean_vectors(rows, ["label"], "v").select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("fused_vectors", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
n AS (SELECT vec_id, a, b, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb, least(0.5 * 0.15 + ln(3.0) * 0.03, 0.25) AS w FROM u),
f AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(a, lambda x: x * 0.7 / na) || list_transform(a, lambda x: 0.0) ELSE list_transform(a, lambda x: x * 0.7 / na) || list_transform(b, lambda x: x * w / nb) END AS f FROM n),
g AS (SELECT vec_id, f, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS nf FROM f),
e AS (SELECT vec_id, unnest(f) / nf AS x, generate_subscripts(f, 1) - 1 AS i FROM g)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM e""")
def fused_vectors(spark, d):
    """Every third vector has no image vector."""
    rows = table(spark, d, "embeddings")
    image = F.when(F.col("vec_id") % 3 != 0, F.slice("embedding", 1, 32))
    fused = vectors.fuse(F.col("embedding"), image, F.lit(0.7), scalars.image_boost(F.lit(300.0), F.lit(2)))
    return rows.select("vec_id", fused.alias("v")).select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query("floor_quantiles", """
WITH r AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT q AS share, value FROM r JOIN (VALUES (0.0), (0.1), (0.5), (0.9), (1.0)) v(q) ON i = least(floor(n * q), n - 1)""".replace("q AS share", "CAST(q AS DOUBLE) AS share"))
def floor_quantiles(spark, d):
    return stats.floor_quantile(table(spark, d, "orders"), "o_totalprice", [0.0, 0.1, 0.5, 0.9, 1.0])


@query("price_ranks", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def price_ranks(spark, d):
    from stratalog.operators.ranking import global_rank

    return global_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), ["o_orderkey"], "rank", descending=True).select("o_orderkey", "rank")


@query("asset_links", r"""SELECT page_id, regexp_replace(html, '(?i)\b(src|href)\s*=\s*(["'']?)/archive-images/', '\1=\2https://cdn.invalid/archive-images/', 'g') AS html, url || '.jpg' AS name FROM pages""")
def asset_links(spark, d):
    return table(spark, d, "pages").select("page_id", urls.rewrite_assets(F.col("html"), "https://cdn.invalid").alias("html"), F.concat("url", F.lit(".jpg")).alias("name"))


@query("snippets", """
WITH a AS (SELECT doc_id, text, position('apache' IN lower(text)) AS p FROM documents), b AS (SELECT *, greatest(p - 130, 1) AS s FROM a)
SELECT doc_id, CASE WHEN p = 0 THEN substr(text, 1, 320) ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, p + 260 - s) || CASE WHEN p + 260 <= length(text) THEN '…' ELSE '' END END AS snippet FROM b""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), ["apache"]).alias("snippet"))


@query("latest_chunk_wins", """SELECT c_custkey % 100 AS key, max_by(c_name, c_custkey // 100) AS name FROM customer GROUP BY 1""")
def latest_chunk_wins(spark, d):
    from stratalog.sources.documents import merge_chunks

    rows = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("key"), F.floor(F.col("c_custkey") / 100).alias("chunk"), F.col("c_name").alias("name"))
    return merge_chunks(rows, "key", "chunk").select("key", "name")


@query("newest_reactions", """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 = 0, turn DESC) AS INTEGER) AS place FROM conversations""")
def newest_reactions(spark, d):
    """A day for each turn, and every third one without a valid date."""
    rows = _conversations(spark, d).select("conv_id", "turn")
    date = F.when(F.col("turn") % 3 != 0, F.date_add(F.lit("2007-01-01").cast("date"), F.col("turn").cast("int")))
    return publish.reactions_in_order(rows, "conv_id", date, [F.desc("turn")])


def _mirror_pages(spark, d):
    """A mirrored post page for each page, with a neighbour's post in front, and a reaction page for every third one."""
    rows = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("n"))
    day = F.date_format(F.date_add(F.lit("2007-01-01").cast("date"), F.col("page_id").cast("int")), "dd-MM-yyyy")
    head = lambda file, n, title: F.concat(F.lit(f"<tr><td class='post_titel'><a href='{file}?ID="), n, F.lit("'>#</a> "), title, F.lit("</td></tr>"))
    body = lambda text, signed: F.concat(F.lit("<tr><td class=bericht_content><p>"), text, F.lit("</p><form>x</form><img src='a.jpg'><h1>"), signed, F.lit("</h1></td></tr>"))
    cell = F.concat(F.lit("<table><tr><td class='datum'>"), day, F.lit("</td></tr>"))
    other = F.concat(F.lit("<table>"), head("archief.php", F.concat(F.lit("9"), F.col("n")), F.lit("neighbour")), body(F.lit("y"), F.lit("")), F.lit("</table>"))
    own = F.concat(cell, head("archief.php", F.col("n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Title &amp; "), F.col("n"))).otherwise("")), body(F.concat(F.lit("Text  of "), F.col("n")), F.lit("01-02-2008, 10:15 geschreven door Ann")), F.lit("<tr><td>Reageer (3)</td></tr></table>"))
    voice = F.concat(cell, head("reageer.php", F.col("n"), F.lit("Re")), body(F.lit("a good point about apples and pears"), F.lit("03-02-2008, 11:00 geschreven door Bob Janssen")), F.lit("</table>"))
    spam = F.concat(F.lit("<table>"), head("reageer.php", F.col("n"), F.lit("Hi")), body(F.lit("cheap nike shoes outlet"), F.lit("")), F.lit("</table>"))
    post = rows.select(F.lit("b").alias("blog"), F.lit("post").alias("kind"), F.col("n").alias("post_id"), F.concat(other, own).alias("html"), F.concat(F.lit("p"), F.col("n")).alias("path"))
    reaction = rows.where("page_id % 3 = 0").select(F.lit("b"), F.lit("reaction"), "n", F.concat(own, voice, spam, voice), F.concat(F.lit("r"), F.col("n")))
    return post.where("cast(post_id as long) % 9 <> 0").union(reaction)


@query("mirror_posts", """
SELECT 'b-' || page_id AS slug, CASE WHEN page_id % 2 = 0 THEN 'Title & ' || page_id ELSE 'Text of ' || page_id END AS title,
  strftime(DATE '2007-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%dT10:15:00') AS "isoDate", 'Ann' AS author, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 3 END AS reactions,
  CASE WHEN page_id % 3 = 0 THEN page_id || '-1,' || page_id || '-3' ELSE '' END AS voices, 'a.jpg' AS images, CASE WHEN page_id % 9 = 0 THEN 'r' ELSE 'p' END || page_id AS path FROM pages""")
def mirror_posts(spark, d):
    from stratalog.sources.mirror import mirror_posts as posts

    found = posts(_mirror_pages(spark, d), r"own\.invalid", "Owner")
    voices = F.array_join(F.transform(F.coalesce("reactions", F.array()), lambda r: r["id"]), ",")
    return found.select("slug", "title", "isoDate", "author", F.col("reactionCount").alias("n"), voices.alias("voices"), F.array_join("images", ",").alias("images"), F.col("sourcePath").alias("path")).withColumnRenamed("n", "reactions")


@query("imported_order", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders
QUALIFY place <= 2000 OR place > (SELECT count(*) FROM orders) - 500""")
def imported_order(spark, d):
    from pyspark.sql.window import Window as W

    from stratalog.operators.ranking import global_rank
    from stratalog.sources.mirror import import_order

    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("isoDate"))
    n = rows.count()
    ranked = global_rank(rows, F.to_timestamp("isoDate"), import_order(rows), "place", descending=True).where((F.col("place") < 2000) | (F.col("place") >= n - 500))
    # the rows of both ends, in the order that was asked for
    return ranked.withColumn("part", F.col("place") < 2000).withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(*import_order(rows)))).select("id", (F.col("at") + F.when(F.col("part"), 0).otherwise(F.greatest(F.lit(n - 500), F.lit(min(n, 2000))))).cast("int").alias("place"))


@query("image_clusters", """
WITH r AS (SELECT vec_id, label, vec_id // 3 AS post, ['t' || vec_id % 5, 'u' || vec_id % 2] AS tags, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT label, count(*) AS n, count(DISTINCT post) AS posts, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM r GROUP BY 1),
t AS (SELECT label, tag, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, tag) AS place FROM (SELECT label, unnest(tags) AS tag FROM r) GROUP BY 1, 2),
g AS (SELECT label, string_agg(tag, ', ' ORDER BY place) AS named FROM t WHERE place <= 4 GROUP BY 1),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r) GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT r.label, vec_id, row_number() OVER (PARTITION BY r.label ORDER BY round(list_cosine_similarity(v, c), 6) DESC, vec_id) AS place FROM r JOIN m ON m.label = r.label),
p AS (SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY place) AS reps FROM k WHERE place <= 8 GROUP BY 1)
SELECT 'image-cluster-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS id, s.label, n AS images, posts, named, reps FROM s JOIN g ON g.label = s.label JOIN p ON p.label = s.label""")
def image_clusters(spark, d):
    from stratalog.operators.gallery import cluster_payload

    rows = table(spark, d, "embeddings").withColumns({"post": F.floor(F.col("vec_id") / 3), "tags": F.array(F.concat(F.lit("t"), (F.col("vec_id") % 5).cast("string")), F.concat(F.lit("u"), (F.col("vec_id") % 2).cast("string")))})
    found = cluster_payload(rows, "label", "vec_id", "embedding", "tags", "post")
    return found.select("id", F.col("sourceLabel").alias("label"), F.col("imageCount").alias("images"), F.col("postCount").alias("posts"), F.col("generatedLabel").alias("named"), F.array_join(F.col("representativeImageIds").cast("array<string>"), ",").alias("reps"))


@query("post_lookup", "SELECT page_id, url FROM pages WHERE page_id = (SELECT max(page_id) FROM pages)")
def post_lookup(spark, d):
    rows = table(spark, d, "pages")
    slug = rows.agg(F.max_by("url", "page_id")).first()[0]
    return publish.post_by_slug(rows.select(F.col("page_id").alias("id"), F.col("url").alias("slug")), slug).select(F.col("id").alias("page_id"), F.col("slug").alias("url"))


@query("posts_with_images", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 1 ORDER BY o_orderkey LIMIT 12")
def posts_with_images(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("x.jpg"))).otherwise(F.array().cast("array<string>")).alias("images"))
    return publish.posts_with_images(rows, 12, "id").select("id")


@query("dutch_numbers", """
SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)), ',', '.') AS price, CAST(floor(o_totalprice / 500000 * 100 + 0.5) AS BIGINT) || '%' AS share,
  CASE WHEN o_totalprice < 999.95 THEN NULL ELSE regexp_replace(replace(printf('%.1f', floor(o_totalprice / 100 + 0.5) / 10), '.', ','), ',0$', '') || 'K' END AS short FROM orders""")
def dutch_numbers(spark, d):
    from stratalog.functions import numbers

    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", numbers.dutch_number(price).alias("price"), numbers.percent(price, F.lit(500000)).alias("share"), F.when(price >= 999.95, numbers.dutch_compact(price)).alias("short"))


@query("category_clusters")
def category_clusters(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.col("vec_id").alias("pos"), "embedding")
    return cluster.category_clusters(rows, "label", "vec_id", "embedding", "pos").withColumnRenamed("label", "cluster")
