"""Scores, tags, categories, facets, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import scalars
from stratalog.operators import checks, cluster, facets, scoring, tags
from stratalog.plans.registry import query, table
from stratalog.sources.documents import first_source_wins

#: A small vocabulary on the invented documents: tag, word, threshold (null: the default).
VOCABULARY = (("t_the", "the", 0.6), ("t_of", "of", None), ("t_die", "die", 0.2), ("t_que", "que", None), ("t_none", "zzzz", None))
#: category, ordinal, tag
MAPPING = (("small", 0, "t_the"), ("small", 0, "t_of"), ("other", 1, "t_die"), ("other", 1, "t_que"), ("other", 1, "t_of"))

_SCORES = """
WITH sc AS (SELECT doc_id AS unit_id, tag AS tag_id, least(1.0, (len(string_split(lower(text), ' ' || w || ' ')) - 1) / 4.0) AS score, lim
  FROM documents CROSS JOIN (VALUES ('t_the','the',0.6),('t_of','of',0.5),('t_die','die',0.2),('t_que','que',0.5),('t_none','zzzz',0.5)) v(tag, w, lim)),
sel AS (SELECT * FROM sc WHERE score >= lim),
mp AS (SELECT * FROM (VALUES ('small',0,'t_the'),('small',0,'t_of'),('other',1,'t_die'),('other',1,'t_que'),('other',1,'t_of')) v(category_id, ordinal, tag_id)),
un AS (SELECT doc_id AS unit_id, 1 + doc_id % 3 AS posts FROM documents)
"""


def vocabulary(spark):
    return spark.createDataFrame([(t, x) for t, _, x in VOCABULARY], "id string, threshold double")


def mapping(spark):
    return spark.createDataFrame(list(MAPPING), "category_id string, ordinal int, tag_id string")


def scores(spark, d):
    """Long-form scores: how often a word stands between spaces, up to 4 times."""
    words = F.array(*[F.struct(F.lit(t).alias("tag_id"), F.lit(w).alias("w")) for t, w, _ in VOCABULARY])
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.lower("text").alias("t"), F.explode(words).alias("v"))
    return rows.select("unit_id", "v.tag_id", F.least(F.lit(1.0), (F.size(F.expr("split(t, concat(' ', v.w, ' '))")) - 1) / F.lit(4.0)).alias("score"))


def units(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), (1 + F.col("doc_id") % 3).alias("posts"))


@query("tag_selection", _SCORES + "SELECT unit_id, tag_id, score FROM sel")
def tag_selection(spark, d):
    return tags.selected(scores(spark, d), vocabulary(spark)).select("unit_id", "tag_id", "score")


@query("tag_sweep", _SCORES + """SELECT tag_id, count(*) FILTER (WHERE score >= lim) AS unit_count, CAST(coalesce(sum(posts) FILTER (WHERE score >= lim), 0) AS BIGINT) AS post_count,
  round(sum(score), 6) AS score_sum, count(*) FILTER (WHERE score >= 0.3) AS at_30, count(*) FILTER (WHERE score >= 0.4) AS at_40, count(*) FILTER (WHERE score >= 0.5) AS at_50,
  count(*) FILTER (WHERE score >= 0.6) AS at_60 FROM sc JOIN un USING (unit_id) GROUP BY tag_id""")
def tag_sweep(spark, d):
    return tags.tag_report(scores(spark, d), vocabulary(spark), units(spark, d))


@query("bundle_counts", _SCORES + """, p AS (SELECT DISTINCT unit_id, category_id FROM sel JOIN mp USING (tag_id)), m AS (SELECT unit_id, count(*) > 1 AS many FROM p GROUP BY 1)
SELECT category_id, count(*) AS units, CAST(sum(posts) AS BIGINT) AS posts, count(*) FILTER (WHERE many) AS shared FROM p JOIN m USING (unit_id) JOIN un USING (unit_id) GROUP BY 1""")
def bundle_counts(spark, d):
    return tags.bundle(tag_selection(spark, d), mapping(spark), units(spark, d))


@query("bundle_unassigned", _SCORES + "SELECT unit_id FROM un WHERE unit_id NOT IN (SELECT unit_id FROM sel JOIN mp USING (tag_id))")
def bundle_unassigned(spark, d):
    return tags.unassigned(tag_selection(spark, d), mapping(spark), units(spark, d))


@query("unmapped_tags", "SELECT 't_none' AS tag_id")
def unmapped_tags(spark, d):
    return tags.unmapped(vocabulary(spark).select(F.col("id").alias("tag_id")), mapping(spark))


@query("category_rank", _SCORES + """, b AS (SELECT unit_id, category_id, ordinal, max(score) AS score FROM sel JOIN mp USING (tag_id) WHERE score > 0 GROUP BY 1, 2, 3)
SELECT unit_id, category_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, ordinal) AS INTEGER) AS rank, score FROM b
UNION ALL SELECT unit_id, 'overig', 1, NULL FROM un WHERE unit_id NOT IN (SELECT unit_id FROM b)""")
def category_rank(spark, d):
    return tags.ranked_categories(tag_selection(spark, d), mapping(spark), units(spark, d))


@query("category_representatives", _SCORES + """, b AS (SELECT unit_id, category_id, max(score) AS score FROM sel JOIN mp USING (tag_id) GROUP BY 1, 2)
SELECT * FROM (SELECT unit_id, category_id, score, CAST(row_number() OVER (PARTITION BY category_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM b) WHERE rank <= 5""")
def category_representatives(spark, d):
    best = tag_selection(spark, d).join(mapping(spark), "tag_id").groupBy("unit_id", "category_id").agg(F.max("score").alias("score"))
    return tags.representatives(best, "category_id", "unit_id")


_EVAL = """WITH p AS (SELECT doc_id AS unit_id, 'good' AS tag_id FROM documents WHERE n_chars > 700), g AS (SELECT doc_id AS unit_id, 'good' AS tag_id FROM labels WHERE quality = 1),
pl AS (SELECT p.* FROM p WHERE unit_id IN (SELECT doc_id FROM labels)) """


def _judged(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), "quality")
    predicted = table(spark, d, "documents").where("n_chars > 700").select(F.col("doc_id").alias("unit_id"), F.lit("good").alias("tag_id")).join(labels, "unit_id", "left_semi")
    return predicted, labels.where("quality = 1").select("unit_id", F.lit("good").alias("tag_id")), labels


@query("tag_eval", _EVAL + """, b AS (SELECT count(*) FILTER (WHERE p.unit_id IS NOT NULL AND g.unit_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.unit_id IS NULL) AS fp, count(*) FILTER (WHERE p.unit_id IS NULL) AS fn
  FROM pl p FULL JOIN g ON p.unit_id = g.unit_id)
SELECT 'good' AS tag_id, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM b
UNION ALL SELECT 'never', 0, 0, 0, NULL, NULL""")
def tag_eval(spark, d):
    predicted, gold, _ = _judged(spark, d)
    return tags.evaluate(predicted, gold, spark.createDataFrame([("good",), ("never",)], "tag_id string"))


@query("exact_set_accuracy", _EVAL + """SELECT count(*) AS units, round(avg(CASE WHEN (l.doc_id IN (SELECT unit_id FROM pl)) = (quality = 1) THEN 1 ELSE 0 END), 6) AS exact FROM labels l""")
def exact_set_accuracy(spark, d):
    return tags.exact_sets(*_judged(spark, d))


@query("rule_categories", """
SELECT doc_id, CASE WHEN greatest(en, fr) < 3 THEN 'rest' WHEN en >= fr THEN 'english' ELSE 'french' END AS category FROM (
  SELECT doc_id, least(3, len(list_filter(t, lambda x: x = 'the'))) + least(3, len(list_filter(t, lambda x: x = 'and'))) AS en, least(3, len(list_filter(t, lambda x: x = 'les'))) + least(3, len(list_filter(t, lambda x: x = 'que'))) AS fr
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents))""")
def rule_categories(spark, d):
    taxonomy = [{"label": "english", "visual": set(), "text": {"the", "and"}}, {"label": "french", "visual": set(), "text": {"les", "que"}}]
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit("([a-z]+)"), F.lit(1)))
    return rows.select("doc_id", tags.rule_category(F.col("t"), F.col("w"), F.array().cast("array<string>"), taxonomy, 3.0, "rest").alias("category"))


@query("facets_fixed", """
SELECT id, id || '!' AS label, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(id) LEFT JOIN orders ON o_orderstatus = id GROUP BY 1, 2""")
def facets_fixed(spark, d):
    spine = spark.createDataFrame([(x, x + "!") for x in "OFPX"], "id string, label string")
    return facets.facet(table(spark, d, "orders"), F.col("o_orderstatus"), spine)


@query("facets_dynamic", """
SELECT id, id || '!' AS label, count(*) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(id) JOIN orders ON o_orderstatus = id WHERE o_totalprice > 100000 GROUP BY 1, 2""")
def facets_dynamic(spark, d):
    spine = spark.createDataFrame([(x, x + "!") for x in "OFPX"], "id string, label string")
    return facets.facet(table(spark, d, "orders").where("o_totalprice > 100000"), F.col("o_orderstatus"), spine, keep_zero=False)


@query("group_confidences", """
WITH e AS (SELECT p_brand AS candidate_id, CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS c, p_type, p_partkey FROM part)
SELECT candidate_id, count(*) AS n, max_by(p_type, p_partkey) AS label, count(*) FILTER (WHERE c = 'high') AS high, count(*) FILTER (WHERE c = 'low') AS low FROM e GROUP BY 1""")
def group_confidences(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("candidate_id"), F.col("p_type").alias("label"), F.col("p_type").alias("type"), F.expr("CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END").alias("confidence"), F.col("p_partkey").alias("pos"))
    out = facets.group_confidences(part)
    return out.select("candidate_id", "n", "label", *[F.coalesce(F.try_element_at("confidence_counts", F.lit(c)), F.lit(0)).alias(c) for c in ("high", "low")])


@query("first_source_wins", """
WITH u AS (SELECT 0 AS r, c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 1, s_suppkey, s_name, s_nationkey FROM supplier)
SELECT key, name, nation, CAST(r AS INTEGER) AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, name) AS k FROM u) WHERE k = 1""")
def first_source(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return first_source_wins([a, b], "key", "name")


@query("coverage_anti_join", """
SELECT 'missing on the right' AS "check", CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 5 FROM orders)
UNION ALL SELECT DISTINCT 'missing on the left', CAST(o_custkey + 5 AS VARCHAR) FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)""")
def coverage_anti_join(spark, d):
    return checks.coverage(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", table(spark, d, "orders").select((F.col("o_custkey") + 5).alias("key")), "key")


@query("unknown_labels", """SELECT 'unknown id' AS "check", CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unknown_labels(spark, d):
    return checks.unknown(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("duplicate_texts", """SELECT 'duplicate id' AS "check", text AS key FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_texts(spark, d):
    return checks.duplicates(table(spark, d, "documents"), "text")


@query("hash_split", """
SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 THEN 'holdout' ELSE 'development' END AS split FROM documents""")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.holdout(F.col("doc_id")).alias("split"))


@query("image_ids", """SELECT l_orderkey, l_linenumber, 'img-' || substr(sha1(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag), 1, 16) AS image_id FROM lineitem""")
def image_ids(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.image_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("image_id"))


@query("greedy_batches", """
WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, CAST(least(n_chars, 4000) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT source, doc_id, n_chars, size, i, 0 AS batch, 1 AS n, size AS total FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.n_chars, r.size, r.i, CASE WHEN b.n = 8 OR b.total + r.size > 12000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n = 8 OR b.total + r.size > 12000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n = 8 OR b.total + r.size > 12000 THEN r.size ELSE b.total + r.size END
  FROM b JOIN r ON r.source = b.source AND r.i = b.i + 1)
SELECT doc_id, source, n_chars, size, batch FROM b""")
def greedy_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").withColumn("size", F.least("n_chars", F.lit(4000)).cast("long"))
    return scoring.greedy_batches(docs, "source", "doc_id", "size", 8, 12_000)


@query("fixed_batches", "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 16) AS INTEGER) AS batch FROM supplier")
def fixed_batches(spark, d):
    return scoring.fixed_batches(table(spark, d, "supplier").select("s_suppkey"), F.col("s_suppkey"), [], 16)


@query("ledger_total", "SELECT round(sum(c), 9) AS total FROM (SELECT o_orderpriority, max(o_totalprice) AS c FROM orders GROUP BY 1)")
def ledger_total(spark, d):
    return scoring.ledger_total(table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch_hash"), F.col("o_totalprice").alias("cost")))


@query("pending_units", """SELECT doc_id AS unit_id, sha256(lang) AS payload_hash FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND lang = 'en')""")
def pending_units(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.sha2("lang", 256).alias("payload_hash"))
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), F.sha2(F.lit("en"), 256).alias("payload_hash"))
    return scoring.pending(docs, cache)


@query("stable_topics", """
SELECT label, n, CASE WHEN label = 9 THEN 'topic-overig' ELSE 'topic-' || lpad(CAST(row_number() OVER (PARTITION BY label = 9 ORDER BY n DESC, label) AS VARCHAR), 2, '0') END AS topic_id
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""")
def stable_topics(spark, d):
    return cluster.stable_topics(table(spark, d, "embeddings"), "label", 9)


@query("dense_labels", "SELECT label, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS dense FROM (SELECT label, min(vec_id) AS p FROM embeddings GROUP BY 1)")
def dense_labels(spark, d):
    return cluster.dense_labels(table(spark, d, "embeddings"), "label", "vec_id")
