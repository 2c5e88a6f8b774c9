"""Clusters and topics: k-means, agglomerative clusters, labels, keywords, representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.operators.sizes import small
from stratalog.operators.vectors import dot, mean_vectors, normalized


def kmeans(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42, iterations: int = 50) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fed = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, initMode="k-means||").fit(fed)
    return model.transform(fed).select(key, F.col("prediction").alias("label"))


def _links(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average-link merges of unit vectors: pairs of clusters (row i: i, merge k: n + k), and their mean cosine distances.

    Nearest-neighbour chains; the mean distance of two clusters follows from their sums, so no matrix
    of distances is held: memory grows with the rows, time with their square.
    """
    n = len(v)
    sums, size, ids = v.copy(), np.ones(n), np.arange(n)
    far = np.zeros(n)  # infinite for clusters that are merged away
    pairs, heights = np.zeros((n - 1, 2), np.int64), np.zeros(n - 1)
    chain: list[int] = []
    for k in range(n - 1):
        if n - k < len(ids) // 2:
            alive = np.flatnonzero(far == 0)
            moved = np.full(len(ids), -1)
            moved[alive] = np.arange(len(alive))
            sums, size, ids, far, chain = sums[alive], size[alive], ids[alive], far[alive], moved[chain].tolist() if chain else []
        if not chain:
            chain = [int(far.argmin())]
        while True:
            a = chain[-1]
            distance = 1 - (sums @ sums[a]) / (size * size[a]) + far
            distance[a] = np.inf
            b = int(distance.argmin())
            if len(chain) > 1 and distance[chain[-2]] <= distance[b] + 1e-12:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        below = heights[ids[[a, b]][ids[[a, b]] >= n] - n]
        pairs[k], heights[k] = (ids[a], ids[b]), max([distance[b], *below])
        sums[a], size[a], ids[a] = sums[a] + sums[b], size[a] + size[b], n + k
        far[b] = np.inf
    return pairs, heights


def _cut(pairs: np.ndarray, heights: np.ndarray, limit: float) -> np.ndarray:
    """Labels (from 0, by first appearance) of the clusters that merges under ``limit`` make."""
    n = len(pairs) + 1
    top = np.arange(2 * n - 1)
    for k in range(n - 2, -1, -1):
        if heights[k] < limit:
            top[pairs[k]] = top[n + k]
    return pd.factorize(top[:n])[0]


def _merge_tiny(v: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """Labels under ``least`` rows go to the large label of the nearest centroid; as they are without a large one."""
    size = np.bincount(label)
    large = np.flatnonzero(size >= least)
    if not len(large):
        return label
    c = np.stack([v[label == k].mean(0) for k in range(len(size))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    to = np.where(size >= least, np.arange(len(size)), large[(c @ c[large].T).argmax(1)])
    return pd.factorize(to[label])[0]


def agglomerative(rows: DataFrame, by: str, key: str, vector: str, thresholds=tuple(np.linspace(0.28, 0.68, 9)), wanted: int | None = None) -> DataFrame:
    """by, key, label: average-link cosine clusters per bucket, alike at every size; a bucket under 10 rows is one cluster.

    Of the thresholds that one counts whose clusters, after tiny ones (under n / 35 rows, 4 to 18) went
    to the nearest, are nearest to ``wanted`` in number (unset: the root of n / 3, 2 to 18); a cluster
    of more than 62 % of the rows counts against it. A bucket is one task: its time grows with the
    square of its rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        n = len(v)
        label = np.zeros(n, int)
        if n >= 10:
            links = _links(v)
            aim = wanted or max(2, min(18, round((n / 3) ** 0.5)))
            found = [_merge_tiny(v, _cut(*links, t), max(4, min(18, n // 35))) for t in thresholds]
            label = min(found, key=lambda x: abs(x.max() + 1 - aim) + 10 * max(0.0, np.bincount(x).max() / n - 0.62))
        return pd.DataFrame({by: pdf[by], key: pdf[key], "label": label.astype(int)})

    kinds = dict(rows.dtypes)
    return rows.select(by, key, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, label int")


def merge_tiny(rows: DataFrame, key: str, label: str, vector: str, least: int) -> DataFrame:
    """Labels under ``least`` rows go to the large label of the nearest centroid; as they are without a large one."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    centers = mean_vectors(rows, [label], vector).join(sizes, label)
    large = centers.where(F.col("n") >= least).select(F.col(label).alias("to_"), F.col("centroid").alias("lc"))
    pairs = centers.where(F.col("n") < least).crossJoin(small(large)).select(label, "to_", dot(normalized("centroid"), normalized("lc")).alias("sim"))
    moved = pairs.groupBy(label).agg(F.max_by("to_", F.struct(F.round("sim", 9), (-F.col("to_")).alias("t"))).alias("to_"))
    return rows.select(key, label).join(small(moved), label, "left").select(key, F.coalesce("to_", label).alias(label))


def stable_topics(labels: DataFrame, label: str, noise: int = -1) -> DataFrame:
    """label, topic_id: `topic-01` on by size downwards; the noise label is `topic-overig`."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), label))
    named = sizes.where(F.col(label) != noise).withColumn("topic_id", F.concat(F.lit("topic-"), F.lpad(rank.cast("string"), 2, "0")))
    return named.unionByName(sizes.where(F.col(label) == noise).withColumn("topic_id", F.lit("topic-overig"))).select(label, "n", "topic_id")


def dense_labels(rows: DataFrame, label: str, pos: str) -> DataFrame:
    """label, dense: numbered from 0 by first appearance."""
    first = rows.groupBy(label).agg(F.min(pos).alias("p"))
    return first.select(label, (F.row_number().over(W.orderBy("p")) - 1).alias("dense"))


def keywords(tokens: DataFrame, topic: str, doc: str, k: int = 5, least: int = 2) -> DataFrame:
    """topic, term, score, rank: counts times idf over documents; ties by term downwards. tokens: topic, doc, term."""
    n = tokens.agg(F.countDistinct(doc).alias("n_docs"))
    df = tokens.groupBy("term").agg(F.countDistinct(doc).alias("df"))
    counts = tokens.groupBy(topic, "term").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    scored = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("c") * F.log((1 + F.col("n_docs")) / (1 + F.col("df"))), 6))
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.desc("score"), F.desc("term")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(topic, "term", "score", "rank")


def supported_terms(terms: DataFrame, topic: str, doc: str, share: float = 0.08, k: int = 4) -> DataFrame:
    """Terms of at least max(2, share) of a topic's documents. terms: topic, doc, term."""
    sizes = terms.groupBy(topic).agg(F.countDistinct(doc).alias("docs"))
    counts = terms.select(topic, doc, "term").distinct().groupBy(topic, "term").agg(F.count("*").alias("c"))
    held = counts.join(sizes, topic).where(F.col("c") >= F.greatest(F.lit(2), F.ceil(F.col("docs") * share)))
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.desc("c"), "term"))
    return held.withColumn("rank", rank).where(F.col("rank") <= k).select(topic, "term", "c", "rank")


def voted_terms(terms: DataFrame, key: str, k: int = 4) -> DataFrame:
    """Votes by place: 3, 2, 1, then 0. terms: key, term, place (from 0)."""
    votes = terms.groupBy(key, "term").agg(F.sum(F.greatest(3 - F.col("place"), F.lit(0))).alias("votes"), F.min("place").alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("votes"), "first", "term"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "term", "votes", "rank")


def representatives(rows: DataFrame, by: str, key: str, vector: str, k: int = 8) -> DataFrame:
    """The ``k`` rows of each group nearest to its centroid."""
    centers = mean_vectors(rows.select(by, F.transform(vector, lambda x: x.cast("double")).alias("v")), [by], "v")
    near = rows.join(small(centers), by).select(by, key, F.round(dot(normalized(F.col(vector)), normalized(F.col("centroid"))), 6).alias("sim"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("sim"), key))).where(F.col("rank") <= k)


def topic_label(text_terms: Column, visual_terms: Column, taxonomy: list[dict], least: int = 2) -> Column:
    """Taxonomy label by 2 a visual and 1 a text term; null under ``least``; the first wins ties."""
    options = []
    for k, c in enumerate(taxonomy):
        two = F.size(F.array_intersect(visual_terms, F.array(*[F.lit(t) for t in sorted(c["visual"])])))
        one = F.size(F.array_intersect(text_terms, F.array(*[F.lit(t) for t in sorted(c["text"])])))
        options.append(F.struct((2 * two + one).alias("score"), F.lit(-k).alias("k"), F.lit(c["label"]).alias("label")))
    best = F.array_max(F.array(*options))
    return F.when(best["score"] >= least, best["label"])


def merge_terms(label: Column, text_terms: Column, visual_terms: Column, generic: list[str], broad: list[str], k: int = 5) -> Column:
    """Label, then terms that say something, distinct, at most ``k``."""
    concrete = F.filter(visual_terms, lambda t: ~F.lower(t).isin(*broad)) if broad else visual_terms
    both = F.filter(F.transform(F.concat(text_terms, concrete), lambda t: F.trim(t)), lambda t: (t != "") & ~F.lower(t).isin(*generic))
    return F.slice(F.array_distinct(F.concat(F.filter(F.array(label), lambda x: x.isNotNull()), both)), 1, k)


def category_clusters(rows: DataFrame, category: str, key: str, vector: str, pos: str) -> DataFrame:
    """key, label: average-link clusters of each category, numbered on from the larger categories to the smaller (by name on a tie).

    Inside a category labels follow the first row by ``pos`` of each cluster.
    """
    named = rows.select(F.col(category).alias("in_"), F.col(key).alias("key_"), F.col(pos).alias("pos_"), F.col(vector).alias("v_"))
    local = agglomerative(named, "in_", "pos_", "v_").join(named.select("in_", "pos_", "key_"), ["in_", "pos_"])
    first = local.groupBy("in_", "label").agg(F.min("pos_").alias("p_"), F.count("*").alias("n_"))
    total = first.groupBy("in_").agg(F.sum("n_").alias("all_"), F.count("*").alias("k_"))
    # a row for each category
    begin = total.select("in_", F.coalesce(F.sum("k_").over(W.orderBy(F.desc("all_"), "in_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin_"))
    numbered = first.select("in_", "label", (F.row_number().over(W.partitionBy("in_").orderBy("p_")) - 1).alias("own_")).join(begin, "in_")
    return local.join(numbered, ["in_", "label"]).select(F.col("key_").alias(key), (F.col("begin_") + F.col("own_")).cast("int").alias("label"))


def usable_clusters(labels: DataFrame, label: str, noise: int = -1, least: int = 8, most_share: float = 0.45) -> bool:
    """Whether there are ``least`` clusters besides noise, and none holds more than ``most_share`` of all rows."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    kept = F.col(label) != noise
    row = sizes.agg(F.count_if(kept).alias("k"), F.max(F.when(kept, F.col("n"))).alias("largest"), F.sum("n").alias("all")).first()
    return row.k >= least and row.largest <= most_share * row["all"]


def clusters_or_kmeans(rows: DataFrame, key: str, vector: str, labels: DataFrame, seed: int = 42) -> DataFrame:
    """``labels`` (key, label) if they are usable, else k-means with the root of half the rows, 12 to 48 clusters."""
    if usable_clusters(labels, "label"):
        return labels.select(key, "label")
    n = rows.count()
    return kmeans(rows, key, vector, min(n, max(12, min(48, round((n / 2) ** 0.5)))), seed, 60)
