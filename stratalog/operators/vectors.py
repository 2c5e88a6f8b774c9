"""Vectors: normalising, exact neighbours in blocks, TF-IDF projection, fusion, coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stratalog.operators.sizes import small

BLOCK_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays. The vector and its norm are bound once, not computed for each element."""
    bound = F.transform(F.array(v), lambda a: F.struct(a.alias("v"), norm(a).alias("n")))
    unit = F.transform(bound, lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))
    return F.get(unit, F.lit(0))


def invalid_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is null, zero, not finite, or of another length than the longest."""
    size = rows.agg(F.max(F.size(vector)).alias("size_"))
    odd = F.col(vector).isNull() | (F.size(vector) != F.col("size_")) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(F.col(vector)) == 0)
    return rows.crossJoin(F.broadcast(size)).where(odd).drop("size_")


def _best(ids: np.ndarray, matrix: np.ndarray, other: np.ndarray, v: np.ndarray, k: int) -> list[pa.Array]:
    """key, neighbour, sim: of each query (ids, unit rows) the ``k`` nearest of the rows ``other``, ``v``."""
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    order = np.argsort(other, kind="stable")
    sim = np.round(matrix @ v[order].T, 9)
    sim[ids[:, None] == other[order][None, :]] = -2
    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    pick = np.take_along_axis(sim, top, 1)
    keep = (pick > -2).ravel()
    return [pa.array(np.repeat(ids, top.shape[1])[keep]), pa.array(other[order][top].ravel()[keep]), pa.array(pick.ravel()[keep])]


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


_NEAR = "key long, neighbour long, sim double"


def neighbours(rows: DataFrame, key: str, vector: str, k: int = 5, queries: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine neighbours: key, neighbour, sim, rank; ties by the neighbour's key, a row is no neighbour of itself.

    Up to ``block_rows`` queries (all rows unless given) are broadcast to one pass over all rows. More
    are dealt into blocks, as the rows are, and each block of queries meets each block of rows in a task
    of its own, by shuffle. Either way tasks multiply matrices and keep k rows per query.
    """
    spark = rows.sparkSession
    clean = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k_"), F.col(vector).cast("array<double>").alias("v_"))
    asked = clean if queries is None else queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k_"), F.col(vector).cast("array<double>").alias("v_"))
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "key long, neighbour long, sim double, rank int")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    if n_asked <= block_rows:
        block = asked.orderBy("k_").collect()
        sent = spark.sparkContext.broadcast((np.array([r.k_ for r in block]), unit(np.array([r.v_ for r in block]))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(_best(*sent.value, batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows), k), names=["key", "neighbour", "sim"])

        out = clean.mapInArrow(scan, _NEAR)
    else:

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["key", "neighbour", "sim"])
            found = _best(left.column("k_").to_numpy(), unit(_matrix(left.column("v_"), left.num_rows)), right.column("k_").to_numpy(), _matrix(right.column("v_"), right.num_rows), k)
            return pa.table(found, names=["key", "neighbour", "sim"])

        across, down = -(-clean.count() // block_rows), -(-n_asked // block_rows)
        of = lambda n: F.pmod(F.xxhash64("k_"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("k_", "v_", of(down).alias("i"), every(across).alias("j"))
        right = clean.select("k_", "v_", every(down).alias("i"), of(across).alias("j"))
        out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, _NEAR)
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("sim"), "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def labels_by_vector(rows: DataFrame, key: str, vector: str, labels: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest of a small label table (label, lv) for every row."""
    sims = rows.select(key, F.col(vector)).crossJoin(small(labels)).select(key, "label", F.round(dot(normalized(F.col(vector)), normalized(F.col("lv"))), 6).alias("sim"))
    return sims.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), "label"))).where(F.col("rank") <= k)


def tfidf(tokens: DataFrame, key: str, size: int = 5000) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1) over the ``size`` commonest terms, rows of unit length. tokens: key, term."""
    counts = tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = tokens.agg(F.countDistinct(key).alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(size)
    raw = counts.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias("weight"))


def random_projection(weights: DataFrame, key: str, dimensions: int = 384, seed: int = 42) -> DataFrame:
    """Gaussian random projection of sparse rows: a term's direction is drawn from its hash, so nothing is sent about."""
    listed = weights.groupBy(key).agg(F.collect_list(F.struct(F.xxhash64("term", F.lit(seed)).alias("h"), F.col("weight").cast("double").alias("w"))).alias("e"))
    listed = listed.select(key, F.transform("e", lambda x: x["h"]).alias("h"), F.transform("e", lambda x: x["w"]).alias("w"))

    def run(frames):
        for pdf in frames:
            size = pdf.h.map(len).to_numpy()
            part = np.cumsum(size) // _PROJECTED  # so many terms' directions are held at once, or those of one row
            out = []
            for _, rows in pdf.groupby(part, sort=False):
                terms, at = np.unique(np.concatenate(rows.h.to_list()), return_inverse=True)
                g, begin = directions(terms, dimensions), 0
                for w in rows.w:
                    out.append(np.asarray(w) @ g[at[begin : begin + len(w)]])
                    begin += len(w)
            yield pdf[[key]].assign(vector=out)

    summed = listed.mapInPandas(run, f"{key} {dict(weights.dtypes)[key]}, vector array<double>")
    return summed.select(key, normalized(F.col("vector")).alias("vector"))


_PROJECTED = 1 << 14


def directions(terms: np.ndarray, dimensions: int) -> np.ndarray:
    """A standard normal vector for each term hash (Box and Muller's transform of two mixed hashes)."""

    def uniform(salt: int) -> np.ndarray:
        x = terms.astype(np.int64).view(np.uint64)[:, None] + np.arange(salt, 2 * dimensions, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2**53

    return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


def fuse(text: Column, image: Column, text_weight: Column, image_weight: Column) -> Column:
    """Weighted unit vectors side by side, of unit length; texts alone where there is no image vector."""
    scaled = lambda v, w: F.transform(normalized(v), lambda x: x * w)
    blank = F.transform(text, lambda x: F.lit(0.0))
    return normalized(F.concat(scaled(text, text_weight), F.coalesce(scaled(image, image_weight), blank)))


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    each = rows.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def clipped(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns clamped to interpolated percentiles and scaled to 0..1."""
    limits = rows.agg(*[F.percentile(c, p).alias(f"{c}_{n}_") for c in columns for n, p in (("lo", low), ("hi", high))])
    out = rows.crossJoin(F.broadcast(limits))
    for c in columns:
        lo, hi = F.col(f"{c}_lo_"), F.col(f"{c}_hi_")
        out = out.withColumn(c, F.round(F.coalesce(F.try_divide(F.least(F.greatest(F.col(c), lo), hi) - lo, hi - lo), F.lit(0.5)), 6))
    return out.drop(*[f"{c}_{n}_" for c in columns for n in ("lo", "hi")])


def padded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by minimum and maximum into 0.04..0.96; 0.5 where all are equal."""
    limits = rows.agg(*[f(c).alias(f"{c}_{n}_") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.crossJoin(F.broadcast(limits))
    for c in columns:
        lo, hi = F.col(f"{c}_lo_"), F.col(f"{c}_hi_")
        out = out.withColumn(c, F.round(F.coalesce(F.try_divide(F.col(c) - lo, hi - lo) * 0.92 + 0.04, F.lit(0.5)), 6))
    return out.drop(*[f"{c}_{n}_" for c in columns for n in ("lo", "hi")])


def pca_map(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """First principal coordinates (signs are arbitrary) as columns x, y."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fed = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v_"))
    out = PCA(k=k, inputCol="v_", outputCol="p_").fit(fed).transform(fed)
    return out.select(key, *[vector_to_array("p_")[i].alias(n) for i, n in enumerate(("x", "y", "z")[:k])])
