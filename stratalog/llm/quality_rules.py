"""Quality rules: base limits, then robust multivariate outliers per language and source.

Every document's text statistics are transformed (logs and shares) to a vector of ``len(FEATURES)``.
Each (lang, source) group gets minimum-covariance-determinant estimates: from two robust starts
(medians with absolute deviations, and the rows nearest the medians by ranks of size), concentration
steps keep the ``SUPPORT`` share of the group's rows that is nearest by Mahalanobis distance and
estimate mean and covariance from it anew; the start with the smaller determinant stands. Groups of
fewer than ``LEAST_ROWS`` rows use the estimates of their language, those of languages with fewer the
estimates of all rows; only estimates that some group uses are made. A document whose squared distance is over ``CUTOFF`` is rejected.

All of it is DataFrame expressions. Quantiles come from histograms of fixed, logarithmic bins, which
add up alike however the rows are dealt; a group's matrices are columns, and their Cholesky
factors are written out as expressions. A step is one pass for all groups and both starts: rows are
summed to counts and moments per bin of distance, at most some hundred bins a group, and a group's
nearest bins add up to its next estimate. Texts are read once: what is iterated over is a table of one
narrow row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.llm.common import WS_CHARS, WS_CLASS, discard, documents, materialize

FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats")
P = len(FEATURES)
SUPPORT = 0.75
STEPS = 4
LEAST_ROWS = 50
#: Far beyond the chi-square quantiles of Gaussian vectors: text statistics have long tails.
CUTOFF = 150.0
#: Variances of the transformed statistics do not fall below these, so that constant ones don't blow up.
_FLOOR = (0.25, 0.05, 0.03, 0.5, 0.1)
_BINS_PER_E = 16
#: Tables of one row per group are broadcast up to so many groups, and joined by shuffle beyond.
MOST_BROADCAST = 20_000


def _sent(table: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(table) if groups <= MOST_BROADCAST else table


def text_statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) of each whole text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word = F.filter(F.split("t", f"[{WS_CLASS}]+"), lambda w: w != "")
    base = docs.select(*carry, text.alias("t")).withColumn("w", word)
    base = base.select(
        *carry,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "").alias("ls"),
        F.transform(F.when(F.size("w") >= 5, F.sequence(F.lit(0), F.size("w") - 5)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)])).alias("hs"),
    )
    base = base.withColumn("n_dup_lines", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long")).drop("ls")
    # only texts that hold a window twice need to know which
    pairs = F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.array_sort(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("ps", pairs).drop("hs")
    before = lambda i: F.when(i > 0, F.get("ps", i - 1)["h"])
    starts = F.array_sort(F.transform(F.filter("ps", lambda p, i: p["h"].eqNullSafe(before(i)) | p["h"].eqNullSafe(F.get("ps", i + 1)["h"])), lambda p: p["i"]))
    base = base.withColumn("ss", starts).drop("ps")
    covered = F.aggregate(F.transform("ss", lambda s, i: F.least(F.lit(5), F.coalesce(F.get("ss", i + 1) - s, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", covered).drop("ss")


def _vector() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.log1p(20 * F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(5 * F.col("n_repeat_words") / n),
    ]


def _with_factor(groups: DataFrame) -> DataFrame:
    """Columns l_i_j of the Cholesky factor, a column at a time so that expressions stay small, and its log determinant."""
    for j in range(P):
        def rest(i: int, j: int = j) -> Column:
            out = F.col(f"c_{i}_{j}")
            for k in range(j):
                out = out - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            return out

        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-9))))
        if j + 1 < P:
            groups = groups.withColumns({f"l_{i}_{j}": rest(i) / F.col(f"l_{j}_{j}") for i in range(j + 1, P)})
    return groups.withColumn("logdet", sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, P)), F.log("l_0_0")))


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance of x_i to m_i with factor l_i_j, by forward substitution."""
    for i in range(P):
        solved = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            solved = solved - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", solved / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, P)), F.col("y_0") * F.col("y_0"))
    return rows.withColumn(name, total).drop(*[f"y_{i}" for i in range(P)])


def _bin(d: Column) -> Column:
    return F.floor(F.log(F.greatest(d, F.lit(1e-6))) * _BINS_PER_E).cast("int")


def _medians(rows: DataFrame, by: list[str], columns: dict[str, Column], per_unit: int = 200) -> DataFrame:
    """Group medians of columns to 1/``per_unit``, from histograms."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.round(c * per_unit).cast("int").alias("v")) for k, c in columns.items()])).alias("e")).select(*by, "e.f", "e.v")
    counts = long.groupBy(*by, "f", "v").agg(F.count("*").alias("c"))
    cum = F.sum("c").over(W.partitionBy(*by, "f").orderBy("v"))
    half = F.sum("c").over(W.partitionBy(*by, "f")) / 2
    mid = counts.withColumn("cum", cum).withColumn("half", half).where("cum >= half").groupBy(*by, "f").agg(F.min("v").alias("v"))
    return mid.groupBy(*by).agg(*[(F.max(F.when(F.col("f") == k, F.col("v"))) / per_unit).alias(k) for k in columns])


def _estimate(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """Mean m_i, covariance c_i_j and its factor of the ``share`` of each group's rows with the least ``d``, in whole bins; rows: by, x_i, m_i, d."""
    apart = {f"a_{i}": F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(P)}
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    moments = [F.sum(f"a_{i}").alias(f"a_{i}") for i in range(P)] + [F.sum(F.col(f"a_{i}") * F.col(f"a_{j}")).alias(f"v_{i}_{j}") for i, j in pairs]
    center = [f"m_{i}" for i in range(P)]
    bins = rows.withColumns(apart | {"bin": _bin(F.col("d"))}).groupBy(*by, "bin").agg(F.count("*").alias("n"), *moments, *[F.first(m).alias(m) for m in center])
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = bins.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy(*by))}).where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * share))
    sums = [f"a_{i}" for i in range(P)] + [f"v_{i}_{j}" for i, j in pairs]
    got = near.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], *[F.first(m).alias(m) for m in center])
    mean = {f"a_{i}": F.col(f"a_{i}") / F.col("n") for i in range(P)}
    got = got.withColumns(mean)
    covariance = {f"c_{i}_{j}": F.round((F.col(f"v_{i}_{j}") / F.col("n") - F.col(f"a_{i}") * F.col(f"a_{j}")) / SUPPORT, 9) + (_FLOOR[i] ** 2 if i == j else 0) for i, j in pairs}
    means = {f"m_{i}": F.round(F.col(f"m_{i}") + F.col(f"a_{i}"), 9) for i in range(P)}
    return _with_factor(got.withColumns(covariance | means).drop("n", *sums))


def groups_used(rows: DataFrame) -> DataFrame:
    """(lang, source, level, of_lang, of_all) of each pair: the level of its estimate, and whether its language's and the estimate of all are used by any."""
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = pairs.groupBy("lang").agg(F.sum("n").alias("of"))
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("of") >= LEAST_ROWS, 1).otherwise(0)
    pairs = pairs.join(langs, "lang").select("lang", "source", level.alias("level"))
    used = pairs.groupBy("lang").agg(F.max(F.col("level") == 1).alias("of_lang"))
    all_ = pairs.agg(F.coalesce(F.max(F.col("level") == 0), F.lit(False)).alias("of_all"))
    # one row
    return pairs.join(used, "lang").crossJoin(F.broadcast(all_))


def robust_estimates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of rows (lang, source, x_i) per (level, lang, source) that ``pairs`` use.

    level 2: language and source, level 1: language, level 0: all; the keys that a level has not are empty.
    """
    by, x = ["level", "lang", "source"], [f"x_{i}" for i in range(P)]
    empty = F.lit("")
    group = lambda level, lang, source, used: F.when(used, F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))
    levels = F.array_compact(F.array(group(2, F.col("lang"), F.col("source"), F.col("level") == 2), group(1, F.col("lang"), empty, F.col("of_lang")), group(0, empty, empty, F.col("of_all"))))
    n_groups = pairs.count()
    tall = rows.join(_sent(pairs, n_groups), ["lang", "source"]).select(F.explode(levels).alias("g"), *x).select("g.*", *x)
    mid = materialize(_medians(tall, by, {f"m_{i}": F.col(f"x_{i}") for i in range(P)}), "mcd-medians")
    spread = _medians(tall.join(_sent(mid, n_groups), by), by, {f"s_{i}": F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")) for i in range(P)})
    start = materialize(mid.join(spread, by), "mcd-start")
    discard(mid)
    terms = [F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")) / (F.col(f"s_{i}") * 1.4826 + _FLOOR[i]) for i in range(P)]
    squares = sum((t * t for t in terms[1:]), terms[0] * terms[0])
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    begun = tall.join(_sent(start, n_groups), by).select("*", kinds).withColumn("d", F.when(F.col("kind") == 0, squares).otherwise(F.greatest(*terms)))
    model = materialize(_estimate(begun, [*by, "kind"], 0.5), "mcd")
    discard(start)
    for _ in range(STEPS):
        near = _distance(tall.join(_sent(model, 2 * n_groups), by), "d")
        step = materialize(_estimate(near, [*by, "kind"], SUPPORT), "mcd")
        discard(model)
        model = step
    return model.groupBy(*by).agg(F.min_by(F.struct(*[c for c in model.columns if c not in by]), F.struct("logdet", "kind")).alias("e")).select(*by, "e.*")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept of every row.

    Words are runs without white space. base_failed: fewer than 10 words, or over 20 % of them in
    repeated five-word windows. Base failures are not part of the estimates and have no distance.
    kept: not base_failed and squared distance up to ``cutoff``. Null texts are empty (base_failed).
    Null lang and source are values of their own. Repeated rows are counted and returned as given;
    other columns are not read. Empty input: empty result.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("source"))
    stats = text_statistics(keyed, ("doc_id", "lang", "source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns({f"x_{i}": F.round(x, 9) for i, x in enumerate(_vector())})
    stats = materialize(stats, "statistics")
    usable = stats.where("not base_failed")
    pairs = materialize(groups_used(usable), "mcd-groups")
    model = robust_estimates(usable, pairs).drop("logdet", "kind", *[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)])
    keys = ["lang", "source"]
    own = pairs.select(*keys, "level", F.when(F.col("level") >= 1, F.col("lang")).otherwise("").alias("lang_"), F.when(F.col("level") == 2, F.col("source")).otherwise("").alias("source_"))
    table = own.join(model.withColumnsRenamed({"lang": "lang_", "source": "source_"}), ["level", "lang_", "source_"]).drop("level", "lang_", "source_")
    table = materialize(table, "mcd-table")
    out = _distance(stats.join(_sent(table, table.count()), keys, "left"), "distance")
    distance = F.when(~F.col("base_failed"), F.col("distance"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
