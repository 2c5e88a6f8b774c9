"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every node's path from the
root becomes a conjunctive rule. Logistic regression with an L1 penalty (accelerated proximal
gradient) weighs rules and standardised statistics, and leaves most at zero. The rest is compiled
into one Spark column, so that scoring is a projection of the documents without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import WS_CHARS, WS_CLASS, documents, held_out

#: At most so many labelled rows, the first by a hash of doc_id, are read for fitting.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, LEAST_LEAF = 24, 3, 0.3, 20
PENALTY = 1e-3
THRESHOLD = 0.3

STATISTICS = ("log_words", "word_length", "symbols", "exclaims", "capitals", "digits", "stops", "distinct_words", "stutter", "distinct_lines", "line_words", "wide")


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and the ``STATISTICS`` (doubles) of each whole text; null and empty texts have defined values."""
    base = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t_"))
    base = base.withColumn("w_", F.filter(F.split("t_", f"[{WS_CLASS}]+"), lambda w: w != ""))
    base = base.withColumn("l_", F.filter(F.split("t_", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""))
    n, chars, lines = (F.greatest(x, F.lit(1)).cast("double") for x in (F.size("w_"), F.char_length("t_"), F.size("l_")))
    count = lambda pattern: F.regexp_count("t_", F.lit(pattern)).cast("double")
    stutter = F.size(F.filter(F.transform("w_", lambda w, i: (i > 0) & (w == F.get("w_", i - 1))), lambda x: x))
    return base.select(
        *carry,
        F.log1p(F.size("w_").cast("double")).alias("log_words"),
        (F.char_length(F.array_join("w_", "")) / n).alias("word_length"),
        (count("[#*$%&|<>]") / n).alias("symbols"),
        (count("!") / n).alias("exclaims"),
        (count("[A-Z]") / chars).alias("capitals"),
        (count("[0-9]") / chars).alias("digits"),
        (count("[.,;:?]") / n).alias("stops"),
        (F.size(F.array_distinct("w_")) / n).alias("distinct_words"),
        (stutter / n).alias("stutter"),
        (F.size(F.array_distinct("l_")) / lines).alias("distinct_lines"),
        (n / lines).alias("line_words"),
        ((F.octet_length("t_") - F.char_length("t_")) / chars).alias("wide"),
    )


@dataclass
class Model:
    """Bias, weighted rules ((statistic, is_less, bound), ...) and weighted statistics."""

    bias: float = 0.0
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)
    linear: list[tuple[int, float]] = field(default_factory=list)

    def column(self) -> Column:
        terms = [F.lit(self.bias)]
        for rule, weight in self.rules:
            parts = [(F.col(STATISTICS[f]) <= bound) if less else (F.col(STATISTICS[f]) > bound) for f, less, bound in rule]
            every = parts[0]
            for p in parts[1:]:
                every = every & p
            terms.append(F.when(every, F.lit(weight)).otherwise(F.lit(0.0)))
        terms += [F.col(STATISTICS[f]) * F.lit(weight) for f, weight in self.linear]
        while len(terms) > 1:  # a balanced sum keeps the expression shallow
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(terms[0], F.lit(30.0)), F.lit(-30.0))))


def _covered(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, less, bound in rule:
        out &= (x[:, f] <= bound) == less
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rule: tuple, rows: np.ndarray, out: list) -> None:
    """Append (rule, leaf value or None) of every node below."""
    if rule:
        out.append((rule, None))
    total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
    best, found = 1e-6 + total_g**2 / total_h, None
    if len(rule) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            bin_ = np.searchsorted(cuts[f], x[rows, f])
            size = len(cuts[f]) + 1
            n = np.cumsum(np.bincount(bin_, minlength=size))[:-1]
            gl = np.cumsum(np.bincount(bin_, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(bin_, h[rows], size))[:-1]
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl)
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, float(cuts[f][k]))
    if found is None:
        if rule:
            out[-1] = (rule, total_g / total_h)
        return
    f, bound = found
    less = x[rows, f] <= bound
    _grow(x, g, h, cuts, (*rule, (f, True, bound)), rows[less], out)
    _grow(x, g, h, cuts, (*rule, (f, False, bound)), rows[~less], out)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit rows of statistics to labels 0 and 1; without both labels the model is constant."""
    if not len(y) or y.min() == y.max():
        return Model(bias=0.0 if not len(y) else float(4 * (2 * y[0] - 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    rules: dict[tuple, None] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        nodes: list = []
        _grow(x, y - p, p * (1 - p), cuts, (), np.arange(len(y)), nodes)
        for rule, value in nodes:
            rules.setdefault(tuple(sorted(rule)))
            if value is not None:
                z[_covered(x, rule)] += RATE * value
    listed = list(rules)
    center, scale = x.mean(0), x.std(0) + 1e-9
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    usable = [f for f in range(x.shape[1]) if high[f] > low[f]]
    a = np.stack([*[_covered(x, r).astype(np.float64) for r in listed], *[(x[:, f] - center[f]) / scale[f] * 0.4 for f in usable]], 1)
    shift = a.mean(0)
    a -= shift
    step = 4.0 / max(1e-9, np.linalg.eigvalsh(a.T @ a / len(y))[-1])
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.log(y.mean() / (1 - y.mean())), 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(a @ v + b))) - y
        b -= step * r.mean() if step < 4 else 4 * r.mean()
        new = v - step * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    bias = float(b - (w * shift).sum())
    found = Model(rules=[(listed[k], float(w[k])) for k in kept if k < len(listed)])
    for k in kept:
        if k >= len(listed):
            f = usable[k - len(listed)]
            weight = float(w[k]) * 0.4 / scale[f]
            found.linear.append((f, weight))
            bias -= weight * center[f]
    found.bias = bias
    return found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out; a document labelled twice takes its least label."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(read, ("doc_id", "quality")).toPandas().sort_values("doc_id", kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.3) of every whole text.

    Null texts score as empty ones. Other columns are not read; rows may repeat; empty input: empty result.
    """
    scored = statistics(docs, carry).select(*carry, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
