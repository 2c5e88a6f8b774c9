"""Multi-label scores in long form (unit_id, tag_id, score): selection, counts, evaluation, bundles, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.operators.sizes import small


def selected(scores: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Scores at or over their tag's threshold (0.5 without one)."""
    limits = vocabulary.select(F.col("id").alias("tag_id"), F.coalesce("threshold", F.lit(0.5)).alias("limit_"))
    return scores.join(small(limits), "tag_id").where("score >= limit_").drop("limit_")


def tag_report(scores: DataFrame, vocabulary: DataFrame, units: DataFrame, sweep=(0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Per tag, zeros included: selected units and their posts, score sum, and units at each sweep threshold."""
    limits = vocabulary.select(F.col("id").alias("tag_id"), F.coalesce("threshold", F.lit(0.5)).alias("limit_"))
    hit = F.col("score") >= F.col("limit_")
    counts = (
        scores.join(small(limits), "tag_id")
        .join(units.select("unit_id", "posts"), "unit_id")
        .groupBy("tag_id")
        .agg(F.count_if(hit).alias("unit_count"), F.sum(F.when(hit, F.col("posts"))).alias("post_count"), F.round(F.sum("score"), 6).alias("score_sum"), *[F.count_if(F.col("score") >= t).alias(f"at_{int(t * 100)}") for t in sweep])
    )
    # one row per tag is left to join
    return limits.select("tag_id").join(counts, "tag_id", "left").na.fill(0).select(*counts.columns)


def evaluate(predicted: DataFrame, gold: DataFrame, tags: DataFrame) -> DataFrame:
    """Per tag: tp, fp, fn, precision and recall (null on empty denominators). Inputs: (unit_id, tag_id); tags: tag_id."""
    p, g = predicted.select("unit_id", "tag_id").distinct().withColumn("p", F.lit(1)), gold.select("unit_id", "tag_id").distinct().withColumn("g", F.lit(1))
    both = p.join(g, ["unit_id", "tag_id"], "full")
    counts = both.groupBy("tag_id").agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("p is null and g = 1")).alias("fn"))
    counts = tags.join(counts, "tag_id", "left").na.fill(0)
    return counts.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def exact_sets(predicted: DataFrame, gold: DataFrame, units: DataFrame) -> DataFrame:
    """Share of units whose predicted and gold tag sets are equal."""
    of = lambda df, name: df.groupBy("unit_id").agg(F.sort_array(F.collect_set("tag_id")).alias(name))
    both = units.select("unit_id").join(of(predicted, "p"), "unit_id", "left").join(of(gold, "g"), "unit_id", "left")
    none = F.array().cast("array<string>")
    return both.agg(F.count("*").alias("units"), F.round(F.avg((F.coalesce("p", none) == F.coalesce("g", none)).cast("int")), 6).alias("exact"))


def bundle(chosen: DataFrame, mapping: DataFrame, units: DataFrame) -> DataFrame:
    """Per category: units, posts, and units that other categories have too. mapping: category_id, tag_id."""
    pairs = chosen.join(small(mapping), "tag_id").select("unit_id", "category_id").distinct()
    many = pairs.groupBy("unit_id").agg((F.count("*") > 1).alias("many"))
    rows = pairs.join(many, "unit_id").join(units.select("unit_id", "posts"), "unit_id")
    counts = rows.groupBy("category_id").agg(F.count("*").alias("units"), F.sum("posts").alias("posts"), F.count_if("many").alias("shared"))
    return mapping.select("category_id").distinct().join(counts, "category_id", "left").na.fill(0)


def unassigned(chosen: DataFrame, mapping: DataFrame, units: DataFrame) -> DataFrame:
    return units.select("unit_id").join(chosen.join(small(mapping), "tag_id").select("unit_id"), "unit_id", "left_anti")


def unmapped(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    return tags.select("tag_id").join(mapping.select("tag_id"), "tag_id", "left_anti")


def ranked_categories(scores: DataFrame, mapping: DataFrame, units: DataFrame, rest: str = "overig") -> DataFrame:
    """Categories of each unit by their best selected score (over 0), ties by ``ordinal``; ``rest`` without any."""
    best = scores.where("score > 0").join(small(mapping), "tag_id").groupBy("unit_id", "category_id", "ordinal").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("unit_id").orderBy(F.desc("score"), "ordinal"))).select("unit_id", "category_id", "rank", "score")
    alone = units.select("unit_id").join(best.select("unit_id").distinct(), "unit_id", "left_anti").select("unit_id", F.lit(rest).alias("category_id"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"))
    return ranked.unionByName(alone)


def representatives(scores: DataFrame, by: str, pos: str, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), pos))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _equals(term: str):
    return lambda t: t == term


def rule_category(text: Column, tokens: Column, visual: Column, taxonomy: list[dict], least: float = 1.5, rest: str = "Overig") -> Column:
    """Best category of a taxonomy (label, visual, text): 2.4 a visual term, 1.2 a phrase, a token up to 3 times; the first wins ties."""
    candidates = []
    for k, c in enumerate(taxonomy):
        score = F.lit(0.0)
        for term in sorted(c["visual"]):
            score = score + F.when(F.array_contains(visual, term), 2.4).otherwise(0.0)
        for term in sorted(c["text"]):
            if " " in term:
                score = score + F.when(F.contains(text, F.lit(term)), 1.2).otherwise(0.0)
            else:
                score = score + F.least(F.size(F.filter(tokens, _equals(term))), F.lit(3)).cast("double")
        candidates.append(F.struct(F.round(score, 6).alias("score"), F.lit(-k).alias("k"), F.lit(c["label"]).alias("label")))
    best = F.array_max(F.array(*candidates))
    return F.when(best["score"] >= least, best["label"]).otherwise(rest)


def theme_tags(text: Column, themes: list[tuple[str, list[str]]], fallback: Column, default: str, most: int = 4) -> Column:
    """Themes with a term in the text at word boundaries; else the fallback array, else ``default``."""
    hits = F.array(*[F.when(text.rlike("(?i)(?<![\\p{L}\\p{N}_])(" + "|".join(terms) + ")(?![\\p{L}\\p{N}_])"), F.lit(k)) for k, terms in themes])
    found = F.filter(hits, lambda x: x.isNotNull())
    chosen = F.when(F.size(found) > 0, found).when(F.size(fallback) > 0, fallback).otherwise(F.array(F.lit(default)))
    return F.slice(chosen, 1, most)


def substring_terms(text: Column, terms: list[tuple[str, list[str]]], k: int = 3) -> Column:
    """The ``k`` ids whose terms occur most often as substrings; ties by id downwards."""
    low = F.lower(text)
    counted = F.array(*[F.struct(sum((F.size(F.split(low, t)) - 1 for t in ts), F.lit(0)).alias("n"), F.lit(i).alias("id")) for i, ts in terms])
    ranked = F.slice(F.reverse(F.array_sort(F.filter(counted, lambda c: c["n"] > 0))), 1, k)
    return F.transform(ranked, lambda c: c["id"])


def family_rule(people: Column, category: Column, title: Column, excerpt: Column, least: float = 0.65, wanted: str = "familie", pattern: str = r"(?i)\b(familie|feest|verjaardag)\b") -> Column:
    """Family photo: people score, category, and a word in title or excerpt, all together."""
    return F.coalesce((people >= least) & (category == wanted) & F.concat_ws(" ", title, excerpt).rlike(pattern), F.lit(False))
