"""Evidence-based tags: alias hits in fields, merged by candidate, with a confidence ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.functions.spam import field_spam
from stratalog.functions.text import squeeze
from stratalog.operators.sizes import small

MOST_TAGS, MOST_EVIDENCE, SNIPPET = 12, 4, 220
_EDGE = r"[\p{L}\p{N}_]"


def alias_pattern(aliases: Column) -> Column:
    """One regex for an array of aliases of three characters or more, the longest first."""
    usable = F.filter(aliases, lambda a: F.char_length(a) >= 3)
    by_length = F.array_sort(F.transform(usable, lambda a: F.struct((-F.char_length(a)).alias("n"), a.alias("a"))))
    quoted = F.transform(by_length, lambda s: F.regexp_replace(s["a"], r"([\\.\[\]{}()*+?^$|-])", r"\\$1"))
    return F.concat(F.lit(f"(?i)(?<!{_EDGE})("), F.array_join(quoted, "|"), F.lit(f")(?!{_EDGE})"))


def alias_hits(fields: DataFrame, candidates: DataFrame, before: int = 70, after: int = 90) -> DataFrame:
    """key, field, candidate_id, snippet: where an alias occurs in a field that is no spam.

    ``fields``: key, field, text. ``candidates`` (candidate_id, aliases) are a stated list. A field meets
    the candidates of which an alias begins with one of its words, by a hash join on that word; the
    patterns are tried on those only. An alias without a letter or digit is tried on every field.
    """
    lead = lambda a: F.regexp_extract(F.lower(a), rf"({_EDGE}+)", 1)
    usable = candidates.select("candidate_id", F.filter("aliases", lambda a: F.char_length(a) >= 3).alias("aliases")).where(F.size("aliases") > 0)
    leads = usable.select("candidate_id", alias_pattern(F.col("aliases")).alias("pattern"), F.array_distinct(F.transform("aliases", lead)).alias("leads"))
    leads = leads.select("candidate_id", "pattern", F.explode("leads").alias("lead"))
    asked = [r.lead for r in leads.select("lead").distinct().collect()]
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"({_EDGE}+)"), F.lit(1))
    words = F.array_intersect(F.concat(F.array(F.lit("")), found), F.array(*[F.lit(x) for x in sorted(asked)]).cast("array<string>"))
    near = fields.where(F.col("text").isNotNull() & ~field_spam(F.col("text"))).select("key", "field", "text", F.explode(words).alias("lead"))
    met = near.join(small(leads), "lead").where(F.expr("text rlike pattern")).dropDuplicates(["key", "field", "text", "candidate_id"])
    at = F.expr("regexp_instr(text, pattern)")
    length = F.char_length(F.expr("regexp_substr(text, pattern)"))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(F.col("text"), start, at + length + after - start)
    return met.select("key", "field", "candidate_id", F.substring(squeeze(cut), 1, SNIPPET).alias("snippet"))


def confidence(sources: Column, kind: Column) -> Column:
    has = lambda *names: F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))
    named = F.contains(kind, F.lit("cultivar")) | F.contains(kind, F.lit("species"))
    return F.when(has("ocr", "title", "caption"), "high").when(has("excerpt", "post_text"), F.when(named, "high").otherwise("medium")).when(has("visual_context"), "medium").when(has("image_similarity"), "low").otherwise("medium")


def merged(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, candidate_id, label, type, sources, confidence, evidence (up to 4), rank (up to 12)."""
    each = hits.groupBy("key", "candidate_id").agg(F.sort_array(F.collect_set("field")).alias("sources"), F.slice(F.sort_array(F.collect_set(F.struct("field", "snippet"))), 1, MOST_EVIDENCE).alias("evidence"))
    named = each.join(small(candidates.select("candidate_id", "label", "type")), "candidate_id").withColumn("confidence", confidence(F.col("sources"), F.col("type")))
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("key").orderBy(order, "type", "label", "candidate_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= MOST_TAGS)


def binomials(texts: DataFrame, text: str, least: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """Latin binomials by frequency, texts with shop words left out; letters with accents are parts of words too."""
    found = texts.where(~field_spam(F.col(text))).select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<!{_EDGE})([A-Z][a-z]{{2,}}\s+[a-z][a-z-]{{2,}})(?:(?<={_EDGE})(?!{_EDGE})|(?<!{_EDGE})(?={_EDGE}))"), F.lit(1))).alias("label"))
    if stop:
        found = found.where(~F.split("label", r"\s+")[0].isin(*stop))
    return found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
