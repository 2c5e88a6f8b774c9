"""Data-quality checks: each returns the violations as (check, key); ``enforce`` raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Some rows break a rule; the message names the first few."""


def _rows(df: DataFrame, check: str, key) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key") if not isinstance(key, str) else F.col(key).cast("string").alias("key"))


def enforce(*checks: DataFrame) -> None:
    for c in checks:
        if found := c.limit(5).collect():
            raise CheckFailed(f"{found[0]['check']}: {', '.join(str(r['key']) for r in found)}")


def duplicates(rows: DataFrame, key: str, check: str = "duplicate id") -> DataFrame:
    return _rows(rows.groupBy(key).count().where("count > 1"), check, key)


def unknown(rows: DataFrame, key: str, known: DataFrame, known_key: str, check: str = "unknown id") -> DataFrame:
    return _rows(rows.select(key).distinct().join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti"), check, key)


def coverage(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Keys that only one side has."""
    return unknown(left, left_key, right, right_key, "missing on the right").union(unknown(right, right_key, left, left_key, "missing on the left"))


def series_rules(series: DataFrame, posts: DataFrame) -> DataFrame:
    """Series of fewer than two members, with unknown members, or with members of another series."""
    bridge = series.select("id", F.explode("postIds").alias("post_id"))
    small = _rows(series.where(F.size("postIds") < 2), "short series", "id")
    return small.union(unknown(bridge, "post_id", posts, "id", "unknown member")).union(duplicates(bridge, "post_id", "member of two series"))


def vocabulary_rules(tags: DataFrame) -> DataFrame:
    """Tags (id, label, question, threshold): snake-case unique ids, texts that are not blank, thresholds inside (0, 1)."""
    odd_id = _rows(tags.where(~F.coalesce(F.col("id").rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), F.lit(False))), "id is not snake case", "id")
    blank = _rows(tags.where("coalesce(trim(label), '') = '' or coalesce(trim(question), '') = ''"), "blank text", "id")
    limit = _rows(tags.where("threshold <= 0 or threshold >= 1 or isnan(threshold)"), "threshold outside of (0, 1)", "id")
    return odd_id.union(blank).union(limit).union(duplicates(tags, "id"))


def mapping_rules(mapping: DataFrame, tags: DataFrame, reserved: str = "overig", cover: bool = True) -> DataFrame:
    """Category maps (category_id, tag_id): known tags, each tag somewhere, the reserved id unused."""
    out = unknown(mapping, "tag_id", tags, "id", "unknown tag").union(_rows(mapping.where(F.col("category_id") == reserved), "reserved category", "category_id"))
    return out.union(unknown(tags, "id", mapping, "tag_id", "tag without category")) if cover else out


def score_rules(scores: DataFrame) -> DataFrame:
    """Scores inside 0..1, costs finite and not negative."""
    bad = scores.where("score is null or isnan(score) or score < 0 or score > 1")
    out = _rows(bad, "score outside of 0..1", F.concat_ws("/", "unit_id", "tag_id"))
    if "cost" in scores.columns:
        out = out.union(_rows(scores.where("cost is null or isnan(cost) or cost < 0 or cost = double('infinity')"), "cost", F.concat_ws("/", "unit_id", "tag_id")))
    return out


def embedding_rules(rows: DataFrame, expected: int) -> DataFrame:
    """Responses (index, embedding): indexes 0 to expected - 1 once, equal lengths over 0, finite numbers."""
    spine = rows.sparkSession.range(expected).select(F.col("id").alias("index"))
    out = duplicates(rows, "index").union(coverage(rows.select(F.col("index").cast("long")), "index", spine, "index"))
    sizes = rows.agg(F.max(F.size("embedding")).alias("m"))
    bad = rows.crossJoin(F.broadcast(sizes)).where(F.coalesce(F.size("embedding") != F.col("m"), F.lit(True)) | (F.size("embedding") < 1) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return out.union(_rows(bad, "vector", "index"))


def caption_rules(rows: DataFrame, expected: DataFrame, chars: int = 400, tags: int = 6) -> DataFrame:
    """Captions (pos, id, caption, tags) with the expected (pos, id), short texts and few tags."""
    joined = rows.join(expected.select("pos", F.col("id").alias("want")), "pos", "full")
    out = _rows(joined.where("id is null or want is null or id <> want"), "id or order", F.coalesce("id", "want"))
    return out.union(_rows(rows.where((F.char_length("caption") > chars) | (F.size("tags") > tags)), "caption or tags too long", "id"))


def one_value(rows: DataFrame, column: str) -> DataFrame:
    """More than one value in a column that should have one (model, hash)."""
    return _rows(rows.agg(F.count_distinct(column).alias("n")).where("n > 1"), f"several values of {column}", "n")


def drift(now: DataFrame, then: DataFrame, key: str, digest: str) -> DataFrame:
    both = now.select(key, F.col(digest).alias("a")).join(then.select(key, F.col(digest).alias("b")), key)
    return _rows(both.where("not a <=> b"), "source changed", key)


def require_limits(limit: int | None, approved: bool, trial: int = 5) -> None:
    """A paid run needs a stated limit, and an approved vocabulary unless it is a small trial."""
    if limit is None or limit < 1:
        raise CheckFailed("a limit has to be stated")
    if not approved and limit > trial:
        raise CheckFailed("the vocabulary is not approved")
