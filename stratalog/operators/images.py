"""Image evidence: context of an image inside its post, observations, and publishing joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.functions.scalars import image_id
from stratalog.functions.urls import url_path

LINK_KINDS = ("alt", "figcaption", "numbered_caption")
MOST_LINKS, LINK_CHARS, EXCERPT_CHARS = 2, 240, 500


def image_records(posts: DataFrame) -> DataFrame:
    """One row per image occurrence of posts (id, images): image_id, post_id, index (in the unfiltered list), src."""
    each = posts.select(F.col("id").alias("post_id"), F.posexplode("images").alias("index", "src")).where("src is not null and src <> ''")
    return each.select(image_id(F.col("post_id"), F.col("index"), F.col("src")).alias("image_id"), "post_id", "index", "src")


def featured(posts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct images in the order of posts (pos) and inside them."""
    each = posts.select("pos", F.posexplode("images").alias("index", "src"))
    first = each.groupBy("src").agg(F.min(F.struct("pos", "index")).alias("at"))
    return first.orderBy("at.pos", "at.index").limit(n).select("src")


def caption_links(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Numbered captions (post_id, text: `1 & 2 ...`) with the images (ordinals from 1) that they name."""
    ranged = captions.select("post_id", "text", X.caption_range(F.col("text")).alias("r")).where("r is not null")
    numbered = images.withColumn("ordinal", F.col("index") + 1)
    return numbered.join(ranged, (numbered.post_id == ranged.post_id) & F.col("ordinal").between(F.col("r.first"), F.col("r.last"))).select(numbered.image_id, F.lit("numbered_caption").alias("kind"), "text", ranged.post_id.alias("source_post_id"))


def html_links(images: DataFrame, extracted: DataFrame) -> DataFrame:
    """Alternative texts and captions of the same post's HTML images (post_id, index, src, alt, caption), by path and place."""
    left = images.select("image_id", "post_id", "index", url_path(F.col("src")).alias("path"))
    right = extracted.select("post_id", "index", url_path(F.col("src")).alias("path"), "alt", "caption")
    both = left.join(right, ["post_id", "index", "path"])
    kinds = F.array(F.struct(F.lit("alt").alias("kind"), F.col("alt").alias("text")), F.struct(F.lit("figcaption").alias("kind"), F.col("caption").alias("text")))
    return both.select("image_id", F.explode(kinds).alias("k"), F.col("post_id").alias("source_post_id")).select("image_id", "k.kind", "k.text", "source_post_id").where(X.meaningful(F.col("text")))


def usable_links(links: Column, post_id: Column) -> Column:
    """Of (kind, text, sourcePostId): known kinds with a meaning from the same post, trimmed and cut, the first two."""
    kept = F.filter(links, lambda x: x["kind"].isin(*LINK_KINDS) & X.meaningful(x["text"]) & (x["sourcePostId"] == post_id))
    return F.slice(F.transform(kept, lambda x: F.substring(F.trim(x["text"]), 1, LINK_CHARS)), 1, MOST_LINKS)


def image_state(description: Column, context: Column) -> Column:
    """What is seen and what is linked, apart: JSON with sorted keys."""
    linked = F.struct(context["postTitle"].alias("postTitle"), context["seriesTitle"].alias("seriesTitle"), usable_links(context["linkedText"], context["postId"]).alias("texts"))
    return F.to_json(F.struct(linked.alias("linkedContext"), description.alias("visualDescription")))


def post_excerpt(markup: Column) -> Column:
    return F.substring(X.plain_text(markup), 1, EXCERPT_CHARS)


def observations(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions by source for every occurrence; images without one are left out, see :func:`uncaptioned`."""
    return images.join(captions.select("src", "caption", "model"), "src")


def uncaptioned(images: DataFrame, captions: DataFrame) -> DataFrame:
    return images.join(captions.select("src"), "src", "left_anti")


def accepted(rows: DataFrame, statuses: tuple[str, ...] = ("accepted", "edited")) -> DataFrame:
    """Observations of an accepted status; one without model or description is an error."""
    sound = F.assert_true(F.col("descriptionModel").isNotNull() & (F.coalesce(F.trim("description"), F.lit("")) != ""), F.lit("observation without provenance"))
    return rows.where(F.col("descriptionStatus").isin(*statuses)).withColumn("ok_", sound).where("ok_ is null").drop("ok_")


def published(images: DataFrame, seen: DataFrame, chosen: DataFrame, post_categories: DataFrame) -> DataFrame:
    """Images with description, selected tags (best first) and their post's categories."""
    tags = chosen.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "tag_id"))), lambda x: x["tag_id"]).alias("imageTagIds"))
    cats = post_categories.groupBy("post_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category_id"))), lambda x: x["category_id"]).alias("categoryIds"))
    none = F.array().cast("array<string>")
    out = images.join(seen.select("image_id", "description"), "image_id", "left").join(tags, "image_id", "left").join(cats, "post_id", "left")
    return out.withColumn("imageTagIds", F.coalesce("imageTagIds", none)).withColumn("categoryIds", F.coalesce("categoryIds", none))
