"""Publishing: post lists, related posts, topics, datasets as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.functions import text as X
from stratalog.functions.scalars import ordered_union
from stratalog.operators.ranking import global_rank

#: The named datasets of the explorer, and how each document turns into rows.
DATASETS = {"posts": "array", "series": "array", "images": "array", "topics": "array", "points": "array", "manifest": "object", "related": "keyed", "calendar": "keyed", "species": "array", "species_groups": "array"}


def slim(posts: DataFrame, columns: list[str]) -> DataFrame:
    return posts.select(*[c for c in columns if c in posts.columns])


def related_posts(units: DataFrame, neighbours: DataFrame, k: int = 6) -> DataFrame:
    """post_id, related: series siblings in order, then the first posts of neighbour units, without itself.

    units: unit_id, post_ids; neighbours: key, neighbour, rank (unit ids).
    """
    firsts = neighbours.join(units.select(F.col("unit_id").alias("neighbour"), F.get("post_ids", F.lit(0)).alias("first")), "neighbour")
    near = firsts.groupBy(F.col("key").alias("unit_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "first"))), lambda x: x["first"]).alias("near"))
    each = units.join(near, "unit_id", "left").select(F.explode("post_ids").alias("post_id"), "post_ids", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    return each.select("post_id", F.slice(F.filter(ordered_union(F.col("post_ids"), F.col("near")), lambda x: x != F.col("post_id")), 1, k).alias("related"))


def reactions_in_order(reactions: DataFrame, by: str, date: Column, order: list) -> DataFrame:
    """``reactions`` with place: the newest first in each ``by``, rows without a valid date last, then ``order``."""
    from pyspark.sql.window import Window as W

    return reactions.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last(date), *order)))


def resolved(relations: DataFrame, posts: DataFrame, k: int = 6) -> DataFrame:
    """Related ids with their posts in order, missing ones dropped."""
    each = relations.select(F.col("post_id").alias("of"), F.posexplode("related").alias("pos", "id")).join(posts, "id")
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("of").orderBy("pos"))
    return each.withColumn("place", place).where(F.col("place") <= k).drop("pos")


def member_categories(posts: DataFrame, units: DataFrame) -> DataFrame:
    """Sorted union of category ids over each unit's members. posts: id, categoryIds."""
    each = units.select("unit_id", F.explode("post_ids").alias("id")).join(posts.select("id", "categoryIds"), "id", "left")
    return each.groupBy("unit_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("categoryIds", F.array().cast("array<string>")))))).alias("category_ids"))


def post_points(posts: DataFrame, points: DataFrame) -> DataFrame:
    """Each post's map point, by the members of units. points: unit_id, post_ids, x, y."""
    return posts.join(points.select(F.explode("post_ids").alias("id"), "unit_id", "x", "y"), "id", "left")


def category_starts(points: DataFrame, category: str, pos: str) -> DataFrame:
    """Per category the first point with an image, else the first."""
    best = points.groupBy(category).agg(F.min_by("id", F.struct((F.col("imageCount") <= 0).alias("bare"), F.col(pos))).alias("start"))
    return best


def topic_name(manual: Column, generated: Column, keywords: Column, fallback: Column) -> Column:
    """Manual label, else the generated one, else up to three keywords, else the id."""
    words = F.nullif(F.array_join(F.slice(keywords, 1, 3), ", "), F.lit(""))
    return F.coalesce(F.nullif(F.trim(manual), F.lit("")), X.title_case_list(F.nullif(F.trim(generated), F.lit(""))), words, fallback)


def topic_terms(keywords: Column, label_terms: Column) -> Column:
    """Keywords that the label doesn't say already."""
    return F.array_except(keywords, label_terms)


def topic_search_text(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def topics_in_order(topics: DataFrame, rest: str = "topic-overig") -> DataFrame:
    return topics.orderBy(F.col("id") == rest, F.desc("postCount"), "id")


def embedding_text(title: Column, parts: Column, captions: Column, part_chars: int = 3500, caption_chars: int = 180) -> Column:
    """Title, parts and captions, each cut, one per line."""
    cut = lambda a, n: F.filter(F.transform(a, lambda x: F.substring(X.squeeze(x), 1, n)), lambda x: x != "")
    return F.array_join(F.concat(F.array(title), cut(parts, part_chars), cut(captions, caption_chars)), "\n")


def visual_sentence(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.concat(F.lit("Op de beelden: "), F.array_join(terms, ", "), F.lit("."))).otherwise(F.lit(""))


def body_sample(title: Column, excerpt: Column, body: Column, limit: int) -> Column:
    return F.concat_ws("\n", title, F.nullif(excerpt, F.lit("")), F.substring(body, 1, limit))


def front_matter_text(fields: dict[str, Column], body: Column) -> Column:
    """Markdown with a header; values are written as JSON scalars, nulls are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', "$1"))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), body)


def post_files(posts: DataFrame, order: list) -> DataFrame:
    """name, value: Markdown files of posts, numbered by date (undated last), then ``order``; names from their titles."""
    placed = global_rank(posts, F.to_timestamp("isoDate"), order, "place_") if "isoDate" in posts.columns else global_rank(posts, F.lit(0), order, "place_")
    number = (F.col("place_") + 1).cast("string")
    number = F.when(F.char_length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    name = F.concat(number, F.lit("-"), F.coalesce(F.nullif(X.slug(F.col("title")), F.lit("")), F.lit("zonder-titel")), F.lit(".md"))
    return placed.select(name.alias("name"), front_matter_text({"title": F.col("title"), "id": F.col("id"), "date": F.col("isoDate")}, F.col("cleanedText")).alias("value"))


def dataset_rows(raw: DataFrame, kind: str) -> DataFrame:
    """Rows of a JSON document (value): an array's elements, an object's entries, or a keyed object's rows."""
    if kind == "array":
        return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "row"))
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "row"))


def dataset_columns(rows: DataFrame, preferred: list[str]) -> list[str]:
    """Columns of JSON rows: preferred ones that occur, then the others by name."""
    found = {r[0] for r in rows.select(F.explode(F.map_keys(F.from_json("row", "map<string,string>"))).alias("c")).distinct().collect()}
    return [c for c in preferred if c in found] + sorted(found - set(preferred))


def natural_key(value: Column) -> Column:
    """Sort key in which digits count as numbers."""
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.ltrim(p, F.lit("0")), 20, "0")).otherwise(p)), "")


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Named datasets as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def labels_from_yaml(text: str) -> dict[str, str]:
    """`key: label` lines of a small override file; quotes and comments are understood, nesting is not."""
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip() and not line.lstrip().startswith("#"):
            value = value.split(" #")[0].strip()
            out[key.strip().strip("\"'")] = value.strip("\"'")
    return {k: v for k, v in out.items() if v}


def overridden(rows: DataFrame, key: str, column: str, values: dict[str, str]) -> DataFrame:
    """Rows with a column overridden by a stated map."""
    if not values:
        return rows
    swap = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return rows.withColumn(column, F.coalesce(F.try_element_at(swap, F.col(key)), F.col(column)))


def post_by_slug(posts: DataFrame, slug: str) -> DataFrame:
    """The post of a slug, the first by id if several have it; no row without one."""
    return posts.where(F.col("slug") == slug).orderBy("id").limit(1)


def posts_with_images(posts: DataFrame, limit: int, pos: str) -> DataFrame:
    """The first ``limit`` posts that have an image."""
    return posts.where(F.size("images") > 0).orderBy(pos).limit(limit)


def questions(vocabulary: DataFrame, record: Column | None = None) -> DataFrame:
    """tag_id, instructions: what a scorer is asked for each tag (id, question, definition); ``record``: which record alone."""
    asked = F.concat_ws(" ", "question", "definition")
    if record is not None:
        asked = F.concat(F.lit('For the record with id "'), record, F.lit('", and only that record: '), asked)
    return vocabulary.select(F.col("id").alias("tag_id"), asked.alias("instructions"))


def question_digest(vocabulary: DataFrame) -> DataFrame:
    """One row, digest: of the questions by tag, whatever their order, thresholds and labels. A vocabulary is a stated list."""
    each = questions(vocabulary).select(F.struct("tag_id", F.to_json(F.struct("instructions", F.lit("noul").alias("type"))).alias("json")).alias("q"))
    listed = F.transform(F.array_sort(F.collect_list("q")), lambda q: F.concat(F.to_json(F.array(q["tag_id"])), q["json"]))
    return each.agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def batch_payloads(units: DataFrame, vocabulary: DataFrame, batch: str, pos: str, state: str, model: str) -> DataFrame:
    """batch, payload: one JSON request per batch with its records r0, r1.. in order, and every question about each of them.

    A batch is bounded by its plan (:func:`stratalog.operators.scoring.greedy_batches`); ``state`` is a struct column.
    """
    place = F.row_number().over(Window.partitionBy(batch).orderBy(pos)) - 1
    named = units.select(batch, pos, F.concat(F.lit("r"), place.cast("string")).alias("id"), F.col(state).alias("state"))
    records = named.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "id", F.to_json("state").alias("json")))), lambda r: F.concat(F.lit('{"id":"'), r["id"], F.lit('"'), F.when(r["json"] != "{}", F.concat(F.lit(","), F.substr(r["json"], F.lit(2)))).otherwise(F.lit("}")))).alias("records"))
    asked = vocabulary.select(F.concat_ws(" ", "question", "definition").alias("asked"), F.col("id").alias("tag_id"))
    listed = asked.agg(F.array_sort(F.collect_list(F.struct("tag_id", "asked"))).alias("tags"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    question = lambda i, t: F.concat(quoted(F.concat(F.lit("r"), i.cast("string"), F.lit("__"), t["tag_id"])), F.lit(':{"instructions":'), quoted(F.concat(F.lit('For the record with id "r'), i.cast("string"), F.lit('", and only that record: '), t["asked"])), F.lit(',"type":"noul"}'))
    # one row, the stated vocabulary
    both = records.crossJoin(F.broadcast(listed))
    asks = F.flatten(F.transform(F.sequence(F.lit(0), F.size("records") - 1), lambda i: F.transform("tags", lambda t: question(i, t))))
    return both.select(batch, F.concat(F.lit('{"model":'), quoted(F.lit(model)), F.lit(',"questions":{'), F.array_join(asks, ","), F.lit('},"state":{"records":['), F.array_join("records", ","), F.lit("]}}")).alias("payload"))


def batch_key(batch: DataFrame, by: str, pos: str, key: str, content: str, model: str, version: str) -> DataFrame:
    """by, batch_key: digest of model, prompt version, and the ids and content digests of each batch in order."""
    each = batch.select(by, pos, F.array(F.col(key).cast("string"), F.sha2(F.col(content).cast("binary"), 256)).alias("image"))
    listed = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "image"))), lambda x: x["image"]).alias("images"))
    return listed.select(by, F.sha2(F.to_json(F.struct("images", F.lit(model).alias("model"), F.lit(version).alias("version"))), 256).alias("batch_key"))


def suggestions(topics: DataFrame) -> DataFrame:
    """value: the lines of a reviewable override file of suggested labels (topicId, label, confidence, reason), by topic."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"^\[|\]$", "")
    lines = F.concat_ws("\n", F.concat(F.lit("  "), quoted("topicId"), F.lit(":")), *[F.concat(F.lit(f"    {c}: "), quoted(c)) for c in ("label", "confidence", "reason")])
    return topics.orderBy("topicId").select(lines.alias("value"))


def contact_cards(images: DataFrame, asset_base: str) -> DataFrame:
    """id, value: an HTML card for the review of each image (id, src, description, tags, linkedText)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    thumb = F.concat(F.lit(asset_base.rstrip("/")), F.regexp_replace(F.replace("src", F.lit("/archive-images/"), F.lit("/archive-thumbs/")), r"\.[^./]*$", ".webp"))
    text = lambda c, none: safe(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none)))
    card = F.concat(F.lit('<article><img src="'), safe(thumb), F.lit('" loading="lazy" alt=""><b>'), safe(F.col("id").cast("string")), F.lit("</b><p>"), text("description", "Nog geen beeldbeschrijving"), F.lit("</p><small>"), safe(F.array_join("tags", ", ")), F.lit("</small><aside>"), text("linkedText", "Geen tekst direct aan dit beeld gekoppeld"), F.lit("</aside></article>"))
    return images.select("id", card.alias("value"))
