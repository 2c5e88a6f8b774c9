"""Gallery and atlas filters over image and point tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.functions.scalars import clamp
from stratalog.operators.cluster import representatives
from stratalog.operators.ranking import global_rank
from stratalog.operators.sizes import small
from stratalog.plans.query_specs import ArchiveQuery, AtlasQuery, GalleryQuery

# Tags that show people or plants.
PEOPLE_OR_PLANTS = ("mensen", "familie", "tuin", "tuinwerk", "fruit", "bloemen", "dieren", "landschap", "teelt", "planten", "natuur")
FINE_PLANTS = ("fruit", "appels", "peren", "ander_fruit", "groenten", "bloemen", "bomen", "tuinplanten", "tuinwerk", "plantschade")
COARSE_PLANTS = ("tuin", "tuinwerk", "fruit", "bloemen", "planten", "teelt")


#: Ranks of a run in which neighbours are looked for.
_RUN = 100_000


def _overlap(tags: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(v) for v in values])), F.lit(False))


def shows_people(fine: Column, coarse: Column) -> Column:
    """Fine tags decide where there are any, else coarse ones."""
    return F.when(fine.isNotNull(), F.array_contains(fine, "mensen")).otherwise(_overlap(coarse, ("mensen", "familie")))


def shows_plants(fine: Column, coarse: Column) -> Column:
    return F.when(fine.isNotNull(), _overlap(fine, FINE_PLANTS)).otherwise(_overlap(coarse, COARSE_PLANTS))


def searched(query: str, *fields: Column) -> Column:
    """Substring search over fields joined by spaces, case aside; everything matches a blank query."""
    q = query.strip().lower()
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(q)) if q else F.lit(True)


def filter_images(images: DataFrame, spec: GalleryQuery, species: DataFrame | None = None) -> DataFrame:
    """Images that meet a gallery query. species: image_id, candidate_id, label (joined only where the query needs it)."""
    keep = []
    if spec.year:
        keep.append(F.col("year").cast("string") == spec.year)
    if spec.season != "all":
        keep.append(F.col("season") == spec.season)
    if spec.theme != "all":
        keep.append(F.array_contains("visualTags", spec.theme))
    if spec.people_plants:
        keep.append(_overlap(F.col("visualTags"), PEOPLE_OR_PLANTS))
    labels = F.lit(None).cast("string")
    if species is not None and (spec.species != "all" or len(spec.query.strip()) >= 3):
        named = species.groupBy(F.col("image_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("label")), " ").alias("labels_"), F.collect_set("candidate_id").alias("candidates_"))
        images = images.join(named, "id", "left")
        labels = F.col("labels_")
        if spec.species != "all":
            keep.append(F.coalesce(F.array_contains("candidates_", spec.species), F.lit(False)))
    fields = ["postTitle", "seriesTitle", "caption", "visualDescription", "imageSpecificText", "excerpt", "visualTags", "imageTagIds"]
    if spec.query.strip():
        keep.append(searched(spec.query, *[F.col(f) for f in fields if f in images.columns], labels))
    out = images.where(reduce(and_, keep)) if keep else images
    return out.drop("labels_", "candidates_")


def visible_themes(filtered: DataFrame, themes: DataFrame) -> DataFrame:
    counts = filtered.select(F.explode("visualTags").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return small(themes).join(counts, "id").orderBy(F.desc("n"), "id")


def viewer_neighbours(filtered: DataFrame, primary: Column, order: list, key: str = "id", descending: bool = True) -> DataFrame:
    """Each image's previous and next one by a numeric or time ``primary`` (nulls last), then ``order``.

    Ranks are gapless and counted per range; the neighbours are looked for in runs of ``_RUN`` ranks, whose
    ends are given to the runs on both sides.
    """
    placed = global_rank(filtered, primary, order, "place_", descending).select(F.col(key), "place_")
    run = F.floor(F.col("place_") / _RUN)
    ends = F.array_compact(F.array(run, F.when(F.col("place_") % _RUN == 0, run - 1), F.when(F.col("place_") % _RUN == _RUN - 1, run + 1)))
    w = W.partitionBy("run_").orderBy("place_")
    seen = placed.select("*", run.alias("own_"), F.explode(ends).alias("run_"))
    seen = seen.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))
    return seen.where("run_ = own_").select(key, "previous", "next")


def related(images: DataFrame, direct: DataFrame, viewer, k: int = 10) -> DataFrame:
    """Direct relations in their order, then images of the same cluster, without repeats. direct: id, pos; images: id, pos, visualClusterId."""
    own = images.where(F.col("id") == viewer).select(F.col("visualClusterId").alias("own_"))
    first = direct.join(images.select("id"), "id").select("id", F.lit(0).alias("rank_"), "pos")
    second = images.join(F.broadcast(own), F.col("visualClusterId") == F.col("own_")).select("id", F.lit(1).alias("rank_"), "pos")
    both = first.union(second).where(F.col("id") != viewer).groupBy("id").agg(F.min(F.struct("rank_", "pos")).alias("at"))
    return both.orderBy("at.rank_", "at.pos", "id").limit(k).select("id")


def filter_points(points: DataFrame, spec: AtlasQuery) -> DataFrame:
    """Atlas points that meet a query; a point without category ids counts by its topic."""
    keep = []
    if spec.category:
        keep.append(F.array_contains(F.coalesce("categoryIds", F.array("topicId")), spec.category))
    if spec.year:
        keep.append(F.col("year").cast("string") == spec.year)
    if spec.season != "all":
        keep.append(F.col("season") == spec.season)
    if spec.images:
        keep.append(F.col("imageCount") > 0)
    if spec.query.strip():
        keep.append(searched(spec.query, F.col("title"), F.col("excerpt")))
    return points.where(reduce(and_, keep)) if keep else points


def filter_posts(posts: DataFrame, spec: ArchiveQuery) -> DataFrame:
    return posts.where(F.array_contains("topicIds", spec.category)) if spec.category else posts


def with_cells(points: DataFrame, size: int = 32) -> DataFrame:
    """Grid cells of points in the unit square, edges clamped."""
    cell = lambda c: clamp(F.floor(F.col(c) * size), 0, size - 1).cast("int")
    return points.withColumn("cx", cell("x")).withColumn("cy", cell("y"))


def viewport(points: DataFrame, x0: float, x1: float, y0: float, y1: float, size: int = 32) -> DataFrame:
    """Points in a viewport, by cell ranges, then exactly; a viewport of the whole unit square has all points."""
    if x0 <= 0 and y0 <= 0 and x1 >= 1 and y1 >= 1:
        return points
    low, high = (lambda v: max(0, min(size - 1, int(v * size)))), (lambda v: max(0, min(size - 1, int(v * size))))
    cells = with_cells(points, size).where(F.col("cx").between(low(x0), high(x1)) & F.col("cy").between(low(y0), high(y1)))
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).drop("cx", "cy")


def viewport_bounds(width: float, height: float, scale: float, pan_x: float, pan_y: float, overscan: float = 0.0) -> tuple[float, float, float, float]:
    """x0, x1, y0, y1 of what a panned and scaled view shows."""
    x0, y0 = (-pan_x - overscan) / (width * scale), (-pan_y - overscan) / (height * scale)
    return x0, x0 + (width + 2 * overscan) / (width * scale), y0, y0 + (height + 2 * overscan) / (height * scale)


def bounds(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def density(points: DataFrame, by: list[str], nx: int = 34, ny: int = 24) -> DataFrame:
    """Counts and centroids per cell."""
    cell = lambda c, n: F.least(F.greatest(F.floor(F.col(c) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return points.groupBy(*by, cell("x", nx).alias("cx"), cell("y", ny).alias("cy")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"))


def kernel_density(points: DataFrame, nx: int = 56, ny: int = 36, radius: float = 2.25) -> DataFrame:
    """Each point adds 1 / (1 + 1.35 d) to the cells within ``radius`` of its own."""
    cell = lambda c, n: F.least(F.greatest(F.floor(F.col(c) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    counts = points.groupBy(cell("x", nx).alias("cx"), cell("y", ny).alias("cy")).agg(F.count("*").alias("n"))
    reach = int(radius)
    near = [(dx, dy, (dx * dx + dy * dy) ** 0.5) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx * dx + dy * dy <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 / (1 + 1.35 * d)).alias("w")) for dx, dy, d in near])
    spread = counts.select("cx", "cy", "n", F.explode(offsets).alias("o")).select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), (F.col("n") * F.col("o.w")).alias("v"))
    return spread.where(F.col("cx").between(0, nx - 1) & F.col("cy").between(0, ny - 1)).groupBy("cx", "cy").agg(F.round(F.sum("v"), 6).alias("density"))


def nearest_points(points: DataFrame, x: float, y: float, k: int = 10, key: str = "id", radius: float | None = None) -> DataFrame:
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    out = points.withColumn("d2", F.round(d, 9))
    if radius is not None:
        out = out.where(F.col("d2") < radius * radius)
    return out.orderBy("d2", key).limit(k)


def visible_edges(points: DataFrame, visible: DataFrame, key: str = "id") -> DataFrame:
    """Neighbour edges with both ends visible."""
    edges = points.select(F.col(key).alias("a"), F.explode("neighbors").alias("b"))
    ids = visible.select(key)
    return edges.join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")


def cluster_summary(points: DataFrame, by: str, pos: str) -> DataFrame:
    """Per cluster: years, points with images, the commonest season (the first seen on a tie) and the first point."""
    seasons = points.groupBy(by, "season").agg(F.count("*").alias("c"), F.min(pos).alias("p"))
    mode = seasons.groupBy(by).agg(F.max_by("season", F.struct("c", (-F.col("p")).alias("m"))).alias("season"))
    stats = points.groupBy(by).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.expr("imageCount > 0")).alias("with_images"), F.min_by("id", pos).alias("representative"))
    return stats.join(mode, by)


def cluster_payload(images: DataFrame, by: str, key: str, vector: str, tags: str, post: str, k: int = 8, most: int = 4) -> DataFrame:
    """id, sourceLabel, imageCount, postCount, generatedLabel, representativeImageIds of each cluster, numbered by size.

    The label names the ``most`` commonest tags (by name on a tie), the representatives are the ``k``
    images nearest to the centroid. Clusters of one size are numbered by label.
    """
    rows = images.select(by, key, vector, tags, post)
    sizes = rows.groupBy(by).agg(F.count("*").alias("imageCount"), F.count_distinct(post).alias("postCount"))
    rank = F.row_number().over(W.orderBy(F.desc("imageCount"), by))  # a row for each cluster
    number = F.lpad(rank.cast("string"), 2, "0")
    named = sizes.withColumn("id", F.concat(F.lit("image-cluster-"), F.when(rank < 100, number).otherwise(rank.cast("string"))))
    counts = rows.select(by, F.explode(tags).alias("tag")).groupBy(by, "tag").agg(F.count("*").alias("c"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("c"), "tag"))
    top = counts.withColumn("r", place).where(F.col("r") <= most).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ", ").alias("label_"))
    near = representatives(rows, by, key, vector, k).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("representativeImageIds"))
    out = named.join(top, by, "left").join(near, by, "left")
    return out.select("id", F.col(by).alias("sourceLabel"), "imageCount", "postCount", F.coalesce("label_", F.lit("beelden")).alias("generatedLabel"), "representativeImageIds")


def shuffled(rows: DataFrame, key: str, seed: int, first=None) -> DataFrame:
    """key, place: an order that the seed decides, with ``first`` (if it is there) in front."""
    front = F.when(F.col(key) == F.lit(first), -1.0) if first is not None else F.lit(None).cast("double")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double")
    return global_rank(rows.select(key), F.coalesce(front, drawn), [key], "place")


def random_row(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, drawn by the seed; every row is as likely as any other. Empty without rows."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)


def suppress_peaks(peaks: DataFrame, by: str, distance: float, most: int) -> DataFrame:
    """Greedy non-maximum suppression per key: strongest peaks (n, x, y) first, none nearer than ``distance`` to one kept."""

    def keep(pdf):
        chosen = []
        for row in pdf.sort_values(["n", "x", "y"], ascending=[False, True, True]).itertuples():
            if len(chosen) < most and all((row.x - c.x) ** 2 + (row.y - c.y) ** 2 >= distance * distance for c in chosen):
                chosen.append(row)
        return pdf.loc[[c.Index for c in chosen]]

    return peaks.groupBy(by).applyInPandas(keep, peaks.schema)
