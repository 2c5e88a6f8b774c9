"""Near duplicates: fast similarity sketches, banding, exact verification, components.

Sketch: for coordinate count t, round i < t throws every element of the set into one of t bins with
a fresh hash, round t + j throws every element into bin j; a bin keeps the smallest (round, hash)
that it got. Filling stops when every bin is full, after 2t rounds at the latest, so that each
coordinate is filled whatever the size of the set, and the share of equal coordinates of two sets
concentrates around their Jaccard similarity. The cost is about |set| + t log t hashes.

Banding: r coordinates make one key, pairs with ``SHARED`` common keys or more are checked. With
r = 8 and 110 bands a pair at similarity 0.8 has fewer with a chance of 4e-8, while one at 0.4 has
that many with a chance of 0.002: documents that merely share a passage are seldom compared.

Whole links without all pairs of a group: texts with one shingle set are one class. Each class is
checked against the least class of each of its buckets; verified links are contracted to
components. What can still be missing are links between classes of one bucket that are in different
components. This rest is exact: a bucket's largest component and the classes outside of it that meet
it in any bucket form a group, and the outside classes are checked against the whole group. Small
groups are joined pair by pair; of large ones, chunks of sets are laid against chunks, and a task
returns its links, at most one for each two components. No bucket is capped, and no pair inside one
component is made.

Tables of candidates are broadcast up to ``SENT_ROWS`` rows, which are counted before, and joined by
shuffle beyond, so that neither texts nor keys move while candidates are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import vectext as V
from stratalog.llm.common import discard, documents, materialize
from stratalog.llm.components import components
from stratalog.session import ship

ROWS_PER_BAND, BANDS = 8, 110
#: Pairs with fewer common keys are not checked: at similarity 0.8 that loses a pair with a chance of 4e-8.
SHARED = 2
#: Candidate tables of up to so many rows of a few numbers are broadcast.
SENT_ROWS = 1_000_000
#: Groups of so many pairs or more are checked in chunks of ``CHUNK`` sets.
LARGE, CHUNK = 10_000, 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 52) - 1)


def sketches(values: np.ndarray, lengths: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches (rows: sets) of concatenated sets of distinct 64-bit hashes; no set may be empty."""
    n = len(lengths)
    assert t < 2048
    out = np.full((n, t), _FULL)
    flat = out.reshape(-1)
    begin = np.cumsum(lengths) - lengths
    active, first = np.arange(n), 0
    while len(active) and first < 2 * t:
        size = lengths[active]
        at = np.cumsum(size) - size
        where = np.arange(int(size.sum())) + np.repeat(begin[active] - at, size)
        base = np.repeat(active * t, size)
        elements = values[where]
        more = 1 if len(elements) > 20_000 else max(1, min(64, 20_000 // len(elements)))
        for i in range(first, min(first + more, 2 * t)):
            h = V.mix(elements ^ V.mix(np.array([i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], V.U64)))
            bins = ((h >> V.U64(32)) * V.U64(t) >> V.U64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, base + bins, (V.U64(i) << V.U64(52)) | (V.mix(h) & _LOW))
        first += more
        active = active[(out[active] == _FULL).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, t = sketch.shape
    bands = t // rows
    parts = sketch[:, : bands * rows].reshape(n, bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=V.U64) * V.U64(0xA24BAED4963EE407), (n, 1))
    for k in range(rows):
        key = V.mix(key ^ V.mix(parts[:, :, k] + V.U64(k)))
    return key


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block of rows: first row, concatenated sorted distinct shingle hashes, and each row's set size."""
    for b in V.blocks(column):
        n = len(b.starts)
        s = V.words(b)
        h = V.hash_spans(b, s)
        grams, at = V.ngrams(h, s.row, width)
        row = s.row[at]
        count = np.bincount(s.row, minlength=n)
        if (few := np.flatnonzero((count > 0) & (count < width))).size:
            first = np.cumsum(count) - count
            whole = np.array([V.mix(np.array([sum(int(x) * int(c) for x, c in zip(h[first[r] : first[r] + count[r]], V._COEF[2], strict=False)) + int(count[r]) & 0xFFFFFFFFFFFFFFFF], V.U64))[0] for r in few], V.U64)
            grams, row = np.concatenate([grams, whole]), np.concatenate([row, few])
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        grams, row = grams[keep], row[keep]
        yield b.first, grams, np.bincount(row, minlength=n)


def _digest(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (3, 5):
        total = np.zeros(len(lengths), V.U64)
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(V.mix(values * V.U64(2 * seed + 1) + V.U64(seed)), (np.cumsum(lengths) - lengths)[some])
        out.append(V.mix(total + lengths.astype(V.U64)).view(np.int64))
    return out[0], out[1]


def _sketched(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        for batch in batches:
            ids = batch.column(0)
            for first, values, lengths in shingle_sets(batch.column(1), width):
                n = len(lengths)
                s1, s2 = _digest(values, lengths)
                some = np.flatnonzero(lengths)
                keys = band_keys(sketches(values, lengths[some], rows * bands), rows) if len(some) else np.zeros((0, bands), V.U64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(lengths, pa.int64()), pa.array(s1), pa.array(s2), V.arrow_list(keys.reshape(-1).view(np.int64), np.where(lengths > 0, bands, 0), pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, lengths in shingle_sets(batch.column(1), width):
                s1, s2 = _digest(values, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), V.arrow_list(values.view(np.int64), lengths, pa.int64())], names=["s1", "s2", "grams"])

    return run


def _sent(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS_PER_BAND, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; other columns are not read).

    Words are maximal runs without white space, A-Z lower-cased; a row's set is its distinct shingles
    of ``words`` words, or the whole word sequence if there are fewer words. Rows are linked where
    100 * intersection >= ``percent`` * union. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept (doc_id = component_id).

    Null or wordless texts: n_shingles 0, linked with nothing, component_id = doc_id. Repeated rows:
    returned as often as given, all of one component. Null doc_id: belongs to its class's component,
    null where the class has no id; kept only then. One doc_id with different texts: its rows are one
    document, which has the links of all its texts. Empty input: empty result.
    """
    ship(docs.sparkSession)
    p = (percent / 100) ** rows
    assert sum(comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(SHARED)) < 1e-6, "too few bands for whole links"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "s1", "s2")] + [T.StructField("bands", T.ArrayType(T.LongType()))])
    table = materialize(source.mapInArrow(_sketched(words, rows, bands), schema), "sketches")

    # one node for each shingle set, and its least document; the number is unique, and fixed as it is written
    named = table.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"), F.min("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = materialize(keys.join(_sent(shared), "key").select("key", "node", "n", "least"), "members")
    written = members

    # whose sets are needed: those that share buckets enough, read once
    often = members.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") >= SHARED).select("node")
    wanted = materialize(classes.select("node", "n", "doc", "s1", "s2").join(often, "node"), "wanted")
    chosen = _sent(wanted)
    members = members.join(chosen.select("node"), "node", "left_semi")
    texts = source.join(chosen.select("doc"), F.col("doc_id") == F.col("doc"), "left_semi")
    sets = texts.mapInArrow(_sets(words), T.StructType([T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]))
    # a document's other texts may be of other classes
    grams = sets.groupBy("s1", "s2").agg(F.max("grams").alias("grams")).join(chosen.select("s1", "s2", "node"), ["s1", "s2"]).select("node", "grams")
    grams = materialize(grams, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        same = F.size(F.array_intersect("ga", "gb"))
        return pairs.join(left, "a").join(right, "b").where(100 * same >= percent * (F.size("ga") + F.size("gb") - same)).drop("ga", "gb")

    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    size_of = _sent(wanted).select(F.col("node").alias("b"), F.col("n").alias("nb"))
    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"), F.col("n").alias("na")).groupBy("a", "b", "na").agg(F.count("*").alias("k")).where("k > 1")
    links = materialize(verified(stars.join(size_of, "b").where(near).select("a", "b")).union(_texts_of_one(named, classes)), "links")
    roots = materialize(components(links), "roots")

    placed = materialize(wanted.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")), "placed")
    groups = materialize(_groups(members, placed), "groups")
    tested = verified(_small_pairs(groups, classes).where(near)).select("a", "b", "ra", "rb").union(_large_links(groups, grams, percent))
    more = components(materialize(tested.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links"))
    more = materialize(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "more")

    linked = roots.join(more, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    linked = linked.union(more.select(F.col("root").alias("node"), F.col("to").alias("root")).join(roots, "node", "left_anti"))
    named_root = linked.join(classes.select("node", "doc"), "node")
    least = named_root.groupBy("root").agg(F.min("doc").alias("least"))
    of = named_root.join(least, "root").select("node", "least")
    component = classes.select("s1", "s2", "node", "doc").join(of, "node", "left").select("s1", "s2", F.coalesce("least", "doc").alias("least"))
    component = materialize(component, "components")
    for done in (classes, shared, written, wanted, grams, placed, groups, links, roots, more):
        discard(done)
    out = table.select("doc_id", "n_shingles", "s1", "s2").join(component, ["s1", "s2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts_of_one(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each doc_id that has several."""
    parts = [f(c) for c in ("s1", "s2") for f in (lambda c: F.min(c).alias(f"least_{c}"), lambda c: F.max(c).alias(f"most_{c}"))]
    several = named.groupBy("doc_id").agg(*parts).where("least_s1 <> most_s1 or least_s2 <> most_s2").select("doc_id")
    several = materialize(several, "texts-of-one")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    nodes = named.join(_sent(several), "doc_id").select("doc_id", "s1", "s2").distinct().join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def _groups(members: DataFrame, placed: DataFrame) -> DataFrame:
    """group, node, n, root, outside, all: per largest component of any mixed bucket (``group``), its classes and those outside of it that meet it, with their numbers."""
    rows = members.select("key", "node").join(_sent(placed), "node")
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    major = materialize(sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("group"), F.count("*").alias("roots")).where("roots > 1"), "majors")
    major = _sent(major)
    outside = materialize(rows.join(major, (rows.key == major.key) & (F.col("root") != F.col("group"))).select("group", "node", "n", "root").distinct(), "outside")
    inside = placed.join(outside.select("group").distinct(), F.col("root") == F.col("group"), "left_semi").select(F.col("root").alias("group"), "node", "n", "root")
    held = outside.union(inside)
    counts = held.groupBy("group").agg(F.count_if(F.col("root") != F.col("group")).alias("outside"), F.count("*").alias("all"))
    return held.join(counts, "group")


def _small_pairs(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of small groups across components that share ``SHARED`` keys, each class outside with all others."""
    rows = groups.where(F.col("outside") * F.col("all") < LARGE).join(classes.select("node", "bands"), "node")
    minor = rows.where("root <> group").select("group", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("bands").alias("ka"))
    other = rows.select("group", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("bands").alias("kb"), (F.col("root") == F.col("group")).alias("top"))
    met = (minor.group == other.group) & (F.col("ra") != F.col("rb")) & (F.col("top") | (F.col("a") < F.col("b"))) & (F.size(F.array_intersect("ka", "kb")) >= SHARED)
    return minor.join(other, met).select("a", "b", "na", "nb", "ra", "rb").distinct()


def _large_links(groups: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, ra, rb) of large groups: chunks of the classes outside against chunks of all, one link at most for two components and chunks."""
    chunks = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    of = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), chunks(n)).cast("int")
    rows = groups.where(F.col("outside") * F.col("all") >= LARGE)
    left = rows.where("root <> group").select("group", "node", "root", F.lit(True).alias("asks"), of(F.col("outside"), 1).alias("i"), F.explode(F.sequence(F.lit(0), chunks(F.col("all")) - 1)).alias("j"))
    right = rows.select("group", "node", "root", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), chunks(F.col("outside")) - 1)).alias("i"), of(F.col("all"), 2).alias("j"))

    def check(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        side = [table.filter(pa.array(asks)), table.filter(pa.array(~asks))]
        (la, ra, lg, ln), (lb, rb, rg, rn) = ((t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("grams").combine_chunks().flatten().to_numpy(), np.diff(t.column("grams").combine_chunks().offsets.to_numpy())) if t.num_rows else (np.zeros(0, np.int64),) * 4 for t in side)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(la) and len(lb):
            owner = np.repeat(np.arange(len(la)), ln)
            order = np.argsort(lg, kind="stable")
            lg, owner = lg[order], owner[order]
            at = np.cumsum(rn) - rn
            lo, hi = np.searchsorted(lg, rg, "left"), np.searchsorted(lg, rg, "right")
            for k in range(len(lb)):
                a, n = lo[at[k] : at[k] + rn[k]], (hi - lo)[at[k] : at[k] + rn[k]]
                total = int(n.sum())
                if not total:
                    continue
                same = np.bincount(owner[np.arange(total) + np.repeat(a - (np.cumsum(n) - n), n)], minlength=len(la))
                for i in np.flatnonzero((100 * same >= percent * (ln + rn[k] - same)) & (ra != rb[k])):
                    found.setdefault((int(ra[i]), int(rb[k])), (int(la[i]), int(lb[k])))
        return pa.table([pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64())], names=["a", "b", "ra", "rb"])

    return left.union(right).join(grams, "node").groupBy("group", "i", "j").applyInArrow(check, "a long, b long, ra long, rb long")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)
