"""Sharding by balanced label propagation under exact row quotas.

Documents of equal text are linked. Shard labels start from a hash of doc_id. In each round a group's
rows move towards the shard that most of its rows have and that has room for it; per target shard,
classes of moves (large groups first, then by hash) are admitted while their rows fit the quota
that those who want to stay leave. A group that is larger than a shard is dealt by hash into parts that fit,
so that it fills whole shards. The last step settles the law `rows`: what is over a quota, and all
documents without links, fill the free places by gapless rank, so that counts differ by one at most.

What rounds shuffle is one row per group part, first shard and shard, never the documents; loads,
quotas and admission tables have a fixed number of rows. Ranks are counted per shard and bucket:
``GROUP_BUCKETS`` ranges of group hashes by ``ROW_BUCKETS`` of row hashes, so that no task sorts a whole
shard or the whole of a large group. Row hashes hold the row's place in the input, so that rows
alike (null ids, repeated rows) do not meet in one bucket either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalog.llm.common import discard, documents, materialize
from stratalog.session import ship

SHARDS, ROUNDS = 40, 8
GROUP_BUCKETS, ROW_BUCKETS = 64, 128
#: Share of a shard that a part of a group may take.
PART_OF_SHARD = 0.8


def _picked(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("c")).collect()}
    return [int(got.get(j, 0)) for j in range(shards)]


def _bucket(group: Column) -> Column:
    """Buckets keep the rows of a group together, and part them by the hash of the row."""
    return F.pmod(F.shiftrightunsigned(group, 32), F.lit(GROUP_BUCKETS)) * ROW_BUCKETS + F.pmod(F.col("salt"), F.lit(ROW_BUCKETS))


def _ranked(rows: DataFrame, by: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """``name``: each row's gapless rank from 0 within ``by``, ordered by bucket, then ``order``."""
    rows = rows.withColumn("b_", bucket)
    counts = rows.groupBy(*by, "b_").agg(F.count("*").alias("c_"))
    upto = W.partitionBy(*by).orderBy("b_").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*by, "b_", F.coalesce(F.sum("c_").over(upto), F.lit(0)).alias("before_"))
    place = F.row_number().over(W.partitionBy(*by, "b_").orderBy(*order)) - 1
    # at most GROUP_BUCKETS * ROW_BUCKETS rows for each shard
    return rows.withColumn("place_", place).join(F.broadcast(before), [*by, "b_"]).withColumn(name, F.col("before_") + F.col("place_")).drop("b_", "place_", "before_")


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move rows of ``state`` (gid, first, shard, c) towards their groups' shards; the same columns, other shards."""
    shards = len(quotas)
    for k in range(rounds):
        loads = _loads(state, shards)
        per_shard = state.groupBy("gid", "shard").agg(F.sum("c").alias("c"))
        totals = per_shard.groupBy("gid").agg(F.sum("c").alias("n"), F.count("*").alias("spread")).where("spread > 1")
        room = _picked(quotas, F.col("shard")) - _picked(loads, F.col("shard"))
        fits = (room >= F.col("n") - F.col("c")).cast("int")
        wish = per_shard.join(totals, "gid").groupBy("gid").agg(F.max_by(F.struct("shard", "c"), F.struct(fits, "c", F.xxhash64("gid", "shard", F.lit(k)))).alias("to"), F.max("n").alias("n"))
        wish = wish.select("gid", F.col("to.shard").alias("target"), "n", (F.col("n") - F.col("to.c")).alias("moves"))
        moving = materialize(state.join(wish, "gid").select("gid", "shard", "c", "target", "n", "moves"), "moving")
        leaving = {r[0]: r[1] for r in moving.where("shard <> target").groupBy("shard").agg(F.sum("c")).collect()}
        if not leaving:
            break
        free = [quotas[j] - loads[j] + int(leaving.get(j, 0)) for j in range(shards)]
        # classes of moves: by size, then by hash; a table of fixed size
        rank = (64 - F.floor(F.log2(F.col("n").cast("double")))).cast("int") * 256 + F.pmod(F.xxhash64("gid", F.lit(k)), F.lit(256)).cast("int")
        wishes = moving.select("gid", "target", "moves", rank.alias("rank")).distinct()
        classes = wishes.groupBy("target", "rank").agg(F.sum("moves").alias("m"))
        admitted = classes.withColumn("cum", F.sum("m").over(W.partitionBy("target").orderBy("rank"))).where(F.col("cum") <= _picked(free, F.col("target")))
        go = wishes.join(admitted.select("target", "rank"), ["target", "rank"]).select("gid", "target")
        new = materialize(state.join(go, "gid", "left").select("gid", "first", F.coalesce("target", "shard").alias("shard"), "c"), "labels")
        discard(state)
        discard(moving)
        state = new
    return state


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    size is the text's UTF-8 bytes plus 16; null texts count as empty, and are equal to them. Law
    `rows`: shards' row counts differ by one at most; slot is gapless from 0 in each shard;
    grown_shard is null. Repeated rows and null ids are rows like others; of rows alike in id and text
    their place in the input decides. Other columns are not read. Empty input: empty result.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text, F.octet_length(text)).alias("k2"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt"))
    base = materialize(base, "rows")
    total = base.count()
    quotas = [total // shards + (j < total % shards) for j in range(shards)]
    part = max(1, int(PART_OF_SHARD * (total // shards)))
    groups = base.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / part))
    # a null id says nothing about its row
    own = F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(F.xxhash64("doc_id"))
    first = F.pmod(F.xxhash64(own, F.lit("shard")), F.lit(shards)).cast("int")
    gid = F.xxhash64("k1", "k2", F.pmod(own, F.col("parts")))
    rows = base.join(groups, ["k1", "k2"], "left").select("doc_id", "size", "text_crc32", "salt", first.alias("first"), F.when(F.col("parts").isNotNull(), gid).alias("gid"))
    rows = materialize(rows, "linked")
    state = materialize(rows.where("gid is not null").groupBy("gid", "first").agg(F.count("*").alias("c")).withColumn("shard", F.col("first")).select("gid", "first", "shard", "c"), "labels")
    state = propagate(state, quotas)

    linked = rows.where("gid is not null").join(state.select("gid", "first", "shard"), ["gid", "first"])
    linked = _ranked(linked, ["shard"], _bucket(F.col("gid")), ["gid", "doc_id", "text_crc32"], "place")
    linked = materialize(linked, "placed")
    stays = F.col("place") < _picked(quotas, F.col("shard"))
    held = {r[0]: r[1] for r in linked.where(stays).groupBy("shard").count().collect()}
    columns = ["doc_id", "size", "text_crc32", "salt"]
    over = linked.where(~stays).select(*columns, "gid")
    pool = over.union(rows.where("gid is null").select(*columns, "gid")).withColumn("all_", F.lit(0))
    pool = _ranked(pool, ["all_"], _bucket(F.coalesce("gid", "salt")), ["gid", "doc_id", "text_crc32"], "place")
    ends, end = [], 0
    for j in range(shards):
        end += quotas[j] - int(held.get(j, 0))
        ends.append(end)
    fill = sum((F.when(F.col("place") >= e, 1).otherwise(0) for e in ends[1:]), F.when(F.col("place") >= ends[0], 1).otherwise(0))
    out = linked.where(stays).select(*columns, "shard").union(pool.withColumn("shard", fill).select(*columns, "shard"))
    out = _ranked(out, ["shard"], _bucket(F.col("salt")), ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
