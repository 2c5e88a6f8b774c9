"""The corpus pipeline: documents through language ID, line dedup, near dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the
last return the columns of documents; n_chars is the length of the text as the stage leaves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize
from stratalog.llm.decontam import find_leaks
from stratalog.llm.langid import identify, train_on
from stratalog.llm.linededup import drop_common_lines
from stratalog.llm.neardup import SENT_ROWS, near_duplicates
from stratalog.llm.packing import pack
from stratalog.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("doc_id", "lang", "source", "n_chars")
#: A document goes if less than this share of its letters is in its main language.
MIN_LANGUAGE_SHARE = 0.2


#: Rows of an Arrow batch at most; documents are long, and executors hold batches besides their heap.
BATCH_ROWS = 2_000


def _prepared(spark: SparkSession) -> None:
    """Sources on the executors, and Arrow batches of the session of at most ``BATCH_ROWS`` rows."""
    ship(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those without a main language."""
    _prepared(spark)
    found = identify(docs, train_on(docs), carry=CARRIED, with_spans=False)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least 10 documents have; every document stays."""
    _prepared(spark)
    kept = drop_common_lines(docs, min_docs=10, min_chars=1, carry=("doc_id", "lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five-word shingles, similarity 0.8): the one with the least doc_id.

    It is decided for each row: a row without a doc_id, or with one that other rows have too, is known
    by its id and text, and stands behind rows with an id of their own. Of rows alike one stays.
    """
    _prepared(spark)
    keyed = _with_row_key(docs)
    marks = materialize(near_duplicates(keyed.select(F.col("key_").alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias("key_"), "kept"), "marks")
    gone = materialize(marks.where("not kept").select("key_").distinct(), "gone")
    # keys of copies only, and sent only while they are few
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    out = keyed.join(gone, "key_", "left_anti")
    again = materialize(marks.where("kept").groupBy("key_").count().where("count > 1").select("key_"), "again")
    if not again.isEmpty():
        out = out.join(again, "key_", "left_anti").unionByName(out.join(again, "key_", "left_semi").dropDuplicates(["key_"]))
    return out.select(*COLUMNS)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with key_: doc_id where one row has it, else 2**62 and more, by id and text."""
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    often = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("often_")), "often")
    if often.isEmpty():
        return docs.withColumn("key_", F.coalesce("doc_id", own))
    often = F.broadcast(often) if often.count() <= SENT_ROWS else often
    return docs.join(often, "doc_id", "left").withColumn("key_", F.when(F.col("often_"), own).otherwise(F.coalesce("doc_id", own)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    _prepared(spark)
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=CARRIED)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 4096 token ids; one row per piece, with its ids."""
    _prepared(spark)
    # the executors' memory is well used by the stages before
    return pack(docs, slice_bytes=2 << 20, words=400_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL expresses a trained language model, sketches or alignments; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out = materialize(out, name)
        discard(docs)
        docs = out
    return docs
