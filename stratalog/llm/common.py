"""Shared helpers: the cluster's shared folder, written tables, input columns."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import ship

#: White space of the text contracts (regex class body, and the characters themselves).
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, set only where it is unset.

    Unset, it becomes a folder of the warehouse, which executors reach; with a master ``local[n]``,
    where driver and executors are one process, a temporary folder.
    """
    with contextlib.suppress(Exception):
        if found := spark.conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        own = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stratalog-shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stratalog/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_stratalog_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
