"""Line dedup: lines that many documents have are dropped from all of them.

Counting: each task hashes the line keys of its documents (128 bits), counts every key once per
document, and sends one row per key and batch to the sum. All distinct keys are dealt into shards by
hash; each shard becomes a minimal perfect hash over its keys (levels of bit arrays, a key that is
alone on its bit stays there, the rank of the bit is its index) with compact arrays of 32-bit
fingerprints and of counts. Documents probe these arrays; no line is joined to a line.

An index of at most ``block_bytes`` of measured size is broadcast, and probed in one pass over the
documents. A larger one stays where it is: the documents' hashes come to its shards, and the numbers
of the lines to drop go back to the texts, two passes over the documents whatever their number. A
shard with a very common line has more probes than others; its arrays are dealt out as many times as
its counted probes ask for, and the probes among the copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import vectext as V
from stratalog.llm.common import discard, documents, materialize
from stratalog.session import ship

SHARD_KEYS = 1 << 18
BLOCK_BYTES = 16 << 20
#: Probes of one copy of a shard; line numbers that are broadcast at most.
PROBES, SENT_MARKS = 1 << 20, 1_000_000


class LineIndex:
    """Minimal perfect hash of distinct (h1, h2) keys with fingerprint and count arrays."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.uint32) - bits)
            before += int(bits.sum())

    @staticmethod
    def _slot(h1: np.ndarray, level: int, size: int) -> np.ndarray:
        return (V.mix(h1 + V.U64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % V.U64(size)).astype(np.int64)

    @staticmethod
    def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return ((V.mix(h1 ^ (h2 << V.U64(1))) ^ h2) >> V.U64(32)).astype(np.uint32)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, gamma: float = 1.5) -> LineIndex:
        levels, rest, key = [], np.arange(len(h1)), V.mix(h1 + h2 * V.U64(3))
        order: list[np.ndarray] = []
        while len(rest):
            size = max(64, int(gamma * len(rest)))
            slot = cls._slot(key[rest], len(levels), size)
            alone = np.bincount(slot, minlength=size)[slot] == 1
            bits = np.zeros(size, bool)
            bits[slot[alone]] = True
            order.append(rest[alone][np.argsort(slot[alone])])
            levels.append(bits)
            rest = rest[~alone]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(levels, cls.fingerprint(h1, h2)[at], counts[at])

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's count, 0 for keys that are not in the index."""
        out = np.zeros(len(h1), np.int64)
        key, prints = V.mix(h1 + h2 * V.U64(3)), self.fingerprint(h1, h2)
        rest = np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            slot = self._slot(key[rest], level, len(bits))
            hit = bits[slot]
            at = self.ranks[level][slot[hit]]
            found = self.prints[at] == prints[rest[hit]]
            out[rest[hit][found]] = self.counts[at[found]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        counts = self.counts.astype(np.min_scalar_type(int(self.counts.max(initial=0))))
        head = np.array([len(self.levels), len(self.prints), counts.itemsize, *map(len, self.levels)], np.int64)
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), self.prints.tobytes(), counts.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> LineIndex:
        n, keys, width = map(int, np.frombuffer(raw, np.int64, 3))
        at, levels = 8 * (n + 3), []
        for size in map(int, np.frombuffer(raw, np.int64, n, 24)):
            step = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(levels, np.frombuffer(raw[at : at + 4 * keys], np.uint32), np.frombuffer(raw[at + 4 * keys :], f"u{width}"))


def _keys(b: V.Block, min_chars: int) -> tuple[V.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, both hashes of their keys, and whether the keys have ``min_chars`` code points."""
    whole, key = V.lines(b)
    size = key.end - key.start
    if min_chars > 1:
        points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
        size = points[key.end] - points[key.start]
    return whole, V.hash_spans(b, key, 1), V.hash_spans(b, key, 2), size >= min_chars


def _count(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(0)):
                whole, h1, h2, use = _keys(b, min_chars)
                row, h1, h2 = whole.row[use], h1[use], h2[use]
                order = np.lexsort((row, h2, h1))
                row, h1, h2 = row[order], h1[order], h2[order]
                new_key = np.ones(len(row), bool)
                new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                fresh = new_key.copy()
                fresh[1:] |= row[1:] != row[:-1]
                start = np.flatnonzero(new_key)
                n = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h1[start].view(np.int64)), pa.array(h2[start].view(np.int64)), pa.array(n)], names=["h1", "h2", "docs"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    index = LineIndex.build(pdf.h1.to_numpy(np.int64).view(V.U64), pdf.h2.to_numpy(np.int64).view(V.U64), pdf.docs.to_numpy(np.int64))
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "arrays": [index.to_bytes()], "probes": [int(pdf.docs.sum())]})


def _shard(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h1 >> V.U64(20)) % V.U64(n_shards)).astype(np.int64)


def _without(b: V.Block, text: pa.Array, whole: V.Spans, drop: np.ndarray) -> list[pa.Array]:
    """The rows' texts without the lines to drop, their lines, and their dropped lines."""
    n = len(b.starts)
    n_lines = np.bincount(whole.row, minlength=n)
    first = np.cumsum(n_lines) - n_lines
    kept = text.slice(b.first, n).cast(pa.string()).fill_null("")
    if drop.any():
        raw, new = b.data.tobytes(), kept.to_pylist()
        for r in np.unique(whole.row[drop]):
            lines = np.arange(first[r], first[r] + n_lines[r])
            new[r] = b"\n".join(raw[whole.start[i] : whole.end[i]] for i in lines[~drop[lines]]).decode()
        kept = pa.array(new, pa.string())
    return [kept, pa.array(n_lines.astype(np.int64)), pa.array(np.bincount(whole.row[drop], minlength=n).astype(np.int64))]


_loaded = V.kept()


def _probe(shards, n_shards: int, min_docs: int, min_chars: int, carried: int):
    """Columns in: carried ones, text. Out: carried ones, text, n_lines, n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release(_loaded)
        if _loaded.get("of") != shards.value["token"]:
            _loaded.clear()
            _loaded.update(of=shards.value["token"], index={k: LineIndex.from_bytes(v) for k, v in shards.value["arrays"].items()})
        index = _loaded["index"]
        for batch in batches:
            text = batch.column(carried)
            for b in V.blocks(text):
                whole, h1, h2, use = _keys(b, min_chars)
                drop = np.zeros(len(h1), bool)
                shard = _shard(h1, n_shards)
                for k, arrays in index.items():
                    at = np.flatnonzero(use & (shard == k))
                    drop[at] = arrays.lookup(h1[at], h2[at]) >= min_docs
                columns = [batch.column(k).slice(b.first, len(b.starts)) for k in range(carried)] + _without(b, text, whole, drop)
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


_PROBE = "shard long, copy int, h1 long, h2 long, k1 long, k2 long, line int"


def _probes(n_shards: int, copies: dict[int, int], min_chars: int):
    """Columns in: both hashes of the text, the text. Out: one row for each line."""
    of = np.array(sorted(copies), np.int64)
    times = np.array([copies[k] for k in sorted(copies)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            for b in V.blocks(batch.column(2)):
                whole, h1, h2, use = _keys(b, min_chars)
                n_lines = np.bincount(whole.row, minlength=len(b.starts))
                line = np.arange(len(h1)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                row, line, h1, h2 = b.first + whole.row[use], line[use], h1[use], h2[use]
                shard, copy = _shard(h1, n_shards), np.zeros(len(h1), np.int64)
                if len(of):
                    at = np.minimum(np.searchsorted(of, shard), len(of) - 1)
                    deal = V.mix(k1[row].view(V.U64) + line.astype(V.U64)) % times[at].astype(V.U64)
                    copy = np.where(of[at] == shard, deal.astype(np.int64), 0)
                columns = [pa.array(shard), pa.array(copy.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array(line.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PROBE.split(", ")])

    return run


def _answer(min_docs: int):
    def run(probes: pa.Table, shard: pa.Table) -> pa.Table:
        h1, h2 = (probes.column(c).to_numpy().view(V.U64) for c in ("h1", "h2"))
        gone = np.zeros(len(h1), bool)
        if len(h1) and shard.num_rows:
            gone = LineIndex.from_bytes(shard.column("arrays")[0].as_py()).lookup(h1, h2) >= min_docs
        return probes.select(["k1", "k2", "line"]).filter(pa.array(gone))

    return run


def _drop(carried: int):
    """Columns in: carried ones, text, numbers of the lines to drop or null. Out: as of ``_probe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        for batch in batches:
            text, marks = batch.column(carried), batch.column(carried + 1)
            for b in V.blocks(text):
                n = len(b.starts)
                whole, _ = V.lines(b)
                first = np.searchsorted(whole.row, np.arange(n))
                mine = marks.slice(b.first, n).fill_null([])
                drop = np.zeros(len(whole.row), bool)
                drop[np.repeat(first, mine.value_lengths().to_numpy()) + mine.flatten().to_numpy()] = True
                columns = [batch.column(k).slice(b.first, n) for k in range(carried)] + _without(b, text, whole, drop)
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def line_index(docs: DataFrame, min_chars: int) -> tuple[DataFrame, int]:
    """(shard, arrays, probes) of all distinct keys, probes: rows that hold the shard's keys; and the number of shards."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_count(min_chars), "h1 long, h2 long, docs long")
    keys = materialize(counted.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")), "line-keys")
    n_shards = max(1, -(-keys.count() // SHARD_KEYS))
    dealt = keys.withColumn("shard", (F.shiftrightunsigned("h1", 20) % n_shards).cast("long"))
    index = materialize(dealt.groupBy("shard").applyInPandas(_build, "shard long, arrays binary, probes long"), "line-index")
    discard(keys)
    return index, n_shards


def _marked(docs: DataFrame, index: DataFrame, n_shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """(k1, k2, lines): the numbers of the lines to drop of each text that has any; docs: k1, k2, text."""
    copies = {r.shard: int(r.n) for r in index.select("shard", F.ceil(F.col("probes") / PROBES).alias("n")).where("n > 1").collect()}
    probes = docs.select("k1", "k2", "text").mapInArrow(_probes(n_shards, copies, min_chars), _PROBE)
    dealt = index.select("shard", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("probes") / PROBES), F.lit(1)).cast("int") - 1)).alias("copy"), "arrays")
    found = probes.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInArrow(_answer(min_docs), "k1 long, k2 long, line int")
    return materialize(found.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines")), "marked-lines")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the lines whose key at least ``min_docs`` of its rows have; returns ``carry``, text, n_lines, n_dropped.

    Lines are split at \\n; a key is the line without white space at both ends, A-Z lower-cased; keys
    of fewer than ``min_chars`` code points stay. A key counts once per row, so repeated rows count as
    often as they are given. Null and empty texts are one empty line and come back empty, as do
    documents that lose every line. Columns not in ``carry`` are not read. Empty input: empty result.
    """
    spark = ship(docs.sparkSession)
    index, n_shards = line_index(docs, min_chars)
    state = docs.select(*carry, F.col("text").cast("string").alias("text"))
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(state.schema.fields)]
    schema = T.StructType([*fields, *(T.StructField(f"c{len(fields) + k}", T.LongType()) for k in range(2))])
    if (index.agg(F.sum(F.length("arrays"))).first()[0] or 0) <= block_bytes:
        arrays = {int(r.shard): bytes(r.arrays) for r in index.select("shard", "arrays").collect()}
        sent = spark.sparkContext.broadcast({"token": uuid.uuid4().hex, "arrays": arrays})
        out = state.mapInArrow(_probe(sent, n_shards, min_docs, min_chars, len(carry)), schema)
    else:
        # equal texts lose the same lines, so a text is known by its hashes
        hashes = (F.xxhash64("text"), F.xxhash64(F.lit("text"), "text", F.octet_length("text")))
        keyed = docs.select(F.col("text").cast("string").alias("text")).select("text", hashes[0].alias("k1"), hashes[1].alias("k2"))
        marks = _marked(keyed, index, n_shards, min_docs, min_chars)
        few = (marks.agg(F.sum(F.size("lines"))).first()[0] or 0) <= SENT_MARKS
        # the columns that are carried may have any name
        named = state.toDF(*[f.name for f in fields])
        text = named[f"c{len(carry)}"]
        on = (F.xxhash64(text) == marks.k1) & (F.xxhash64(F.lit("text"), text, F.octet_length(text)) == marks.k2)
        joined = named.join(F.broadcast(marks) if few else marks, on, "left").select(*named.columns, "lines")
        out = joined.mapInArrow(_drop(len(carry)), schema)
    discard(index)
    return out.toDF(*carry, "text", "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
