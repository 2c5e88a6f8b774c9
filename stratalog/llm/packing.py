"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing.

Documents are dealt into blocks of about ``block_bytes`` of text by a hash of row and input partition,
so that rows which are given again and again do not meet in one block. Each block tokenises its
documents, cuts off whole windows of long ones, and differences the rest into m windows: every piece
starts as a partition of m sums of which one is not zero; the two partitions with the largest spread
are merged, largest sum upon smallest, until one is left. If its largest window is over the
capacity, m rises and the block is differenced anew.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import vectext as V
from stratalog.llm.common import documents
from stratalog.llm.tokens import encoder, slices
from stratalog.session import ship

CAPACITY = 4096
BLOCK_BYTES = 4 << 20
#: Text that is encoded at once, and words that a worker remembers: less of both takes less memory and more time.
SLICE_BYTES, WORDS = 4 << 20, 800_000


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp into ``m`` parts: each item's part, and the parts' sums."""
    left: list[int] = [-1] * len(sizes)
    right: list[int] = [-1] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums, parts = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[0], parts[0] = size, i
        heap.append((-int(size) if m > 1 else 0, i, sums, parts))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        (_, _, s1, p1), (_, _, s2, p2) = heapq.heappop(heap), heapq.heappop(heap)
        sums, p2 = s1 + s2[::-1], p2[::-1]
        parts = np.where(p1 >= 0, p1, p2)
        both = np.flatnonzero((p1 >= 0) & (p2 >= 0))
        parts[both] = np.arange(len(left), len(left) + len(both))
        left.extend(p1[both].tolist())
        right.extend(p2[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], parts[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, parts))
        tie += 1
    out = np.zeros(len(sizes), np.int64)
    if not heap:
        return out, np.zeros(m, np.int64)
    for k, root in enumerate(heap[0][3].tolist()):
        todo = [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                out[x] = k
            else:
                todo += [left[x], right[x]]
    return out, heap[0][2]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Each item's window and the number of windows; the count rises until no window is over ``capacity``."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, sums = difference(sizes, m)
        if not len(sums) or sums.max() <= capacity:
            return part, m
        m += max(1, int((np.maximum(sums - capacity, 0)).sum() // (2 * capacity)))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens array<int>"


def _pack(tokenizer: str, by_word: bool, end_id: int, capacity: int, piece: int, with_tokens: bool, slice_bytes: int, words: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, doc_ids, text = key[0].as_py(), table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        tool = encoder(tokenizer, by_word, words)
        parts = [tool.encode(texts, end_id) for _, texts in slices(text, slice_bytes)]
        ids, n = np.concatenate([x for x, _ in parts]).astype("<u4", copy=False), np.concatenate([x for _, x in parts])
        del parts, text, table
        base = np.cumsum(n) - n
        whole, rest = n // capacity, n % capacity
        # pieces: whole windows, then what is left in parts of at most `piece`
        doc = np.repeat(np.arange(len(n)), whole)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
        cuts = -(-rest // piece)
        small_doc = np.repeat(np.arange(len(n)), cuts)
        k = np.arange(len(small_doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        small_start = whole[small_doc] * capacity + k * piece
        small_size = np.minimum(piece, n[small_doc] - small_start)
        part, m = windows(small_size, capacity) if len(small_size) else (np.zeros(0, np.int64), 0)
        order = np.lexsort((small_start, small_doc, part))
        part, small_doc, small_start, small_size = part[order], small_doc[order], small_start[order], small_size[order]
        before = np.cumsum(small_size) - small_size
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        offset = before - before[np.flatnonzero(new)][np.cumsum(new) - 1] if len(part) else before
        doc, start = np.concatenate([doc, small_doc]), np.concatenate([start, small_start])
        length = np.concatenate([np.full(len(doc) - len(small_doc), capacity, np.int64), small_size])
        sequence = np.concatenate([m + np.arange(len(doc) - len(small_doc)), part]) + (int(block) << 32)
        offset = np.concatenate([np.zeros(len(doc) - len(small_doc), np.int64), offset])
        at = base[doc] + start
        crc = [zlib.crc32(memoryview(ids[a : a + c])) for a, c in zip(at, length, strict=True)]
        if with_tokens:
            begin = np.cumsum(length) - length
            tokens = V.arrow_list(ids[np.arange(int(length.sum())) + np.repeat(at - begin, length)].view(np.int32), length, pa.int32())
        else:
            tokens = pa.nulls(len(doc), pa.list_(pa.int32()))
        return pa.table([doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset), tokens], names=[x.split()[0] for x in _PIECE.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, piece: int = CAPACITY, by_word: bool = True, block_bytes: int = BLOCK_BYTES, with_tokens: bool = True, slice_bytes: int = SLICE_BYTES, words: int = WORDS) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into windows of at most ``capacity`` ids; one row per piece.

    Returns doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id (unique; block number * 2**32 + window), offset in the window (gapless from 0), and
    the piece's tokens (null without ``with_tokens``). Each document is its ids and ``end_id``; null
    and empty texts are that id alone. What is over whole windows is cut into parts of at most
    ``piece`` ids. ``slice_bytes`` and ``words`` bound a worker's memory and change no result. Repeated rows are packed as often as they are given; other columns are not read.
    Empty input: empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_pack(tokenizer, by_word, end_id, capacity, piece, with_tokens, slice_bytes, words), _PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_tokens=False).drop("tokens")
