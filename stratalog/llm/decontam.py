"""Benchmark decontamination: n-gram seeds, an upper bound of the score, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased, hashed to 64 bits. Items are cut into
segments of at most ``SEGMENT`` words (half overlapping). One pass over the documents finds the
items' n-grams; each is a seed, however frequent it is. The segment is laid around each place
(overlapping places merge) and aligned: a match is +1, a mismatch or a gap -0.5. A document is a hit
if the score is ``min_score`` or more per word of the segment. Before that, segments and places go
whose score cannot reach this: a word of the segment that the document (or the place) holds nowhere
costs 0.5 at least, another brings 1 at most, so the best run of such values bounds the score.

A segment of fewer words than an n-gram has none; it is found where its words stand one after another.

The items are processed in blocks of at most ``block_bytes`` of their measured size, so that what is
broadcast is bounded. A benchmark of usual size is one block and one pass over the documents. With
more, one pass marks the documents that may hold an n-gram of any item (a bit map of hashes), and the
blocks are laid against those only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import vectext as V
from stratalog.llm.common import discard, documents, materialize
from stratalog.session import ship

SEED_WORDS, SEGMENT = 4, 256
MIN_SCORE = 0.5
BLOCK_BYTES = 4 << 20
_MISS, _GAP = 0.5, 0.5


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of word arrays: its score, and its last positions in ``a`` and ``b``."""
    ramp = _GAP * np.arange(1, len(b) + 1)
    row = np.zeros(len(b))
    best, at = 0.0, (-1, -1)
    for i, word in enumerate(a):
        diagonal = np.where(b == word, 1.0, -_MISS)
        diagonal[1:] += row[:-1]
        row = np.maximum(np.maximum(diagonal, row - _GAP), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best:
            best, at = float(row[j]), (i, j)
    return best, *at


class Block:
    """The segments of a block of items, and the n-grams that point into them."""

    def __init__(self, ids: list, texts: list[str | None], words: int):
        self.ids, self.words = ids, words
        self.item, self.seqs = [], []
        grams, where = [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for b in V.blocks(pa.array(texts, pa.string()), 1 << 30):
            s = V.words(b, V.IS_PUNCT)
            h = V.hash_spans(b, s)
            for r in range(len(b.starts)):
                mine = h[s.row == r]
                for a in range(0, max(1, len(mine) - SEGMENT // 2), SEGMENT // 2):
                    seq = mine[a : a + SEGMENT]
                    if len(seq) < words:
                        if len(seq):
                            short.setdefault(len(seq), []).append((int(V.ngrams(seq, np.zeros(len(seq), np.int64), len(seq))[0][0]), r))
                        continue
                    g, _ = V.ngrams(seq, np.zeros(len(seq), np.int64), words)
                    grams.append(g)
                    where.append(np.stack([np.full(len(g), len(self.seqs)), np.arange(len(g))], 1))
                    self.item.append(r)
                    self.seqs.append(seq)
        #: Per number of words: sorted hashes of the segments that have no n-gram, and their items.
        self.short = {n: (np.array([h for h, _ in sorted(of)], V.U64), [r for _, r in sorted(of)]) for n, of in sorted(short.items())}
        g = np.concatenate(grams) if grams else np.zeros(0, V.U64)
        self.where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(g, kind="stable")
        self.where, g = self.where[order], g[order]
        self.grams, first = np.unique(g, return_index=True)
        self.first = np.append(first, len(g))
        self.known, self.codes = np.unique(np.concatenate(self.seqs) if self.seqs else np.zeros(0, V.U64), return_inverse=True)
        self.edges = np.append(0, np.cumsum([len(x) for x in self.seqs])).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams >> V.U64(44)).astype(np.int64)] = True

    def verbatim(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, dict]]:
        """Row and hit of each segment without n-grams that stands in the rows' words, at its first place."""
        for n, (hashes, items) in self.short.items():
            g, at = V.ngrams(h, row, n)
            some = np.flatnonzero(np.isin(g, hashes))
            seen = set()
            for i in some.tolist():
                r, word = int(row[at[i]]), int(at[i])
                if (r, int(g[i])) in seen:
                    continue
                seen.add((r, int(g[i])))
                first = word - int(np.searchsorted(row, r))
                for k in range(int(np.searchsorted(hashes, g[i], "left")), int(np.searchsorted(hashes, g[i], "right"))):
                    yield r, {"item_id": self.ids[items[k]], "score": 1.0, "first_word": first, "last_word": first + n - 1}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the hashes that are n-grams here, and which."""
        at = np.flatnonzero(self.maybe[(h >> V.U64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at] if len(self.grams) else np.zeros(0, bool)
        return at[same], k[same]

    def bounds(self, segments: np.ndarray, known: np.ndarray) -> np.ndarray:
        """What the score of each segment cannot exceed in words of which those of the indexes ``known`` are in items."""
        held = np.zeros(len(self.known), bool)
        held[known] = True
        size = self.edges[segments + 1] - self.edges[segments]
        first = np.cumsum(size) - size
        n = np.repeat(np.arange(len(segments)), size)
        value = np.where(held[self.codes[np.arange(len(n)) + (self.edges[segments] - first)[n]]], 1.0, -_MISS)
        total = np.cumsum(value)
        apart = n * (2.0 * len(n) + 1)  # a later segment's sums are less than all earlier ones
        least = np.minimum.accumulate(total - value - apart) + apart
        return np.maximum.reduceat(total - least, first)

    def hits(self, h: np.ndarray, places: np.ndarray, found: np.ndarray, min_score: float) -> list[dict]:
        """Hits in a document of word hashes ``h`` that has the seeds ``found`` at ``places``."""
        count = self.first[found + 1] - self.first[found]
        which = np.arange(int(count.sum())) + np.repeat(self.first[found] - (np.cumsum(count) - count), count)
        segment, begin = self.where[which, 0], np.repeat(places, count) - self.where[which, 1]
        code = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        code[self.known[code] != h] = -1
        near, at = np.unique(segment, return_inverse=True)
        able = self.bounds(near, code[code >= 0]) >= min_score * (self.edges[near + 1] - self.edges[near])
        segment, begin = segment[able[at]], begin[able[at]]
        order = np.lexsort((begin, segment))
        segment, begin = segment[order], begin[order]
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if len(segment) else np.zeros(1, np.int64)
        best: dict[int, dict] = {}
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            number, begins = int(segment[a]), begin[a:z].tolist()
            seq = self.seqs[number]
            slack = len(seq) // 2 + 2
            lo = hi = None
            for x in [*begins, None]:
                if lo is None or (x is not None and x - slack <= hi):
                    lo, hi = (x - slack, x + len(seq) + slack) if lo is None else (lo, x + len(seq) + slack)
                    continue
                window, own = h[max(0, lo) : hi], code[max(0, lo) : hi]
                possible = self.bounds(np.array([number]), own[own >= 0])[0] >= min_score * len(seq)
                score, i, j = align(seq, window) if possible else (0.0, -1, -1)
                if possible and score >= min_score * len(seq):
                    _, _, back = align(seq[: i + 1][::-1], window[: j + 1][::-1])
                    item, share = self.item[number], score / len(seq)
                    if share > best.get(item, {"score": 0})["score"]:
                        best[item] = {"item_id": self.ids[item], "score": share, "first_word": max(0, lo) + j - back, "last_word": max(0, lo) + j}
                if x is not None:
                    lo, hi = x - slack, x + len(seq) + slack
        return [best[k] for k in sorted(best)]


def _grams(b: V.Block, words: int):
    s = V.words(b, V.IS_PUNCT)
    h = V.hash_spans(b, s)
    g, at = V.ngrams(h, s.row, words)
    return s, h, g, at


def _search(sent, carried: int, more: bool, kind: pa.DataType, min_score: float):
    hit = pa.struct([("item_id", kind), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        block: Block = sent.value
        for batch in batches:
            text = batch.column(carried)
            for b in V.blocks(text):
                n = len(b.starts)
                s, h, g, at = _grams(b, block.words)
                i, k = block.find(g)
                found: list[list[dict]] = batch.column(carried + 1).slice(b.first, n).to_pylist() if more else [[] for _ in range(n)]
                if len(i):
                    place, row = at[i], s.row[at[i]]
                    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
                    first = np.searchsorted(s.row, np.arange(n + 1))
                    for x, y in zip(edge[:-1], edge[1:], strict=True):
                        r = int(row[x])
                        found[r] = found[r] + block.hits(h[first[r] : first[r + 1]], place[x:y] - first[r], k[x:y], min_score)
                for r, one in block.verbatim(h, s.row):
                    found[r] = found[r] + [one]
                columns = [batch.column(c).slice(b.first, n) for c in range(carried)] + [text.slice(b.first, n), pa.array(found, pa.list_(hit))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{c}" for c in range(len(columns))])

    return run


def _marks(blocks: Iterator[Block], n_grams: int, words: int):
    """A function of Arrow batches that adds whether a text may hold an n-gram or short segment of any block."""
    bits = max(20, min(30, int(16 * n_grams).bit_length()))
    held, lengths = np.zeros(1 << bits >> 3, np.uint8), set()
    for block in blocks:
        for g in (block.grams, *(h for h, _ in block.short.values())):
            at = g >> V.U64(64 - bits)
            np.bitwise_or.at(held, (at >> V.U64(3)).astype(np.int64), (1 << (at & V.U64(7)).astype(np.int64)).astype(np.uint8))
        lengths |= {words, *block.short}
    return bits, held, sorted(lengths)


def _mark(sent, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        bits, held, lengths = sent.value
        for batch in batches:
            for b in V.blocks(batch.column(carried)):
                n = len(b.starts)
                s = V.words(b, V.IS_PUNCT)
                h = V.hash_spans(b, s)
                some = np.zeros(n, bool)
                for k in lengths:
                    g, at = V.ngrams(h, s.row, k)
                    place = g >> V.U64(64 - bits)
                    some[s.row[at[(held[(place >> V.U64(3)).astype(np.int64)] >> (place & V.U64(7)).astype(np.uint8)) & 1 == 1]]] = True
                columns = [batch.column(c).slice(b.first, n) for c in range(carried + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(some)], names=[f"c{c}" for c in range(carried + 2)])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",), words: int = SEED_WORDS, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry``, text and hits of every row of ``docs``; hits: item_id, score, first_word, last_word of each item found.

    ``items``: item_id, text. score is the best segment's alignment per word of the segment (1: word
    for word). Items of fewer than ``words`` words are found word for word only; null items and items
    without a word are not searched. item_id comes back as a long if it is a whole number, else as a
    string. Null and empty documents have no hits; repeated rows and items are treated alike; columns
    not in ``carry`` are not read. Without documents or items: empty result or no hits.
    """
    spark = ship(docs.sparkSession)
    whole = dict(items.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    listed = items.where("text is not null").select(F.col("item_id").cast("long" if whole else "string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = F.octet_length("text") + 64
    listed = materialize(listed.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-int(listed.agg(F.sum(size)).first()[0] or 0) // block_bytes))))), "items")
    kind = pa.int64() if whole else pa.string()
    state = docs.select(*carry, F.col("text").cast("string").alias("text"))
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(state.schema.fields)]
    hit = T.StructType([T.StructField("item_id", T.LongType() if kind == pa.int64() else T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
    schema = T.StructType([*fields, T.StructField(f"c{len(fields)}", T.ArrayType(hit))])
    numbers = [r[0] for r in listed.select("block").distinct().sort("block").collect()] or [0]

    def block(number: int) -> Block:
        rows = listed.where(F.col("block") == number).sort("item_id", "text").collect()
        return Block([r.item_id for r in rows], [r.text for r in rows], words)

    rest = None
    if len(numbers) > 1:
        n_grams = listed.agg(F.sum(F.octet_length("text"))).first()[0]
        sent = spark.sparkContext.broadcast(_marks(map(block, numbers), n_grams, words))
        marked = state.mapInArrow(_mark(sent, len(carry)), T.StructType([*fields, T.StructField("near", T.BooleanType())]))
        state = materialize(marked.where("near").drop("near"), "leaks")
        rest = marked.where("not near").drop("near").withColumn("hits", F.array().cast(T.ArrayType(hit)))
    for k, number in enumerate(numbers):
        found = state.mapInArrow(_search(spark.sparkContext.broadcast(block(number)), len(carry), k > 0, kind, min_score), schema)
        if k < len(numbers) - 1:
            old, found = state, materialize(found, "leaks")
            discard(old)
        state = found
    return (state if rest is None else state.union(rest)).toDF(*carry, "text", "hits")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
