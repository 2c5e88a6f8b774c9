"""Tokenising whole texts, and token ids as Parquet list columns with a file format of its own.

Layout of a token store: files in ascending doc_id order (range partitions, sorted), each row
doc_id, part (its range), local_start (ids before it in its part), n_tokens, tokens. Token ids are
dictionary-coded, the sorted number columns delta-coded (data pages of version 2), row groups and
pages are small and page indexes are written, so that a reader of metadata or of an id range decodes
nothing else. Global starts follow from one row per part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stratalog.llm import vectext as V
from stratalog.llm.common import documents, new_path, shuffle_width
from stratalog.session import ship

CACHED_WORDS = 550_000
#: Words that the tokenizer is given as one text.
WORDS_AT_ONCE = 32
#: Bytes of text of a file of a token store.
FILE_BYTES = 128 << 20


class Encoder:
    """Encodes texts with a tokenizers file, without special tokens.

    ``by_word``: the tokenizer drops white space and joins nothing across it, so a text's ids are
    its words' ids in order; every word is then encoded once and remembered. Beyond
    ``most`` words those seen once only are forgotten, or all if that is not enough.
    """

    def __init__(self, path: str, by_word: bool = True, most: int = CACHED_WORDS):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        letters = "ABC DEFGH IJKLMNO PQRSTUVWXYZ"
        #: The tokenizer itself lower-cases: A-Z may be folded before words are looked up.
        self.folds = self.tokenizer.encode(letters, add_special_tokens=False).ids == self.tokenizer.encode(letters.lower(), add_special_tokens=False).ids
        #: It also parts words from a stop or comma behind them, so these may be words of their own.
        self.parts = all(self.tokenizer.encode("est" + x, add_special_tokens=False).ids == self.tokenizer.encode("est " + x, add_special_tokens=False).ids for x in ".,")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: A special token that can stand between words, spaced, and its id.
        self.mark = None
        for id_, x in self.tokenizer.get_added_tokens_decoder().items():
            parted = self.tokenizer.encode(f"est {x.content} est {x.content} ", add_special_tokens=False).ids
            word = self.tokenizer.encode("est", add_special_tokens=False).ids
            if x.special and parted == [*word, id_, *word, id_]:
                self.mark = (f" {x.content} ", id_)
                break
        self._forget()

    def _forget(self) -> None:
        self.words, self.pool, self.n_pool, self.starts, self.n_words = {}, np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.int64), 0
        self.seen = np.zeros(1 << 16, np.int32)

    def _thin(self) -> None:
        kept = np.flatnonzero(self.seen[: self.n_words] > 1)
        if len(kept) > self.most * 3 // 4:
            return self._forget()
        names = list(self.words)
        first = self.starts[kept]
        n = self.starts[kept + 1] - first
        end = np.cumsum(n)
        self.pool = self.pool[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - (end - n), n)]
        self.words = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.n_pool, self.n_words = len(self.pool), len(kept)
        self.pool, self.starts = np.append(self.pool, np.zeros(1 << 16, np.uint32)), np.concatenate([[0], end, np.zeros(1 << 16, np.int64)])
        self.seen = np.concatenate([np.ones(len(kept), np.int32), np.zeros(1 << 16, np.int32)])

    def _room(self, more: int) -> None:
        while self.n_pool + more > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(1 << 20, np.uint32)])

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in order, and how many each has; several words a call with a special token between them, if there is one."""
        plain = "".join(words).lower() if self.mark else ""
        if not self.mark or any(x.lower() in plain for x in self.special):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n
        mark, id_ = self.mark
        texts = [mark.join([*words[k : k + WORDS_AT_ONCE], ""]) for k in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] or [np.zeros(0, np.uint32)])
        own = ids != id_
        return ids[own], np.diff(np.flatnonzero(~own), prepend=-1) - 1

    def _learn(self, new: list[str]) -> None:
        ids, n = self._apart(new)
        total = len(ids)
        self._room(total)
        while self.n_words + len(new) + 2 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.n_words + len(new) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.pool[self.n_pool : self.n_pool + total] = ids
        self.starts[self.n_words + 1 : self.n_words + 1 + len(new)] = self.n_pool + np.cumsum(n)
        self.n_pool += total
        self.n_words += len(new)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column (null: empty) in order, each text's followed by ``end_id`` if given, and how many each text has."""
        texts = texts.fill_null("")
        if not self.by_word:
            end = [] if end_id is None else [end_id]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids = [x + end for x in ids]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n
        if self.folds and not any(pc.any(pc.match_substring(texts, x, ignore_case=True)).as_py() for x in self.special):
            texts = pc.ascii_lower(texts)
        if self.parts:
            texts = pc.replace_substring_regex(texts, r"(\pL)([.,])([ \n]|$)", r"\1 \2\3")
        if len(self.words) > self.most:
            self._thin()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        per_text = pc.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        listed = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.words.get, listed, repeat(-1)), np.int64, len(listed))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = np.arange(self.n_words, self.n_words + len(new))
            names = list(map(listed.__getitem__, new.tolist()))
            self.words.update(zip(names, known[new].tolist(), strict=True))
            self._learn(names)
        at = known[coded.indices.to_numpy()]
        self.seen[: self.n_words] += np.bincount(at, minlength=self.n_words).astype(np.int32)
        if end_id is not None:
            # the end id stands in the pool behind all words, as a word of its own
            self._room(1)
            self.pool[self.n_pool] = end_id
            self.starts[self.n_words + 1] = self.n_pool + 1
            at = np.insert(at, np.cumsum(per_text), self.n_words)
            per_text = per_text + 1
        # a word's ids are its bytes, so that Arrow gathers them run by run
        offsets = (4 * self.starts[: self.n_words + 2]).astype(np.int32)
        pool = pa.Array.from_buffers(pa.binary(), self.n_words + 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.pool)])
        _, ends, ids = pool.take(pa.array(at)).buffers()
        before = np.frombuffer(ends, np.int32, len(at) + 1) // 4
        edge = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
        return np.frombuffer(ids, np.uint32, int(before[-1])) if ids else np.zeros(0, np.uint32), np.diff(before[edge].astype(np.int64))


_encoders = V.kept()


def encoder(path: str, by_word: bool = True, most: int = CACHED_WORDS) -> Encoder:
    """This worker's encoder for a file; a bare name is one of the public tokenizers' files."""
    V.release(_encoders)
    if (path, by_word, most) not in _encoders:
        _encoders.clear()
        found = path
        if os.sep not in path:
            import public_tokenizers

            found = public_tokenizers.path(path)
        _encoders[path, by_word, most] = Encoder(found, by_word, most)
    return _encoders[path, by_word, most]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """A string column in slices of about ``limit`` bytes, with the number of each one's first row."""
    for b in V.blocks(column, limit):
        yield b.first, column.slice(b.first, len(b.starts))


def _encode(path: str, by_word: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, before = encoder(path, by_word), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, n = tool.encode(texts, end_id)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), V.arrow_list(ids.view(np.int32), n, pa.int32())],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )

    return run


_STORE = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, by_word: bool = True, row_group_bytes: int = 32 << 20, page_rows: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text), each followed by ``end_id``, as a token store.

    Null texts are empty (the end id alone). Rows are ordered by doc_id (null first), repeated ids by
    their text's hash; other columns are not read. Empty input: an empty store. There is a file for
    each ``file_bytes`` of text, and at least one for each shuffle partition of the session.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    files = max(shuffle_width(docs.sparkSession), -(-int(total) // file_bytes))
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = ranged.mapInArrow(_encode(tokenizer, by_word, end_id), _STORE).write
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "compression": "snappy",
    }
    writer.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of a token store with their global ``start``; ``first`` and ``last`` bound doc_id and reach the page index."""
    store = spark.read.schema(_STORE).parquet(path)
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    if first is not None:
        store = store.where(F.col("doc_id") >= first)
    if last is not None:
        store = store.where(F.col("doc_id") <= last)
    # one row per part: as many as the store has files
    return store.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    V.release()
    for batch in batches:
        tokens = batch.column(3)
        values = tokens.flatten().to_numpy().astype("<u4")
        ends = np.cumsum(pc.list_value_length(tokens).to_numpy())
        crc = [zlib.crc32(memoryview(values[a:b])) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    read = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    return read.mapInArrow(_checksums, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))
