"""Language ID: scripts narrow the candidates, Viterbi over word scores labels spans.

Model: per language, log probabilities of byte trigrams inside words (with the word's edges), in a
table of 2**16 hashed cells counted over all training rows, and the share of its words in each
script. A word's score per language is its trigrams' sum, times ``TEMPER`` as neighbouring trigrams
are not independent. Its script, told by its first bytes, leaves as candidates the languages that
write it; a word whose script no language writes has no say. The best path of languages over a
text's words, each switch costing ``SWITCH`` nats, gives the spans. A text whose best single
language never falls behind another by more than half a switch needs no search: no path with
switches can beat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import vectext as V
from stratalog.llm.common import discard, documents, held_out, materialize
from stratalog.session import ship

CELLS = 1 << 16
SWITCH, TEMPER = 8.0, 0.5
SCRIPT_SHARE = 0.005
#: Languages that a model learns at most: those of the most training words.
MOST_LANGUAGES = 1024
#: Counts of so many languages are held in a worker before they are sent on; bytes whose scores are looked up at once.
_HELD, _STEP = 64, 1 << 18

#: All but ASCII letters and bytes of multi-byte characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False

# Unicode ranges of scripts, as first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_NAMES = ["other", *SCRIPTS]


def _script_table() -> np.ndarray:
    """Script number of every code point of the basic plane."""
    table = np.zeros(1 << 16, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


_SCRIPT = _script_table()


def _scripts(b: V.Block, s: V.Spans) -> np.ndarray:
    """Script of each word's first character."""
    last = len(b.data) - 1
    x, y, z = (b.data[np.minimum(s.start + k, last)].astype(np.int64) if last >= 0 else np.zeros(0, np.int64) for k in range(3))
    point = np.where(x < 0x80, x, np.where(x < 0xE0, (x & 0x1F) << 6 | y & 0x3F, np.where(x < 0xF0, (x & 0xF) << 12 | (y & 0x3F) << 6 | z & 0x3F, 0)))
    return _SCRIPT[point]


def _cells(b: V.Block, s: V.Spans) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words' trigrams, and where each word's begin; a word of n bytes has n + 1."""
    n = s.end - s.start + 1
    at = np.cumsum(n) - n
    rel = np.arange(int(n.sum())) - np.repeat(at, n)
    byte = V.ASCII_LOWER[b.data[np.minimum(rel + np.repeat(s.start, n), len(b.data) - 1)]].astype(np.uint32)
    byte[at + n - 1] = 32
    one, two = np.full_like(byte, 32), np.full_like(byte, 32)
    one[1:], two[2:] = byte[:-1], byte[:-2]
    one[rel < 1] = 32
    two[rel < 2] = 32
    code = byte | one << np.uint32(8) | two << np.uint32(16)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), at


def _counted(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, total in counts.items():
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["lang", "cell", "n"])
    counts.clear()


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for b in V.blocks(batch.column(0)):
            s = V.words(b, NOT_LETTER)
            if not len(s.row):
                continue
            cells, at = _cells(b, s)
            size, script = s.end - s.start + 1, _scripts(b, s)
            names = np.array(langs[b.first : b.first + len(b.starts)], object)
            of = names[s.row]
            for lang in set(names[np.unique(s.row)]):
                mine = of == lang
                total = counts.setdefault(lang, np.zeros(CELLS + len(_NAMES), np.int64))
                total[:CELLS] += np.bincount(cells[np.repeat(mine, size)], minlength=CELLS)
                total[CELLS:] += np.bincount(script[mine], minlength=len(_NAMES))
                if len(counts) > _HELD:
                    yield from _counted(counts)
    yield from _counted(counts)


class Model:
    """langs; scores: cell by language; writes: script by language; prior: index of the commonest language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        n = counts[:, :CELLS].astype(np.float64)
        used = max(1, int((n.sum(0) > 0).sum()))
        self.scores = np.ascontiguousarray(np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * used)).T * TEMPER, np.float32)
        script = counts[:, CELLS:].astype(np.float64)
        self.writes = (script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)).T & (script.T > 0)
        self.prior = int(script.sum(1).argmax()) if langs else -1


def train(labelled: DataFrame, most: int = MOST_LANGUAGES) -> Model:
    """Learn from all rows (text, lang) with a text and a lang.

    Counts are summed on the cluster; at most 2**16 a language come to the driver, of the ``most``
    languages that have the most words (ties: by name). Others are not learned.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = rows.mapInArrow(_train, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "language-counts")
    words = counted.where(F.col("cell") >= CELLS).groupBy("lang").agg(F.sum("n").alias("words"))
    langs = sorted(r.lang for r in words.orderBy(F.desc("words"), "lang").limit(most).collect())
    got = counted.where(F.col("lang").isin(langs)).toPandas()
    discard(counted)
    counts = np.zeros((len(langs), CELLS + len(_NAMES)), np.int64)
    counts[got.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(int), got.cell.to_numpy(int)] = got.n.to_numpy(np.int64)
    return Model(langs, counts)


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the path of the highest sum of ``scores`` less ``switch`` per change."""
    n, k = scores.shape
    total = scores.sum(0)
    top = int(total.argmax())
    lead = np.cumsum(scores[:, top : top + 1] - scores, axis=0, dtype=np.float64)
    peak = np.maximum(np.maximum.accumulate(lead, axis=0), 0)
    if float((peak - lead).max()) <= switch / 2:
        return np.full(n, top)
    state = [0.0] * k
    back: list[list[int]] = []
    for row in scores.tolist():
        best = max(range(k), key=state.__getitem__)
        floor = state[best] - switch
        came = [j if state[j] >= floor else best for j in range(k)]
        state = [(state[j] if state[j] >= floor else floor) + row[j] for j in range(k)]
        back.append(came)
    at = max(range(k), key=state.__getitem__)
    path = np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        path[i] = at
        at = back[i][at]
    return path


def _word_scores(model: Model, b: V.Block, s: V.Spans) -> np.ndarray:
    """Each word's score per language, from ``_STEP`` bytes of words at a time."""
    out = np.empty((len(s.start), len(model.langs)), np.float32)
    edge = np.cumsum(s.end - s.start)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(edge, (edge[first - 1] if first else 0) + _STEP, "right")))
        cells, at = _cells(b, V.Spans(*(x[first:last] for x in s)))
        out[first:last] = np.add.reduceat(model.scores[cells], at, axis=0)
        first = last
    return out


_SPAN = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _label(sent, carried: int, with_spans: bool, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.release()
        model: Model = sent.value
        k = len(model.langs)
        for batch in batches:
            text = batch.column(carried)
            for b in V.blocks(text, max(1 << 16, (8 << 20) // max(8, k))):
                n = len(b.starts)
                s = V.words(b, NOT_LETTER)
                count = np.bincount(s.row, minlength=n)
                first = np.cumsum(count) - count
                pred, score, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if k and len(s.row):
                    words = _word_scores(model, b, s)
                    may = model.writes[_scripts(b, s)]
                    some = may.any(axis=1)
                    words = np.where(may, words, np.where(some[:, None], words.min(axis=1, keepdims=True) - 50, 0))
                    size = s.end - s.start
                    plain = np.zeros(n, bool)
                    plain[np.unique(s.row[b.data[s.start] < 128])] = True
                    points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)]) if with_spans else None
                    for r in np.flatnonzero(count):
                        if not plain[r] and not any(c.isalpha() for c in text[b.first + int(r)].as_py()):
                            continue
                        a, z = first[r], first[r] + count[r]
                        path = best_path(words[a:z], switch)
                        weight = np.bincount(path, weights=size[a:z] * some[a:z], minlength=k)
                        lang = int(weight.argmax()) if weight.any() else model.prior
                        pred[r], score[r] = model.langs[lang], weight[lang] / size[a:z].sum()
                        if with_spans:
                            edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
                            base = points[b.starts[r]]
                            spans[r] = [{"lang": model.langs[path[i]], "start": int(points[s.start[a + i]] - base), "end": int(points[s.end[a + j - 1]] - base)} for i, j in zip(edge[:-1], edge[1:], strict=True)]
                columns = [batch.column(c).slice(b.first, n) for c in range(carried)]
                columns += [text.slice(b.first, n), pa.array(pred, pa.string()), pa.array(score)]
                if with_spans:
                    columns.append(pa.array(spans, pa.list_(_SPAN)))
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{c}" for c in range(len(columns))])

    return run


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), with_spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """``carry``, text, lang_pred, score and spans (lang, start, end in code points) of every row of ``docs``.

    lang_pred is the language of most letters' bytes, score their share of all. Null texts and texts
    without a letter: `und`, score 0, no spans. Texts in scripts that no learned language writes: the
    commonest learned language with score 0. Without learned languages: `und`. Columns not in
    ``carry`` are not read; rows may repeat; empty input: empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(*carry, F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(rows.schema.fields)]
    names = [*carry, "text", "lang_pred", "score"]
    fields += [T.StructField(f"c{len(fields)}", T.StringType()), T.StructField(f"c{len(fields) + 1}", T.DoubleType())]
    if with_spans:
        span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        fields.append(T.StructField(f"c{len(fields)}", T.ArrayType(span)))
        names.append("spans")
    return rows.mapInArrow(_label(sent, len(carry), with_spans, switch), T.StructType(fields)).toDF(*names)


def train_on(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` that are not held out."""
    return train(docs.where(~held_out()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, train_on(docs), with_spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
