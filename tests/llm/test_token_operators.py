import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalog.llm.common import new_path
from stratalog.llm.packing import difference, pack, windows
from stratalog.llm.tokens import read_tokens, write_tokens
from tests.llm.cases import documents, frame

TOOL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
EXTRA = ["It's <|endoftext|> A<|ENDOFTEXT|>b", "e.g. U.S.A., don't... x.y. É. 9.5, ok.", "ſtrange İ ΑΣ. ΑΣ"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def rows():
    out = documents()
    return out + [(800 + k, t, None, None, 0, "", None, None, None) for k, t in enumerate(EXTRA)]


def ids_of(row, end):
    return TOOL.encode(row[1] or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("by_word", [True, False])
def test_token_store_round_trip(spark, rows, by_word):
    path = new_path(spark, "test")
    write_tokens(frame(spark, rows), path, by_word=by_word)
    got = sorted(read_tokens(spark, path).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at, left = 0, defaultdict(list)
    for r in rows:
        left[r[0]].append(ids_of(r, 1))
    for x in got:
        assert x.start == at and x.n_tokens == len(x.tokens)
        left[x.doc_id].remove(x.tokens)
        at += x.n_tokens
    assert not any(left.values())
    some = read_tokens(spark, path, 100, 111).collect()
    assert {x.doc_id: x.start for x in some} == {x.doc_id: x.start for x in got if x.doc_id is not None and 100 <= x.doc_id <= 111}


def test_empty_token_store(spark):
    path = new_path(spark, "test")
    write_tokens(frame(spark, []), path)
    assert read_tokens(spark, path).collect() == [] and pack(frame(spark, [])).collect() == []


@pytest.mark.parametrize("piece", [4096, 700])
def test_packing(spark, rows, piece):
    got = pack(frame(spark, rows), piece=piece, block_bytes=200_000).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.length == len(x.tokens) and x.ids_crc32 == crc(x.tokens)
        docs[x.doc_id].append(x)
        sequences[x.sequence_id].append((x.offset, x.length))
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(ids_of(r, 2))
    for i, texts in want.items():
        assert sum(x.length for x in docs[i]) == sum(map(len, texts))
        for x in docs[i]:
            assert any(t[x.start : x.start + x.length] == x.tokens and len(t) == x.doc_tokens for t in texts)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_differencing():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 4), (7, 3), (200, 17)):
        sizes = r.integers(1, 4097, n)
        part, sums = difference(sizes, m)
        assert (np.sort(np.bincount(part, sizes, m)) == np.sort(sums)).all() and sums.sum() == sizes.sum()
    assert sums.max() - sums.min() < sizes.max() // 4
    part, m = windows(np.array([3000, 3000, 3000]), 4096)
    assert m == 3 and sorted(part) == [0, 1, 2]
