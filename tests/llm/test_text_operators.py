import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import vectext as V
from stratalog.llm.linededup import LineIndex, drop_common_lines, line_index
from stratalog.llm.neardup import near_duplicates, sketches
from stratalog.llm.quality_rules import _FLOOR, CUTOFF, quality_rules
from tests.llm.cases import documents, frame, key, word

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_word_and_line_spans():
    texts = ["a bc\n\nD ", None, "", "\n", "éa  b\tc", "x"]
    for limit in (1, 4, 1 << 20):
        words, lines = [], []
        for b in V.blocks(pa.array(texts), limit):
            raw = b.data.tobytes()
            s = V.words(b)
            words += [(b.first + r, raw[i:j].decode()) for r, i, j in zip(*s)]
            whole, _ = V.lines(b)
            lines += [(b.first + r, raw[i:j].decode()) for r, i, j in zip(*whole)]
        assert words == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
        assert lines == [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n")]


def test_hashes_do_not_depend_on_the_block():
    texts = ["Word", "x" * 100_000 + " word", "wOrd other"]
    found = defaultdict(set)
    for limit in (1, 1 << 20):
        for b in V.blocks(pa.array(texts), limit):
            s = V.words(b)
            raw = b.data.tobytes()
            for h, i, j in zip(V.hash_spans(b, s), s.start, s.end):
                found[raw[i:j].decode().lower()].add(int(h))
    assert all(len(v) == 1 for v in found.values()) and len(set().union(*found.values())) == 3


def test_hashes_do_not_depend_on_the_step(monkeypatch):
    b = next(V.blocks(pa.array(["ab  cde", "x" * 40_000 + " y", "", " fgh" * 9])))
    s = V.words(b)
    want = V.hash_spans(b, s)
    monkeypatch.setattr(V, "HASHED_BYTES", 7)
    assert (V.hash_spans(b, s) == want).all() and len(V.hash_spans(b, V.Spans(*(x[:0] for x in s)))) == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    h1, h2 = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(0, 1 << 63, 5000).astype(np.uint64)
    index = LineIndex.from_bytes(LineIndex.build(h1, h2, np.arange(5000) + 1).to_bytes())
    assert sum(int(x.sum()) for x in index.levels) == 5000 == len(index.prints)
    assert (index.lookup(h1, h2) == np.arange(5000) + 1).all()
    assert (index.lookup(h1, h1) == 0).all()
    assert len(LineIndex.from_bytes(LineIndex.build(h1[:0], h2[:0], h1[:0].astype(int)).to_bytes()).lookup(h1, h2)) == 5000


@pytest.mark.parametrize("block_bytes, shard_keys, probes, sent", [(1 << 20, 1 << 18, 1 << 20, 1 << 20), (1 << 20, 9, 1 << 20, 1 << 20), (0, 20, 5, 1 << 20), (0, 40, 1 << 20, 0)])
@pytest.mark.parametrize("min_chars", [1, 5])
def test_line_dedup(spark, block_bytes, shard_keys, probes, sent, min_chars, monkeypatch):
    for name, value in (("SHARD_KEYS", shard_keys), ("PROBES", probes), ("SENT_MARKS", sent)):
        monkeypatch.setattr(f"stratalog.llm.linededup.{name}", value)
    rows = documents()
    rows += [(i, f"a{i % 3}\nb{i % 2}\nc", None, None, 0, "", None, None, None) for i in range(600, 640)]
    count = Counter()
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for row in rows:
        count.update({norm(x) for x in (row[1] or "").split("\n")})
    want = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [x for x in lines if not (len(norm(x)) >= min_chars and count[norm(x)] >= 10)]
        want.append((row[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = drop_common_lines(frame(spark, rows), 10, min_chars, block_bytes=block_bytes).collect()
    assert key(tuple(x) for x in got) == key(want)


def test_line_dedup_of_nothing(spark):
    for block_bytes in (1 << 20, -1):
        assert drop_common_lines(frame(spark, []), carry=("doc_id", "node"), block_bytes=block_bytes).collect() == []


def test_the_index_holds_every_line(spark):
    rows = documents()
    index, n_shards = line_index(frame(spark, rows), 1)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter()
    for row in rows:
        count.update({norm(x) for x in (row[1] or "").split("\n")} - {""})
    found = index.collect()
    arrays = [LineIndex.from_bytes(bytes(x.arrays)) for x in found]
    assert n_shards == 1 and sum(len(x.prints) for x in arrays) == len(count) and found[0].probes == sum(count.values())
    assert sorted(np.concatenate([x.counts for x in arrays])) == sorted(count.values())


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize("n, large", [(2, 10_000), (5, 10_000), (2, 1)])
def test_near_duplicates(spark, n, large, monkeypatch):
    monkeypatch.setattr("stratalog.llm.neardup.LARGE", large)
    monkeypatch.setattr("stratalog.llm.neardup.SENT_ROWS", 0 if large == 1 else 1_000_000)
    monkeypatch.setattr("stratalog.llm.neardup.CHUNK", 5)
    rows = documents(2)
    base = documents(2)[0][1] or "a b c"
    r = random.Random(5)
    shared = " ".join(word(r) for _ in range(60)).split()
    for k in range(60):  # edits around the limit of similarity
        w = list(shared)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = word(r)
        rows.append((2000 + k, " ".join(w), None, None, 0, base[:3], None, None, None))
    # two texts of one document, and a near copy of each
    for k in (0, 1):
        text = [word(r) for _ in range(60)]
        rows += [(3000, " ".join(text), None, None, 0, "", None, None, None), (3001 + k, " ".join([*text[:-1], "zz"]), None, None, 0, "", None, None, None)]
    sets = [shingles(row[1], n) for row in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and (100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    one = {}
    for i, row in enumerate(rows):
        if sets[i] and row[0] is not None:
            root[find(i)] = find(one.setdefault(row[0], i))
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    want = []
    for i, row in enumerate(rows):
        component = least.get(find(i)) if sets[i] else row[0]
        want.append((row[0], len(sets[i]), component, row[0] == component))
    got = near_duplicates(frame(spark, rows), words=n).collect()
    assert key(tuple(x) for x in got) == key(want)
    assert {x.component_id for x in got if x.doc_id in (3000, 3001, 3002)} == {3000}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_sketches_estimate_similarity():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    for size in (1, 3, 40, 900):
        a, b = pool[:size], pool[size // 5 : size // 5 + size]
        s = sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([size, size]), 384)
        both = len(set(a.tolist()) & set(b.tolist()))
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((s[0] == s[1]).mean() - both / (2 * size - both)) < 0.12


def test_quality_statistics(spark):
    rows = documents() + [(700, "a b c d e " * 9 + "z", "aa", "s0", 0, "", None, None, None)]
    want = []
    for row in rows:
        text = row[1] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want.append((row[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed))
    got = quality_rules(frame(spark, rows)).collect()
    assert key(tuple(x)[:7] for x in got) == key(want)
    assert all(x.kept == (not x.base_failed and x.distance <= CUTOFF) for x in got)


def test_quality_rules_reject_outliers_and_keep_the_rest(spark):
    rows = [row[:2] + ("aa", "s0") + row[4:] for row in documents(4, 120) if row[1] and len(row[1].split()) > 20 and row[0] is not None and row[0] < 100]
    rows.append((900, " ".join(f"w{i} ###" for i in range(60)), "aa", "s0", 0, "", None, None, None))
    got = {x.doc_id: x for x in quality_rules(frame(spark, rows)).collect()}
    assert not got[900].kept and all(x.kept for i, x in got.items() if i != 900)
    assert quality_rules(frame(spark, [])).collect() == []


def test_distances_against_numpy(spark):
    """The whole estimate by plain loops: medians to 1/200, bins of distance, two starts, four steps, fallback to language and all."""
    r = random.Random(41)
    rows, of = [], {}
    for k, (lang, source, n) in enumerate([("aa", "s0", 150), ("aa", "s1", 60), ("aa", "s2", 7), ("bb", "s0", 30), ("bb", None, 30), (None, "s0", 5), ("cc", "s1", 9)]):
        for i in range(n):
            w = [word(r) + ("#" if r.random() < 0.02 * (k + 1) else "") for _ in range(r.randint(10, 150))]
            if r.random() < 0.2:
                w[3:3] = ["one two three four five"] * 2
            text = "\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)) + "\nthe end" * r.choice([0, 1, 1, 3])
            rows.append((k * 1000 + i, text, lang, source, 0, "", None, None, None))
            of[k * 1000 + i] = (lang, source)
    got = {x.doc_id: x for x in quality_rules(frame(spark, rows)).collect()}
    use = [x for x in got.values() if not x.base_failed]
    ids = np.array([x.doc_id for x in use])
    x = np.round(np.array([[np.log1p(x.n_words), np.log1p(x.word_chars / x.n_words), np.log1p(20 * x.n_symbols / x.word_chars), np.log1p(x.n_dup_lines), np.log1p(5 * x.n_repeat_words / x.n_words)] for x in use]), 9)
    floor = np.array(_FLOOR)

    def middle(v):
        v = np.sort(np.floor(np.abs(v) * 200 + 0.5) * np.sign(v), axis=0)
        return v[(len(v) + 1) // 2 - 1] / 200

    def nearest(d, share):
        bins = np.floor(np.log(np.maximum(d, 1e-6)) * 16)
        limit = np.sort(bins)[int(np.ceil(len(d) * share)) - 1]
        return bins <= limit

    def estimate(v):
        return v.mean(0), np.cov(v.T, bias=True) / 0.75 + np.diag(floor**2)

    def distance(v, m, c):
        return np.einsum("ij,ij->i", (v - m) @ np.linalg.inv(c), v - m)

    def robust(v):
        m = middle(v)
        t = np.abs(v - m) / (middle(np.abs(v - m)) * 1.4826 + floor)
        best = None
        for d in ((t * t).sum(1), t.max(1)):
            model = estimate(v[nearest(d, 0.5)])
            for _ in range(4):
                model = estimate(v[nearest(distance(v, *model), 0.75)])
            if best is None or np.linalg.det(model[1]) < np.linalg.det(best[1]) - 1e-15:
                best = model
        return best

    key_ = np.array([repr(of[i]) for i in ids])
    lang = np.array([repr(of[i][0]) for i in ids])
    levels = set()
    for k in set(key_):
        mine = key_ == k
        same = lang == lang[mine][0]
        level, basis = (2, mine) if mine.sum() >= 50 else (1, same) if same.sum() >= 50 else (0, np.ones(len(ids), bool))
        levels.add(level)
        want = distance(x[mine], *robust(x[basis]))
        assert np.allclose([got[i].distance for i in ids[mine]], want, rtol=1e-4, atol=1e-5), k
    assert levels == {0, 1, 2}


