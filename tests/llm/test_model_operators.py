import json
import random
import re
import zlib

import numpy as np

from stratalog.llm import langid
from stratalog.llm.chat import OP1_SQL, call_levels, format_chats, op1_chat_formatting, tool_traffic
from stratalog.llm.common import materialize
from stratalog.llm.decontam import MIN_SCORE, Block, align, find_leaks
from stratalog.llm.quality_classifier import STATISTICS, fit, score, statistics, train
from stratalog.llm.sharding import propagate, shard
from tests.llm.cases import ROWS, documents, frame, word


def viterbi(scores, switch):
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.maximum(best, best.max() - switch) + row
    return best.max()


def test_best_path_is_optimal():
    r = np.random.default_rng(2)
    for _ in range(300):
        s = r.normal(0, 3, (r.integers(1, 40), r.integers(1, 5)))
        path = langid.best_path(s, 5.0)
        value = s[np.arange(len(s)), path].sum() - 5.0 * (np.diff(path) != 0).sum()
        assert abs(value - viterbi(s, 5.0)) < 1e-9


def test_languages_and_spans(spark):
    r = random.Random(3)
    say = {"aa": "bcdf aeio", "bb": "ghjk lmno", "cc": "αβγδε"}
    make = lambda k, n: " ".join("".join(r.choice(say[k].replace(" ", "")) for _ in range(r.randint(3, 8))) for _ in range(n))
    rows = [(i, make(k, 30), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    learned = spark.createDataFrame(rows + [(998, None, "aa"), (999, "zz", None)], "doc_id long, text string, lang string")
    model = langid.train_on(learned)
    assert model.langs == ["aa", "bb", "cc"]
    mixed = make("aa", 15) + ". " + make("bb", 40)
    tests = [(1, mixed), (2, make("cc", 5)), (3, "12 ... 34"), (4, None), (5, "漢字"), (6, "…—"), (7, ""), (7, "")]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == "bb" and [x.lang for x in got[1].spans] == ["aa", "bb"]
    assert mixed[got[1].spans[1].start : got[1].spans[1].end] == mixed.split(". ")[1]
    assert got[2].lang_pred == "cc" and got[2].score == 1
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 6, 7))
    assert got[5].lang_pred in model.langs and got[5].score == 0
    held = langid.identify(learned.where(langid.held_out()), model, ("doc_id", "lang"), False)
    assert held.where("lang is not null and lang <> lang_pred and text is not null").count() == 0
    nothing = langid.train_on(frame(spark, []))
    assert {x.lang_pred for x in langid.identify(learned, nothing).collect()} == {"und"}


def test_predictions_against_plain_loops(spark):
    """Counts, word scores, the best path and the prediction, a word at a time."""
    r = random.Random(17)
    say = {"aa": "abcdé", "bb": "abcxy", "cc": "αβγδ"}
    make = lambda k, n: " ".join("".join(r.choice(say[k]) for _ in range(r.randint(1, 8))) for _ in range(n))
    rows = [(i, make(k, 12), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)] + [(900 + i, make("aa", 4) + ", 7 " + make("bb", 9) + " " + make("cc", 3), None) for i in range(20)]
    rows += [(950, "É Ü", None), (951, "漢字 abc", None), (952, "word" * 3000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = lambda t: re.findall(rb"[A-Za-z\x80-\xff]+", t.encode())

    def cells(w):
        b = b"  " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
        return [((b[i + 2] | b[i + 1] << 8 | b[i] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(w) + 1)]

    def script(w):
        c = ord(w.decode()[0])
        return next((k for k, ranges in langid.SCRIPTS.items() if any(a <= c <= z for a, z in ranges)), "other")

    langs, n, writes = ["aa", "bb", "cc"], {}, {}
    for _, text, lang in rows:
        for w in words(text) if lang else ():
            writes[lang, script(w)] = writes.get((lang, script(w)), 0) + 1
            for c in cells(w):
                n[lang, c] = n.get((lang, c), 0) + 1
    used, total = len({c for _, c in n}), {k: sum(v for (x, _), v in n.items() if x == k) for k in langs}
    of = {k: sum(v for (x, _), v in writes.items() if x == k) for k in langs}
    may = lambda k, w: writes.get((k, script(w)), 0) >= max(1, langid.SCRIPT_SHARE * of[k])
    score = lambda k, w: langid.TEMPER * sum(np.log((n.get((k, c), 0) + 0.5) / (total[k] + 0.5 * used)) for c in cells(w))
    got = {x.doc_id: x for x in langid.identify(docs, langid.train(docs)).collect()}
    for i, text, _ in rows:
        raw, table = words(text), []
        for w in raw:
            row = [score(k, w) for k in langs]
            some = [may(k, w) for k in langs]
            table.append([x if m else min(row) - 50 for x, m in zip(row, some)] if any(some) else [0.0] * 3)
        path = langid.best_path(np.array(table, np.float64))
        assert abs(np.array(table)[np.arange(len(raw)), path].sum() - langid.SWITCH * (np.diff(path) != 0).sum() - viterbi(np.array(table), langid.SWITCH)) < 1e-6
        weight = [sum(len(w) for w, p in zip(raw, path) if p == j and any(may(k, w) for k in langs)) for j in range(3)]
        lang = int(np.argmax(weight)) if any(weight) else max(range(3), key=lambda j: of[langs[j]])
        assert got[i].lang_pred == langs[lang] and abs(got[i].score - weight[lang] / sum(map(len, raw))) < 1e-9, i


def test_languages_beyond_the_parameter_are_not_learned(spark):
    rows = [(f"{chr(97 + k)}x " * (200 - k), f"l{k:03}") for k in range(26)] * 4
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), most=5)
    assert model.langs == [f"l{k:03}" for k in range(5)]
    assert len(langid.train(spark.createDataFrame([(f"w{k}", f"l{k}") for k in range(90)], "text string, lang string"), most=80).langs) == 80


def waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
    return h.max()


def test_alignment_equals_the_full_table():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(1, 20)), r.integers(0, 5, r.integers(1, 30))
        assert abs(align(a, b)[0] - waterman(a, b)) < 1e-9


def test_leaks(spark):
    r = random.Random(6)
    items = [(k, " ".join(word(r) for _ in range(40))) for k in range(6)] + [(50, "too short"), (51, None), (52, " ".join(word(r) for _ in range(900))), (53, "")]
    clean = documents(7)
    rows = list(clean)

    def edited(text, every):
        w = text.split()
        return " ".join(word(r) if i % every == every - 1 else x for i, x in enumerate(w))

    def around(text):
        return " ".join(word(r) for _ in range(300)) + " " + text + " " + " ".join(word(r) for _ in range(50))

    planted = {1000: (0, around(items[0][1])), 1001: (1, around(edited(items[1][1], 9))), 1002: (2, items[2][1].upper()), 1003: (3, around(edited(items[3][1], 7))), 1004: (52, around(items[8][1]))}
    planted |= {1100 + k: (4, around(items[4][1])) for k in range(60)}
    rows += [(i, t, None, None, 0, "", None, None, None) for i, (_, t) in planted.items()]
    for block_bytes in (1 << 20, 600):
        found = find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).where("size(hits) > 0").collect()
        assert {x.doc_id: [h.item_id for h in x.hits] for x in found} == {i: [k] for i, (k, _) in planted.items()}
        place = {x.doc_id: x.hits[0] for x in found}
        assert (place[1000].first_word, place[1000].last_word, place[1000].score) == (300, 339, 1.0)
        assert MIN_SCORE <= place[1003].score < 1
    assert find_leaks(frame(spark, clean), spark.createDataFrame([], "item_id long, text string")).where("size(hits) > 0").count() == 0


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "quokka zebra marmot"), (2, "Quokka, zebra"), (3, "yak"), (4, "!?"), (5, "quokka zebra"), (6, "one two three four five")]
    texts = {1: "quokka zebra marmot", 2: "a Zebra. Marmot", 3: "the quokka-zebra; a YAK yak", 4: "", 5: None, 6: "quokka marmot zebra", 7: "so one two three four five it is"}
    want = {1: [(1, 0, 2), (2, 0, 1), (5, 0, 1)], 2: [], 3: [(2, 1, 2), (3, 4, 4), (5, 1, 2)], 4: [], 5: [], 6: [], 7: [(6, 1, 5)]}
    for kind in ("long", "smallint", "string", "decimal(9,2)"):
        rows = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
        for block_bytes in (1 << 20, 70):
            got = find_leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), rows, block_bytes=block_bytes).collect()
            assert {x.doc_id: sorted((int(float(h.item_id)), h.first_word, h.last_word) for h in x.hits) for x in got} == want
            assert all(h.score == 1 for x in got for h in x.hits)


def test_edited_copies_are_found_beside_a_verbatim_one(spark):
    r = random.Random(16)
    items = [(k, " ".join(word(r) for _ in range(50))) for k in range(3)]
    edited = [" ".join(word(r) if i % 5 == 4 else x for i, x in enumerate(t.split())) for _, t in items]
    around = lambda t: " ".join(word(r) for _ in range(100)) + " " + t
    texts = [around(items[0][1])] + [around(edited[0]) for _ in range(2)] + [around(items[1][1])] + [around(edited[1]) for _ in range(40)]
    found = find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: [h.item_id for h in x.hits] for x in found} == {i: [0 if i < 3 else 1] for i in range(len(texts))}
    score = {x.doc_id: x.hits[0].score for x in found}
    assert all(abs(score[i] - waterman(items[k][1].split(), texts[i].split()) / 50) < 1e-9 for i, k in ((0, 0), (1, 0), (5, 1)))


def test_leaks_against_all_alignments(spark):
    """Every document is aligned with every item; those that share an n-gram and reach the score are the hits."""
    r = random.Random(26)
    vocabulary = [word(r) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [prose(r.randint(12, 40)) for _ in range(12)]
    docs = []
    for _ in range(90):
        text = prose(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            part, rate = list(r.choice(items)), r.choice([0, 0.1, 0.2, 0.3])
            part = [w for x in part for w in ([x] if r.random() > rate else r.choice([[], prose(1), [x, *prose(1)]]))]
            at = r.randint(0, len(text))
            text = text[:at] + part + text[at:]
        docs.append(text)
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    want = {(d, k): waterman(item, text) / len(item) for d, text in enumerate(docs) for k, item in enumerate(items) if grams(item) & grams(text)}
    want = {k: v for k, v in want.items() if v >= MIN_SCORE}
    found = find_leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect()
    got = {(x.doc_id, h.item_id): h.score for x in found for h in x.hits}
    assert got.keys() == want.keys() and len(got) > 60 and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_score_bound(spark):
    r = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 30, r.integers(4, 25))) for _ in range(80)]
    block = Block(list(range(80)), texts, 4)
    for n in (0, 1, 5, 10, 20, 30):
        h = r.permutation(block.known)[:n]
        bound = block.bounds(np.arange(80), np.searchsorted(block.known, h))
        assert all(waterman(s, h) <= max(b, 0) <= len(s) for s, b in zip(block.seqs, bound, strict=True))


def test_rule_ensemble(spark):
    r = np.random.default_rng(8)
    x = r.random((3000, 12))
    y = ((x[:, 0] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    model = fit(x, y)
    z = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        on = np.ones(len(x), bool)
        for f, less, bound in rule:
            on &= (x[:, f] <= bound) == less
        z += weight * on
    for f, weight in model.linear:
        z += weight * x[:, f]
    assert ((z > 0) == (y > 0)).mean() > 0.99 and 0 < len(model.rules) < 200


def test_statistics_and_compiled_rules_against_plain_loops(spark):
    rows = documents(19) + [(900, "A a A a! b#b 9 9 9 é é\n\nA a\nA a", None, None, 0, "", None, None, None)]
    ws = "[\x20\x09-\x0D]"

    def plain(text):
        t = text or ""
        w, lines = re.findall(ws.replace("[", "[^") + "+", t), [x for x in t.split("\n") if re.sub(ws, "", x)]
        n, chars, k = max(1, len(w)), max(1, len(t)), max(1, len(lines))
        count = lambda pattern: len(re.findall(pattern, t))
        return [np.log1p(len(w)), sum(map(len, w)) / n, count("[#*$%&|<>]") / n, count("!") / n, count("[A-Z]") / chars, count("[0-9]") / chars, count("[.,;:?]") / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(set(lines)) / k, n / k, (len(t.encode()) - len(t)) / chars]

    got = statistics(frame(spark, rows), ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert np.allclose([x[name] for name in STATISTICS], plain(x.text), rtol=1e-12), x.doc_id
    labels = spark.createDataFrame([(row[0], int(len(row[1] or "") > 300), 0) for row in rows if row[0] is not None], "doc_id long, quality int, toxic int")
    model = train(frame(spark, rows), labels)
    assert model.rules or model.linear
    for x in score(frame(spark, rows), model, ("doc_id", "text")).collect():
        v = plain(x.text)
        z = model.bias + sum(weight for rule, weight in model.rules if all((v[f] <= bound) == less for f, less, bound in rule)) + sum(weight * v[f] for f, weight in model.linear)
        assert abs(x.score - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9


def test_scores_are_defined_for_every_row(spark):
    rows = documents(9)
    labels = spark.createDataFrame([(row[0], int(len(row[1] or "") > 300), 0) for row in rows if row[0] is not None] + [(None, 1, 0), (3, None, 0), (5_000_000, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(frame(spark, rows), labels)
    got = score(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    empty = train(frame(spark, []), labels)
    assert {x.score for x in score(frame(spark, rows), empty).collect()} == {0.5}


def test_sharding(spark):
    r = random.Random(10)
    rows = [(i, f"t{i}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)] + [(2000 + i, f"g{i % 60}") for i in range(180)] + [(None, None), (None, ""), (9000, None), (5, "t5"), (5, "t5")]
    r.shuffle(rows)
    frame_ = spark.createDataFrame([(i, t, None, None, 0, "", None, None, None) for i, t in rows], ROWS).repartition(3)
    for shards in (40, 7):
        got = shard(frame_, shards).collect()
        assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i or -1, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        counts = [sorted(x.slot for x in got if x.shard == j) for j in range(shards)]
        assert max(map(len, counts)) - min(map(len, counts)) <= 1 and all(c == list(range(len(c))) for c in counts)
        where = {}
        for x in got:
            where.setdefault(x.text_crc32, set()).add(x.shard)
        of = lambda t: where[zlib.crc32(t.encode())]
        assert sum(len(of(f"g{k}")) == 1 for k in range(60)) >= 55
        assert len(of("hot")) <= 2 * (300 // (len(rows) // shards) + 1)
    assert shard(frame(spark, [])).collect() == []
    assert {x.shard for x in shard(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).collect()} == {0, 1}


def test_propagation_moves_groups_together_under_quotas(spark):
    """Rows of groups are kept, no round cuts more, and groups that fit end whole."""
    r = random.Random(12)
    shards, n_groups = 6, 90
    state = [(g, f, f, r.randint(1, 4)) for g in range(n_groups) for f in r.sample(range(shards), r.randint(2, 4))]
    total = sum(x[3] for x in state)
    quotas = [total // shards + 12] * shards
    cut = lambda rows: len({(g, s) for g, _, s, _ in rows}) - n_groups
    before = cut(state)
    for rounds in (1, 2, 8):
        got = [tuple(x) for x in propagate(materialize(spark.createDataFrame(state, "gid long, first int, shard int, c long"), "test"), quotas, rounds).collect()]
        assert sorted((g, f, c) for g, f, _, c in got) == sorted((g, f, c) for g, f, _, c in state)
        assert cut(got) <= before
        before = cut(got)
    # every group fits many times over, so that none has to be cut
    assert before <= n_groups // 20


def test_rows_alike_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(None, "same")] * 4000 + [(7, "hot")] * 4000, "doc_id long, text string").repartition(4)
    got = shard(docs, 8).collect()
    assert sorted({x.shard: sum(y.shard == x.shard for y in got) for x in got}.values()) == [1000] * 8
    assert all(sorted(x.slot for x in got if x.shard == j) == list(range(1000)) for j in range(8))


def test_chats(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", 'say "x"\n'),
        (1, 1, "assistant", j({"tool_calls": [{"id": "b", "name": "add", "arguments": {"y": 2, "x": 1.5}, "after": ["a"]}, {"id": "a", "name": "find", "arguments": '{"q": "z"}'}]})),
        (1, 2, "tool", j({"tool_call_id": "b", "content": "3"})),
        (1, 3, "tool", j({"tool_call_id": "zz", "content": "3"})),
        (2, 0, "assistant", j({"tool_calls": [{"id": "p", "name": "add", "arguments": {"x": "s"}, "after": ["q"]}, {"id": "q", "name": "nope", "arguments": {}, "after": ["p"]}]})),
        (3, 0, "assistant", j({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 1}}]})),
        (3, 1, "assistant", j({"tool_calls": [{"id": "c", "name": "find", "arguments": {"q": "1", "more": [1]}, "after": ["gone"]}]})),
        (None, None, None, None),
        (1, 0, "user", 'say "x"\n'),
        (4, 0, "user", "{not json, tool_calls"),
    ]
    messages = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, level int")
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", False), ("find", "q", "string", True)], "tool string, param string, type string, required boolean")
    got = {(x.conv_id, x.turn): x for x in format_chats(messages, schemas).collect()}
    assert format_chats(messages, schemas).count() == len(rows)
    assert json.loads(got[1, 1].json)["tool_calls"] == [{"arguments": {"q": "z"}, "id": "a", "name": "find"}, {"arguments": {"x": 1.5, "y": 2}, "id": "b", "name": "add"}]
    assert (got[1, 1].n_calls, got[1, 1].n_linked, got[1, 1].n_valid, got[1, 1].error) == (2, 1, 2, None)
    assert (got[1, 2].linked_turn, got[1, 2].order_turn, got[1, 2].order_level, got[1, 2].error) == (1, 1, 2, None)
    assert got[1, 3].error == "no call" and got[2, 0].n_valid == 0 and got[3, 0].error == "missing x" and got[3, 1].error == "unexpected more"
    assert got[1, 0].json == '{"content":"say \\"x\\"\\n","conv_id":1,"role":"user","turn":0}' and got[None, None].json == '{"content":"","conv_id":null,"role":null,"turn":null}'
    assert format_chats(messages).count() == len(rows) and format_chats(messages.limit(0)).collect() == []


def test_levels_of_deep_and_tangled_calls(spark):
    r = random.Random(20)
    after = {(1, f"c{k}"): [f"c{k - 1}"] if k else [] for k in range(150)}  # one chain
    after |= {(2, f"s{k}"): [f"s{k - 1}"] for k in range(1, 90)} | {(2, "s0"): ["s89"]}  # one cycle, and calls behind it
    after |= {(2, "t0"): ["s5"], (2, "t1"): ["t0"], (2, "t2"): ["gone"], (2, "t3"): ["t2"], (2, "me"): ["me"]}
    after |= {(3, "top"): ["c80", "d2"]} | {(3, f"c{k}"): [f"c{k - 1}"] if k else [] for k in range(81)} | {(3, "d1"): [], (3, "d2"): ["d1"], (3, "end"): ["top"]}
    for conv in range(4, 12):  # with calls that wait for several, some for later ones
        for k in range(20):
            after[conv, f"x{k}"] = sorted({f"x{r.randrange(k) if k and r.random() < 0.97 else r.randrange(25)}" for _ in range(r.randrange(3))})
    want, ready = {}, True
    while ready:
        ready = {k: 1 + max((want[k[0], d] for d in a), default=-1) for k, a in after.items() if k not in want and all((k[0], d) in want for d in a)}
        want |= ready
    calls = [(c, 0, n, i, "f", "{}", a) for n, ((c, i), a) in enumerate(after.items())]
    levels = call_levels(spark.createDataFrame(calls, "conv_id long, turn long, position int, call_id string, name string, arguments string, after array<string>"))
    got = levels.collect()
    assert len(got) == len({(x.conv_id, x.call_id) for x in got}) and {(x.conv_id, x.call_id): x.level for x in got if not x.missing} == want
    # what could stand somewhere if the calls that are not there were
    free, ready = set(), True
    while ready:
        ready = {k for k, a in after.items() if k not in free and all((k[0], d) in free or (k[0], d) not in after for d in a)}
        free |= ready
    assert {(x.conv_id, x.call_id) for x in got if x.missing} == free - set(want) >= {(2, "t2"), (2, "t3")}
    assert all(x.level is None for x in got if x.missing)


def test_tool_traffic_against_its_sql(spark, tmp_path):
    """The registered query on tables with gaps between turns, against the SQL."""
    import duckdb

    r = random.Random(31)
    rows = []
    for conv in range(40):
        begin = r.randrange(2)
        rows += [(conv, 0, "system", "be brief")] * begin
        for t in range(begin, begin + r.randrange(1, 9)):
            if r.random() < 0.85:
                rows.append((conv, t, "user" if (t - begin) % 2 == 0 else "assistant", r.choice(["", 'say "x"\\ é 漢', "two\nlines  here", None, "a b\tc " * 400])))
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op1_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(OP1_SQL)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    found = got.groupBy("error").count().collect()
    assert {x.error for x in found} == {None, "no call", "after a missing call", "unexpected lines"}


def test_messages_that_stay(spark):
    own = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {}}]})
    rows = [(1, 0, "user", own), (1, None, "user", "x"), (None, 3, None, "y"), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3"})), (2, 0, "user", None)]
    got = {(x.conv_id, x.turn): x for x in tool_traffic(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0].text == own and got[1, None].text == "x" and got[None, 3].text == "y" and got[1, 1].role == "tool"
    assert [c["id"] for c in json.loads(got[2, 0].text)["tool_calls"]] == ["r0", "s0"]


def test_a_chain_of_a_hundred_calls_is_no_cycle(spark):
    n = 100
    calls = [{"id": f"c{k}", "name": "f", "arguments": {}, "after": [f"c{k - 1}"] if k else []} for k in range(n)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls[::-1]})), (1, 1, "tool", json.dumps({"tool_call_id": f"c{n - 1}", "content": "3"}))]
    got = {x.turn: x for x in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[0].n_calls, got[0].n_valid, got[0].error) == (n, n, None)
    assert [x["id"] for x in json.loads(got[0].json)["tool_calls"]] == [f"c{k}" for k in range(n)]
    assert got[1].order_level == n
