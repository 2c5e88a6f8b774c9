import random

import corpus_pipeline
from tests.llm.cases import word


def test_stages(spark, tmp_path):
    """Each stage's decision against what the rows were made for; repeated ids and nulls go through."""
    r = random.Random(11)
    prose = lambda n: " ".join(word(r) for _ in range(n))
    item = prose(40)
    rows = {i: prose(60) for i in range(40)}
    rows |= {100 + k: rows[3] for k in range(3)}
    rows[200] = " ".join(w if i % 50 else "zz" for i, w in enumerate(rows[4].split()))
    rows[300] = prose(30) + " " + item
    rows |= {400 + k: prose(50) + "\nThe same line.\n" + prose(20) for k in range(12)}
    listed = [(i, t) for i, t in rows.items()] + [(5, rows[5]), (500, "12 34"), (501, None), (502, ""), (None, prose(30))]
    documents = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in listed], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == documents.columns
    ids = lambda name: sorted(x.doc_id if x.doc_id is not None else -1 for x in seen[name])
    everything = sorted([i if i is not None else -1 for i, _ in listed])
    assert ids("language_id") == [i for i in everything if i not in (500, 501, 502)]
    assert ids("line_dedup") == ids("language_id") and not any("same line" in x.text for x in seen["line_dedup"]) and all(x.n_chars == len(x.text) for x in seen["line_dedup"])
    assert ids("near_dedup") == sorted({i for i in ids("line_dedup") if i not in (100, 101, 102, 200)})
    assert ids("decontamination") == [i for i in ids("near_dedup") if i != 300]
    assert sorted({x.doc_id if x.doc_id is not None else -1 for x in seen["packing"]}) == ids("decontamination")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_decides_for_each_row(spark):
    """Rows without an id and rows that share one: copies go, all else stays, once."""
    r = random.Random(51)
    prose = lambda n=60: " ".join(word(r) for _ in range(n))
    a, b, c, d, e, f = (prose() for _ in range(6))
    near = " ".join(w if i else "zz" for i, w in enumerate(d.split()))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, d), (None, near), (3, e), (3, e), (4, f), (4, prose()), (4, b), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], COLUMNS).repartition(2)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    texts = sorted((x.text for x in got if x.text), key=repr)
    assert texts == sorted({a, b, c, d, e, f, rows[10][1]})
    assert {(x.doc_id, x.text) for x in got} >= {(1, a), (None, c), (2, d), (3, e), (4, f), (4, rows[10][1]), (5, None), (6, "")}


def test_near_dedup_keeps_what_brute_force_keeps(spark):
    """Of planted near copies those at 0.8 of five-word shingles go, all of them and no others."""
    r = random.Random(52)
    base = [[word(r) for _ in range(120)] for _ in range(20)]
    texts = list(base)
    for w in base:
        for edits in (1, 2, 3, 4, 5, 6):
            new = list(w)
            for at in r.sample(range(len(w)), edits):
                new[at] = word(r) + "q"
            texts.append(new)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    docs = spark.createDataFrame([(i, " ".join(w), "aa", "s", 0) for i, w in enumerate(texts)], COLUMNS)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(root))


def test_stages_on_empty_tables_long_texts_and_more_columns(spark, tmp_path):
    r = random.Random(53)
    empty = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "none")).collect() == [], name
    long = " ".join(word(r) for _ in range(150_000)) + "\n" + "x" * 300_000
    item = " ".join(word(r) for _ in range(30))
    rows = [(1, long, "aa"), (2, item + " " + long, "aa"), (3, "a few words only", "aa"), (4, None, None)]
    docs = spark.createDataFrame([(i, t, k, "s", 0, 1.5, "z", 7) for i, t, k in rows], COLUMNS + ", key_ double, hits string, n_lines int")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {x.doc_id for x in got} == {1, 3} and max(x.length for x in got) == 4096
