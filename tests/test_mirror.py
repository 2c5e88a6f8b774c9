import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import numbers, text
from stratalog.operators import cluster, gallery, publish, scoring
from stratalog.sources import documents, mirror

PAGE = """<html><table><tr><td class="datum">05-03-2008</td></tr>
<tr><td class="x post_titel"><a href="archief.php?ID=7">#</a> One &amp; <img src=z> only<td>side
<tr><td class='bericht_content'><p onclick=x>Some text</p><script>no</script><img src="a.jpg"><img src="a.jpg"><h1>04-03-2008, 09:05 geschreven door Daan</h1></td></tr>
<tr><td>Reageer (12)</td></tr></table>
<table><tr><td class=post_titel><a href=archief.php?ID%3D71>#</a>Other</td></tr><tr><td class=bericht_content>other text</td></tr></table></html>"""


def test_a_page_of_posts():
    (post,) = mirror._parse(PAGE, "7")
    assert (post["title"], post["day"], post["signed_day"], post["time"], post["author"], post["counted"], post["images"]) == ("One & only", "05-03-2008", "04-03-2008", "09:05", "Daan", 12, ["a.jpg"])
    assert post["text"].startswith("Some text") and "script" not in post["html"] and "onclick" not in post["html"]
    (post,) = mirror._parse(PAGE, "71")
    assert (post["title"], post["day"], post["text"], post["id"]) == ("Other", "", "other text", "71")
    assert mirror._parse(PAGE, "999")[0]["title"] == "One & only" and mirror._parse(None, "1") == [] and mirror._parse("<td class=post_titel><a href=archief.php?ID=1>x</a>", "1") == []


def test_mirror_of_files(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "archief.php?ID=7.html").write_text(PAGE.replace("text", "tÃ©xt"))
    (tmp_path / "one" / "archief.php?ID=71.html").write_text(PAGE)
    voice = "<table><tr><td class=post_titel><a href=reageer.php?postID=7>r</a>{}</td></tr><tr><td class=bericht_content>{}<h1>{}</h1></td></tr></table>"
    (tmp_path / "one" / "reageer.php?postID=7.html").write_text(PAGE + voice.format("Re", "thank you for these pears", "") + voice.format("", "", "") + voice.format("Hi", "cheap nike outlet", ""))
    (tmp_path / "one" / "other.html").write_text(PAGE)
    pages = mirror.read_mirror(spark, str(tmp_path), ["one"])
    assert sorted((x.kind, x.post_id) for x in pages.collect()) == [("post", "7"), ("post", "71"), ("reaction", "7")]
    overrides = spark.createDataFrame([("one-71", "01-01-2001", "08:00")], "slug string, date string, time string")
    posts = mirror.mirror_posts(pages, "own", "Owner", ("daan",), overrides=overrides)
    got = {x.slug: x for x in posts.collect()}
    assert set(got) == {"one-7", "one-71"}
    assert (got["one-7"].isoDate, got["one-7"].author, got["one-7"].reactionCount, got["one-7"].excerpt[:9]) == ("2008-03-05T09:05:00", "Owner", 1, "Some téxt")
    assert (got["one-71"].isoDate, got["one-71"].author, got["one-71"].reactionCount) == ("2001-01-01T08:00:00", "Owner", 0)
    assert [(r.id, r.author) for r in got["one-7"].reactions] == [("7-2", "Onbekend")]
    assert [x.id for x in posts.orderBy(*mirror.import_order(posts)).collect()] == ["7", "71"]
    assert mirror.mirror_posts(pages.limit(0), "own", "Owner").collect() == []


def test_repair_of_broken_sequences_only(spark):
    cases = {"café cafÃ©": "café café", "漢 cafÃ©": "漢 café", "Itâ€™s": "It’s", "Gregg\x92s": "Gregg’s", "Â&nbsp;x": "&nbsp;x", "Ã la carte": "à la carte", "fatherâs": "father’s", "Ã\x83Â©": "é", "âHello": "“Hello", "wordâ.": "word”.", "Ã": "Ã", "plain": "plain", None: None, "": "", "waitâ¦": "wait…", "100Â ": "100 "}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {x.t: x.r for x in rows.select("t", text.repair_encoding(F.col("t")).alias("r")).collect()}
    assert got == cases


def test_letters_lose_their_accents(spark):
    r = spark.createDataFrame([("Šőń É é ﬁ Ệ",)], "t string").select(text.without_accents(F.col("t")), text.slug(F.col("t")), text.title_case_list(F.concat(F.lit("a"), F.repeat(F.lit("b"), 20_000)))).first()
    assert r[0] == "Son E e ﬁ E" and r[1].startswith("son-e-e") and len(r[2]) == 20_001


def test_dutch_numbers(spark):
    cases = [(0.0, "0", "0", "0%"), (1234.5, "1.235", "1.234,5", "25%"), (999.95, "1.000", "1K", "20%"), (-1234567.0, "-1.234.567", "-1,2 mln.", "-24691%"), (999960.0, "999.960", "1 mln.", "19999%"), (2.5e9, "2.500.000.000", "2,5 mld.", "50000000%"), (None, None, None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "v double").select("v", numbers.dutch_number(F.col("v")), numbers.dutch_number(F.col("v"), 1), numbers.dutch_compact(F.col("v")), numbers.percent(F.col("v"), F.lit(5000.0)), numbers.percent(F.col("v"), F.lit(0))).collect()
    for x, c in zip(rows, cases, strict=True):
        assert x[1] == c[1] and x[5] == "0%" and x[4] == c[3], x
    assert [x[2] for x in rows][:2] == ["0", "1.234,5"] and [x[3] for x in rows][1:6] == ["1,2K", "1K", "-1,2 mln.", "1 mln.", "2,5 mld."]


def test_random_orders(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    one, two, front = (sorted((x.place, x.k) for x in gallery.shuffled(rows, "k", *a).collect()) for a in ((1,), (2,), (1, 77)))
    assert [p for p, _ in one] == list(range(500)) and sorted(k for _, k in one) == list(range(500)) and one != two
    assert front[0] == (0, 77) and [k for _, k in front[1:]] == [k for _, k in one if k != 77]
    assert gallery.random_row(rows, "k", 3).count() == 1 and len({gallery.random_row(rows, "k", s).first().k for s in range(20)}) > 12 and gallery.random_row(rows.limit(0), "k", 1).collect() == []


def test_questions_and_payloads(spark):
    tags = [("a", "Is it a?", "An a.", 0.5), ("b", 'Is it "b"?', "A b.", 0.6)]
    kind = "id string, question string, definition string, threshold double"
    digest = lambda rows: publish.question_digest(spark.createDataFrame(rows, kind)).first().digest
    assert digest(tags) == digest(tags[::-1]) == digest([(*t[:3], 0.9) for t in tags]) != digest([("a", "Is it?", "An a.", 0.5), tags[1]])
    units = spark.createDataFrame([(0, 1, ("x", 1)), (0, 0, ('y "q"', None)), (1, 2, (None, None))], "batch int, pos int, state struct<t:string,n:int>")
    got = {x.batch: json.loads(x.payload) for x in publish.batch_payloads(units, spark.createDataFrame(tags, kind), "batch", "pos", "state", "m").collect()}
    assert got[0]["state"]["records"] == [{"id": "r0", "t": 'y "q"'}, {"id": "r1", "t": "x", "n": 1}] and got[1]["state"]["records"] == [{"id": "r0"}]
    assert set(got[0]["questions"]) == {"r0__a", "r0__b", "r1__a", "r1__b"} and got[0]["questions"]["r1__b"] == {"type": "noul", "instructions": 'For the record with id "r1", and only that record: Is it "b"? A b.'}
    images = [(0, 0, "i", "c"), (0, 1, "j", "d"), (1, 0, "i", "c")]
    keys = lambda rows, v="1": {x.b: x.batch_key for x in publish.batch_key(spark.createDataFrame(rows, "b int, pos int, id string, content string"), "b", "pos", "id", "content", "m", v).collect()}
    assert keys(images) == keys(images[::-1]) and keys(images)[0] != keys(images, "2")[0] and keys(images)[0] != keys([(0, 0, "i", "c"), (0, 1, "j", "e")])[0]


def test_lookups_cards_and_suggestions(spark):
    posts = spark.createDataFrame([("2", "s", ["x"]), ("1", "s", []), ("3", "t", ["y"])], "id string, slug string, images array<string>")
    assert publish.post_by_slug(posts, "s").first().id == "1" and publish.post_by_slug(posts, "?").collect() == []
    assert [x.id for x in publish.posts_with_images(posts, 1, "id").collect()] == ["2"]
    card = publish.contact_cards(spark.createDataFrame([("i<", "/archive-images/a.b.JPG", None, ["t", "u"], 'l "q"')], "id string, src string, description string, tags array<string>, linkedText string"), "https://x/").first().value
    assert "https://x/archive-thumbs/a.b.webp" in card and "i&lt;" in card and "Nog geen" in card and "t, u" in card and "&quot;q&quot;" in card
    lines = [x.value for x in publish.suggestions(spark.createDataFrame([("t2", "L", None, "r: 1"), ("t1", 'a "b"', "high", "")], "topicId string, label string, confidence string, reason string")).collect()]
    assert lines[0] == '  "t1":\n    label: "a \\"b\\""\n    confidence: "high"\n    reason: ""' and '"r: 1"' in lines[1]
    found = documents.candidates_from_yaml("# c\ncandidates:\n  - id: merel\n    label: 'Merel' # bird\n    aliases: [merel, \"merels\"]\n  - id: kip\n    aliases:\n      - kip\n      - kippen\n")
    assert found == [{"id": "merel", "label": "Merel", "aliases": ["merel", "merels"]}, {"id": "kip", "aliases": ["kip", "kippen"]}]


def test_backends():
    def fails():
        raise ImportError("no module")

    assert scoring.first_available({"a": fails, "b": lambda: "B"}) == ("b", "B") and scoring.first_available({"a": fails, "b": lambda: "B"}, "b")[0] == "b"
    with pytest.raises(ImportError):
        scoring.first_available({"a": fails}, "a")
    with pytest.raises(RuntimeError, match="a: no module"):
        scoring.first_available({"a": fails})


def test_clusters_of_categories(spark):
    r = np.random.default_rng(3)
    rows = [(c, i, 1000 - i, (np.eye(5)[i % k] + r.normal(0, 0.01, 5)).tolist()) for c, n, k, at in (("x", 60, 3, 0), ("y", 90, 4, 100), ("z", 5, 1, 300)) for i in range(at, at + n)]
    df = spark.createDataFrame(rows, "category string, id int, pos int, v array<double>")
    got = {x.id: x.label for x in cluster.category_clusters(df, "category", "id", "v", "pos").collect()}
    single = {c: cluster.agglomerative(df.where(F.col("category") == c), "category", "pos", "v").collect() for c in "xyz"}
    begin, seen = 0, []
    for c in "yxz":  # by size
        first: dict = {}
        for x in sorted(single[c], key=lambda x: x.pos):
            first.setdefault(x.label, begin + len(first))
            assert got[1000 - x.pos] == first[x.label]
        begin += len(first)
        seen.append(len(first))
    assert seen[2] == 1 and min(seen[:2]) > 1


def test_skewed_clusters_go_to_kmeans(spark):
    random.seed(1)
    rows = spark.createDataFrame([(i, [float(i % 13), float(i // 13 % 3)]) for i in range(390)], "id int, v array<double>")
    even, skewed = rows.select("id", (F.col("id") % 10 - 1).alias("label")), rows.select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 10).alias("label"))
    assert cluster.usable_clusters(even, "label") and not cluster.usable_clusters(skewed, "label") and not cluster.usable_clusters(even.where("label < 7"), "label")
    assert {x.label for x in cluster.clusters_or_kmeans(rows, "id", "v", even).collect()} == set(range(-1, 9))
    assert cluster.clusters_or_kmeans(rows, "id", "v", skewed).select("label").distinct().count() in range(10, 15)
