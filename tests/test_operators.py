import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import dates
from stratalog.operators import checks, cluster, gallery, ranking, scoring, search, series, species, stats, tags, vectors
from stratalog.plans.query_specs import ArchiveQuery, AtlasQuery, GalleryQuery, SearchQuery
from stratalog.sources import documents, sinks


def test_series_and_units(spark):
    posts = spark.createDataFrame([("1", "a", "A", 1), ("2", "b", "B", 2), ("3", "c", "C", 4)], "id string, slug string, title string, imageCount int")
    found = spark.createDataFrame([("s", ["2", "1"])], "id string, postIds array<string>")
    units = {x.unit_id: x for x in series.units(found, posts).collect()}
    assert units["s"].post_ids == ["2", "1"] and units["s"].title == "B" and units["s"].image_count == 3 and units["post-3"].post_ids == ["3"]
    checks.enforce(checks.series_rules(found, posts))
    bad = spark.createDataFrame([("s", ["1"]), ("t", ["9", "2"]), ("u", ["2", "3"])], "id string, postIds array<string>")
    assert {x.check for x in checks.series_rules(bad, posts).collect()} == {"short series", "unknown member", "member of two series"}
    with pytest.raises(checks.CheckFailed):
        checks.enforce(checks.series_rules(bad, posts))
    parts = spark.createDataFrame([("s", 1, ["b", "c"], 2), ("s", 0, ["a", "b"], 1)], "k string, pos int, images array<string>, n int")
    got = series.aggregate(parts, "k", "pos", ["n"], {"ns": F.col("n")}, {"images": F.col("images")}).first()
    assert got.images == ["a", "b", "c"] and got.ns == [1, 2] and got.n == 3


def test_chronology(spark):
    rows = [("b", "2007-02-01", ""), ("a", "2006-01-05", ""), ("c", "2007-03-09T10:00:00", ""), ("d", "nonsense", "x"), ("é", "2006-01-05", "")]
    items = spark.createDataFrame(rows, "title string, isoDate string, date string").withColumn("v", dates.date_text(F.col("isoDate"), F.col("date")))
    assert [x.title for x in series.newest_first(items, F.col("v")).collect()] == ["c", "b", "a", "é", "d"]
    groups = {x.month_key: x for x in series.chronology(items, F.col("v")).collect()}
    assert (groups["m-2007-03"].first_index, groups["m-2007-03"].starts_year) == (0, True)
    assert (groups["m-2007-02"].n, groups["m-2007-02"].starts_year) == (1, False)
    assert groups["m-ongedateerd"].first_index == 4


def test_even_spread(spark):
    rows = spark.createDataFrame([("u", i) for i in range(30)] + [("v", i) for i in range(5)], "u string, pos int")
    got = series.even_spread(rows, ["u"], "pos", 12).collect()
    assert sorted(x.pos for x in got if x.u == "u") == [round(i * 29 / 11) for i in range(12)] and sum(x.u == "v" for x in got) == 5


def test_round_robin_takes_rare_strata(spark):
    rows = spark.createDataFrame([(f"r{i}", "rare") for i in range(2)] + [(f"c{i}", "common") for i in range(10)], "id string, t string")
    got = [x.id for x in series.round_robin(rows, "t", ["id"], 5).collect()]
    assert {"r0", "r1"} <= set(got) and len(got) == 5


@pytest.mark.parametrize("buckets", [2, 256])
def test_global_rank(spark, buckets):
    r = random.Random(3)
    rows = [(i, r.choice([None, 1.0, 2.0, 2.5, -3.0, 9.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    for descending in (False, True):
        want = [i for i, _ in sorted(rows, key=lambda x: (x[1] is None, (-x[1] if descending else x[1]) if x[1] is not None else 0, x[0]))]
        assert [x.id for x in ranking.global_rank(df, F.col("v"), ["id"], "rank", descending, buckets).orderBy("rank").collect()] == want
    assert ranking.global_rank(df.limit(0), F.col("v"), ["id"], "rank").collect() == []
    assert tuple(ranking.around(df.where("v is not null"), F.struct("v", "id"), "id", -1).first()) == (None, None)


def test_viewport_rows(spark):
    rows = spark.createDataFrame([(0, 0.0, 500.0, "2020"), (1, 500.0, 500.0, "2019")], "index int, start double, size double, year string")
    assert series.active_at(rows, 560).first().year == "2019" and series.active_at(rows, 9999).first().year == "2019"


def test_longest_streak_takes_the_earliest(spark):
    days = spark.createDataFrame([("u", f"2024-01-{d:02d}") for d in (1, 2, 5, 6, 9)], "u string, d string").select("u", F.to_date("d").alias("ad"))
    got = stats.longest_streak(days, ["u"]).first()
    assert (got.days, str(got.first_day)) == (2, "2024-01-01")
    gap = stats.longest_gap(days, ["u"]).first()
    assert (gap.days, str(gap.first_day), str(gap.last_day)) == (2, "2024-01-03", "2024-01-04")


def test_query_specs():
    for spec in (GalleryQuery("appel boom", "fruit", "appel", "2008", "lente", True, False, "img-1"), AtlasQuery("natuur", "2007", "zomer", True, "x y", "p", "c"), ArchiveQuery("topic-03"), SearchQuery("é b", "fruit")):
        assert type(spec).from_query_string(spec.to_query_string()) == spec
    assert AtlasQuery.from_query_string("?topic=a&year=20x8&season=nope") == AtlasQuery("a")
    assert ArchiveQuery.from_query_string("topic=a&category=b").category == "b"
    assert not SearchQuery("a").runs() and SearchQuery("ab").runs()
    assert not GalleryQuery().active() and GalleryQuery(theme="x").active()


def test_gallery(spark):
    rows = [("a", "Appel", 2008, "lente", ["fruit"], "k1", 0), ("b", "Berg", 2008, "lente", ["wolken"], "k1", 1), ("c", "Appel", 2007, "zomer", ["fruit", "familie"], "k2", 2)]
    images = spark.createDataFrame(rows, "id string, postTitle string, year int, season string, visualTags array<string>, visualClusterId string, pos int")
    species_ = spark.createDataFrame([("a", "appel", "Appel"), ("c", "peer", "Peer")], "image_id string, candidate_id string, label string")
    ids = lambda q, s=None: sorted(x.id for x in gallery.filter_images(images, GalleryQuery.from_query_string(q), s).collect())
    assert ids("q=appel&year=2008") == ["a"] and ids("peoplePlants=1") == ["a", "c"] and ids("species=peer", species_) == ["c"] and ids("q=PEER", species_) == ["c"] and ids("") == ["a", "b", "c"]
    direct = spark.createDataFrame([("c", 0), ("zz", 1)], "id string, pos int")
    assert [x.id for x in gallery.related(images, direct, "a").collect()] == ["c", "b"]


def test_atlas(spark):
    rows = [("a", ["natuur"], "t", 2007, "lente", 1, "Een", "x", 0.2, 0.5), ("b", ["fruit"], "t", 2008, "zomer", 0, "Twee", "y", 0.5, 0.5), ("c", None, "natuur", 2008, "zomer", 2, "Drie", "een", 0.99, 1.0)]
    points = spark.createDataFrame(rows, "id string, categoryIds array<string>, topicId string, year int, season string, imageCount int, title string, excerpt string, x double, y double")
    ids = lambda q: sorted(x.id for x in gallery.filter_points(points, AtlasQuery.from_query_string(q)).collect())
    assert ids("category=natuur") == ["a", "c"] and ids("images=1&q=EEN") == ["a", "c"] and ids("year=2008&season=zomer&category=fruit") == ["b"]
    assert [x.id for x in gallery.viewport(points, 0.4, 0.6, 0.4, 0.6).collect()] == ["b"]
    assert gallery.viewport(points, 0, 1, 0, 1).count() == 3 and gallery.viewport(points, 0.9, 1.0, 0.9, 1.0).count() == 1
    assert gallery.viewport_bounds(100, 50, 1, 0, 0) == (0.0, 1.0, 0.0, 1.0)
    peaks = spark.createDataFrame([("t", 5, 0.1, 0.1), ("t", 4, 0.11, 0.1), ("t", 3, 0.5, 0.5), ("t", 2, 0.9, 0.9)], "topic string, n int, x double, y double")
    assert sorted(x.n for x in gallery.suppress_peaks(peaks, "topic", 0.1, 2).collect()) == [3, 5]


def test_tags(spark):
    taxonomy = [{"label": "A", "visual": {"v"}, "text": {"een", "twee drie"}}, {"label": "B", "visual": set(), "text": {"vier"}}]
    rows = spark.createDataFrame([("een twee drie", ["een", "twee", "drie"], []), ("vier vier", ["vier", "vier"], []), ("x", ["x"], ["v"]), ("een", ["een"], [])], "t string, w array<string>, v array<string>")
    assert [x.c for x in rows.select(tags.rule_category(F.col("t"), F.col("w"), F.col("v"), taxonomy).alias("c")).collect()] == ["A", "B", "A", "Overig"]
    assert [x.c for x in rows.select(cluster.topic_label(F.col("w"), F.col("v"), taxonomy).alias("c")).collect()] == [None, None, "A", None]
    rule = tags.family_rule(F.lit(0.7), F.lit("familie"), F.lit("Feest bij oma"), F.lit(""))
    assert spark.range(1).select(rule.alias("x")).first().x and not spark.range(1).select(tags.family_rule(F.lit(0.6), F.lit("familie"), F.lit("Feest"), F.lit("")).alias("x")).first().x
    merged = cluster.merge_terms(F.lit("Label"), F.array(F.lit("dag"), F.lit("appels")), F.array(F.lit("mensen"), F.lit("kip")), ["dag"], ["mensen"])
    assert spark.range(1).select(merged.alias("x")).first().x == ["Label", "appels", "kip"]


def test_search_blocks_and_ranking(spark):
    first = " ".join(f"Zin {i} heeft enkele woorden erin." for i in range(60))
    docs = spark.createDataFrame([(1, first), (2, "Kort."), (3, None), (4, "Appelboom in de tuin.")], "id int, text string")
    blocks = search.block_table(docs, "id", "text").collect()
    own = [x.block for x in sorted(blocks, key=lambda x: x.block_index) if x.id == 1]
    assert all(len(b) <= 950 for b in own) and len(own) > 1
    assert own[1].startswith(own[0][own[0].rindex("Zin ") :])
    assert [x.block for x in blocks if x.id == 2] == ["Kort."]
    rows = spark.createDataFrame([(1, "Appelboom", "een tekst over een tuin"), (2, "Tuin", "de appel valt"), (3, "Zee", "golven")], "id int, title string, block string")
    index = search.postings(rows, "id", {"title": "title", "block": "block"})
    assert {x.id for x in search.search(index, "id", ["appel"]).collect()} == {1, 2}
    assert {x.id for x in search.search(index, "id", ["appel", "tuin"]).collect()} == {1, 2}
    assert {x.id for x in search.search(index, "id", ["golvn", "xxxx"]).collect()} == {3}  # the loose search
    hits = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 1.0)], "post int, pos int, score double")
    assert [(x.post, x.pos) for x in search.best_per_post(hits, "post", "pos", 40).collect()] == [(1, 0), (2, 0)]


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_exact_neighbours(spark, block_rows):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-sim[i, j], j))[:5]}
    assert {(x.key, x.neighbour) for x in vectors.neighbours(rows, "id", "v", 5, block_rows=block_rows).collect()} == want


def test_vector_checks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])], "id int, v array<double>")
    assert sorted(x.id for x in vectors.invalid_vectors(rows, "v").collect()) == [2, 3, 4, 5]
    answer = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (2, [])], "index int, embedding array<double>")
    assert {x.check for x in checks.embedding_rules(answer, 3).collect()} == {"duplicate id", "missing on the left", "vector"}


def test_agglomerative(spark):
    r = random.Random(2)
    rows = [("b", i, [1.0 if i % 3 == k else r.random() * 0.05 for k in range(3)]) for i in range(30)]
    got = cluster.agglomerative(spark.createDataFrame(rows, "bucket string, id int, v array<double>"), "bucket", "id", "v", wanted=3).collect()
    groups = {frozenset(x.id for x in got if x.label == k) for k in {x.label for x in got}}
    assert groups == {frozenset(range(k, 30, 3)) for k in range(3)}


def test_average_links_equal_greedy_merges():
    r = np.random.default_rng(3)
    for n in (2, 11, 40, 70):
        v = r.normal(size=(n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        links = cluster._links(v)
        for limit in (0.0, 0.05, 0.28, 0.43, 0.68, 2.5):
            groups = [[i] for i in range(n)]
            mean = lambda a, b: np.mean([1 - v[i] @ v[j] for i in a for j in b])
            while len(groups) > 1:
                least, i, j = min((mean(a, b), i, j) for j, b in enumerate(groups) for i, a in enumerate(groups[:j]))
                if least >= limit:
                    break
                groups[i] += groups.pop(j)
            label = cluster._cut(*links, limit)
            assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == {frozenset(g) for g in groups}


def test_agglomerative_is_one_method_at_every_size(spark):
    r = np.random.default_rng(4)
    centers = np.eye(14)[:12]
    rows = []
    for bucket, n in (("large", 2400), ("small", 600), ("few", 9)):  # the sought number of clusters is 18, 14 and 1
        rows += [(bucket, i, (centers[i % 12 if bucket == "large" and i > 40 else i % 11] + r.normal(0, 0.03, 14)).tolist()) for i in range(n)]
    got = cluster.agglomerative(spark.createDataFrame(rows, "bucket string, id int, v array<double>"), "bucket", "id", "v").collect()
    groups = lambda bucket: {frozenset(x.id for x in got if x.bucket == bucket and x.label == k) for k in {x.label for x in got if x.bucket == bucket}}
    assert groups("small") == {frozenset(range(k, 600, 11)) for k in range(11)} and groups("few") == {frozenset(range(9))}
    assert groups("large") == {frozenset(i for i in range(2400) if (i % 12 if i > 40 else i % 11) == k) for k in range(12)}


def test_projection_of_the_default_size_equals_brute_force(spark):
    g = vectors.directions(np.arange(-2000, 2000), 384)
    assert abs(g.mean()) < 0.01 and abs(g.std() - 1) < 0.01 and abs(np.corrcoef(g[:40])[np.triu_indices(40, 1)]).max() < 0.3
    r = random.Random(5)
    rows = [(k, f"t{r.randrange(1500)}") for k in range(30) for _ in range(60)]
    weights = vectors.tfidf(spark.createDataFrame(rows, "k long, term string"), "k")
    found = {x.k: np.array(x.vector) for x in vectors.random_projection(weights, "k").collect()}
    want: dict = {}
    for x in weights.select("k", "weight", F.xxhash64("term", F.lit(42)).alias("h")).collect():
        want[x.k] = want.get(x.k, 0) + x.weight * vectors.directions(np.array([x.h]), 384)[0]
    assert set(found) == set(range(30)) and all(np.allclose(found[k], v / np.linalg.norm(v)) for k, v in want.items())


def test_tfidf_queries_have_the_operators_defaults(spark, tmp_path):
    from stratalog.plans import catalog

    name = lambda n: "".join("abcdefghij"[int(c)] for c in f"{n:04d}")
    rows = [(k, "s", " ".join(name(n) for n in range(10 * k, 10 * k + 12))) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["tfidf_projection"](spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(range(120)) and {len(x.vector) for x in got} == {384}
    assert catalog.QUERIES["tfidf_weights"](spark, str(tmp_path)).count() == 120 * 12


def test_species(spark):
    fields = spark.createDataFrame([(1, "title", "De Merel zingt"), (1, "post_text", "een merels en een kip"), (2, "post_text", "cheap shoes merel"), (3, "post_text", "merelachtig")], "key int, field string, text string")
    candidates = spark.createDataFrame([("merel", "Merel", "bird_species", ["merel", "merels"]), ("kip", "Kip", "animal_group", ["kip", "ab"])], "candidate_id string, label string, type string, aliases array<string>")
    got = {(x.key, x.candidate_id): x for x in species.merged(species.alias_hits(fields, candidates), candidates).collect()}
    assert set(got) == {(1, "merel"), (1, "kip")} and got[1, "merel"].confidence == "high" and got[1, "kip"].confidence == "medium" and got[1, "merel"].sources == ["post_text", "title"]


def test_scoring_resumes_and_counts_costs(spark):
    calls = []

    class Stub:
        def score(self, payloads):
            calls.append(len(payloads))
            return [{"t": 0.5} for _ in payloads], 0.001 * len(payloads)

    units = spark.createDataFrame([(f"u{i}", i, "x" * 10) for i in range(3)], "unit_id string, pos int, payload string")
    empty = spark.createDataFrame([], "unit_id string, payload_hash string, tag_id string, score double")
    scores, ledger, spent = scoring.score_units(units, empty, Stub, 2, 100, 1.0)
    assert calls == [2, 1] and abs(spent - 0.003) < 1e-9 and scoring.ledger_total(ledger.union(ledger)).first().total == 0.003
    scoring.score_units(units, scores, Stub, 2, 100, 1.0)
    assert calls == [2, 1]
    scoring.score_units(units, empty, Stub, 1, 100, 0.0015)
    assert calls == [2, 1, 1, 1]
    with pytest.raises(Exception, match="size limit"):
        scoring.score_units(units, empty, Stub, 2, 5, 1.0)
    with pytest.raises(checks.CheckFailed):
        checks.require_limits(None, True)


def test_rules(spark):
    vocabulary = spark.createDataFrame([("ok", "l", "q", 0.5), ("Not ok", "l", "q", None), ("dup", "l", "q", None), ("dup", "", "q", 2.0)], "id string, label string, question string, threshold double")
    assert {x.check for x in checks.vocabulary_rules(vocabulary).collect()} == {"id is not snake case", "blank text", "threshold outside of (0, 1)", "duplicate id"}
    mapping = spark.createDataFrame([("c", "ok"), ("overig", "what")], "category_id string, tag_id string")
    assert {x.check for x in checks.mapping_rules(mapping, vocabulary).collect()} == {"unknown tag", "reserved category", "tag without category"}
    scores = spark.createDataFrame([("u", "t", 1.5, 0.0), ("v", "t", 0.5, -1.0)], "unit_id string, tag_id string, score double, cost double")
    assert {x.check for x in checks.score_rules(scores).collect()} == {"score outside of 0..1", "cost"}


def test_sources(spark, tmp_path):
    (tmp_path / "md" / "deep").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text('---\ntitle: "Een: titel"\ndate: 2008-03-07\n---\nTekst\x01 hier\n')
    (tmp_path / "md" / "deep" / "b.md").write_text("zonder kop")
    (tmp_path / "page.html").write_text("<html><title> Mijn\n blad </title><body>x<script>y</script></body></html>")
    md = documents.read_markdown(spark, str(tmp_path / "md")).collect()
    assert md[0].meta == {"title": "Een: titel", "date": "2008-03-07"} and md[0].body == "Tekst hier\n" and md[1].meta == {} and md[1].body == "zonder kop"
    page = documents.read_html(spark, str(tmp_path)).first()
    assert page.title == "Mijn blad" and page.plain == "Mijn blad x"
    images = spark.createDataFrame([("<figure><img src='a' alt='x'><figcaption>1 &amp; 2</figcaption></figure><img src='a'>",)], "h string").select(documents.html_images("h").alias("i")).first().i
    assert [(x.src, x.alt, x.caption) for x in images] == [("a", "x", "1 & 2"), ("a", "", "")]
    clean = spark.createDataFrame([("<form>x</form><span>y</span><p></p><p onclick='z'>ok<br></p><a href='javascript:x'>l</a>",)], "h string").select(documents.sanitize_html("h").alias("i")).first().i
    assert clean == "y<p>ok<br></p><a>l</a>"
    posts, reactions = spark.createDataFrame([("a", "A")], "slug string, title string"), spark.createDataFrame([("a", 1, "q"), ("a", 0, "p"), ("b", 0, "r")], "slug string, pos int, text string")
    merged = {x.slug: x for x in documents.merge_reactions(posts, reactions).collect()}
    assert [r.text for r in merged["a"].reactions] == ["p", "q"] and merged["b"].title is None and merged["b"].reaction_count == 1
    chunks = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "id string, chunk int, v string")
    assert {x.id: x.v for x in documents.merge_chunks(chunks, "id", "chunk").collect()} == {"a": "new", "b": "x"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2008, None), ("b", 0, "2007-01-01"), ("c", None, "x")], "id string, year int, d string")
    dated = sinks.with_year(rows, F.col("year"), F.coalesce("d", F.lit("")))
    manifest = sinks.write_year_chunks(dated, str(tmp_path / "out"), "id")
    assert [(x.year, x.n) for x in manifest.collect()] == [("unknown", 1), ("2008", 1), ("2007", 1)]
    assert spark.read.json(str(tmp_path / "out" / "chunks")).count() == 3
    sinks.write_both(rows, str(tmp_path / "full"), str(tmp_path / "public"), ["d"])
    assert spark.read.parquet(str(tmp_path / "public")).columns == ["id", "year"]
    assert [x.value for x in sinks.as_json(rows.limit(1).select("year", "id")).collect()] == ['{"id":"a","year":2008}']
