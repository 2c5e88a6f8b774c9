from pyspark.sql import functions as F

from stratalog.operators import images, publish
from stratalog.sources.documents import html_images
from stratalog.streaming import activity


def test_related_and_categories(spark):
    units = spark.createDataFrame([("s", ["a", "b"]), ("post-c", ["c"])], "unit_id string, post_ids array<string>")
    near = spark.createDataFrame([("s", "post-c", 1), ("post-c", "s", 1)], "key string, neighbour string, rank int")
    related = publish.related_posts(units, near)
    assert {x.post_id: x.related for x in related.collect()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a"]}
    posts = spark.createDataFrame([("a", ["x"]), ("b", ["y", "x"])], "id string, categoryIds array<string>")
    assert {x.unit_id: x.category_ids for x in publish.member_categories(posts, units).collect()} == {"s": ["x", "y"], "post-c": []}
    assert [x.id for x in publish.resolved(related.where("post_id = 'a'"), posts).collect()] == ["b"]


def test_images(spark):
    posts = spark.createDataFrame([("p", 0, ["/i/a.jpg", None, "/i/b.jpg"]), ("q", 1, ["/i/a.jpg"])], "id string, pos int, images array<string>")
    rows = images.image_records(posts)
    assert sorted((x.post_id, x["index"], x.src) for x in rows.collect()) == [("p", 0, "/i/a.jpg"), ("p", 2, "/i/b.jpg"), ("q", 0, "/i/a.jpg")]
    assert [x.src for x in images.featured(posts.select("pos", F.filter("images", lambda x: x.isNotNull()).alias("images")), 5).collect()] == ["/i/a.jpg", "/i/b.jpg"]
    captions = spark.createDataFrame([("p", "1-3 bloemen"), ("q", "2 niets"), ("p", "los")], "post_id string, text string")
    assert images.caption_links(rows, captions).count() == 2
    html = spark.createDataFrame([("p", "<img src='/i/a.jpg' alt='Een roos'><img><img src='https://h.example/i/b.jpg' alt='?'>")], "post_id string, h string")
    found = html.select("post_id", F.explode(html_images("h")).alias("i")).select("post_id", "i.*")
    assert [(x.kind, x.text) for x in images.html_links(rows, found).collect()] == [("alt", "Een roos")]
    seen = spark.createDataFrame([("/i/a.jpg", "c", "m")], "src string, caption string, model string")
    assert images.observations(rows, seen).count() == 2 and images.uncaptioned(rows, seen).count() == 1


def test_labels_and_files(spark):
    names = publish.labels_from_yaml("# x\ntopic-01: 'Fruit'\ntopic-02: Tuin # groen\nempty:\n")
    assert names == {"topic-01": "Fruit", "topic-02": "Tuin"}
    rows = spark.createDataFrame([("topic-01", "a"), ("topic-03", "c")], "id string, label string")
    assert [x.label for x in publish.overridden(rows, "id", "label", names).collect()] == ["Fruit", "c"]
    files = publish.post_files(spark.createDataFrame([("1", "Één & twee", "2008-03-07", "tekst")], "id string, title string, isoDate string, cleanedText string"), ["id"]).first()
    assert files.name == "0001-een-en-twee.md" and files.value == '---\ntitle: "Één & twee"\nid: "1"\ndate: "2008-03-07"\n---\ntekst'
    order = spark.createDataFrame([("img10",), ("img9",), ("img010",)], "v string").orderBy(publish.natural_key(F.col("v")), "v")
    assert [x.v for x in order.collect()] == ["img9", "img010", "img10"]
    raw = spark.createDataFrame([('[{"b": 1, "a": 2}, {"c": 3}]',)], "value string")
    assert publish.dataset_columns(publish.dataset_rows(raw, "array"), ["c", "z"]) == ["c", "a", "b"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 5} 0{i % 7}:00:00", f"u{i % 3}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id int, t string, user string").select("event_id", F.to_timestamp("t").alias("ts"), "user")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = activity.read_events(spark, str(tmp_path / "in"), events.schema)
    for name, f in (("windows", lambda df: activity.tumbling_counts(df, "ts", ["user"])), ("sessions", lambda df: activity.sessions(df, "ts", ["user"]))):
        query = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {tuple(x) for x in spark.table(name).collect()}
        want = {tuple(x) for x in f(events).collect()}
        assert got == want if name == "windows" else got <= want
    done = activity.to_table(activity.first_by_id(stream, "event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "check"))
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
