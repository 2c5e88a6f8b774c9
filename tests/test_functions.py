from pyspark.sql import functions as F

from stratalog.functions import dates, scalars, spam, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items()) or "none int"
    row = tuple(v[1] for v in values.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_dates(spark):
    rows = [("07-03-2008", "09:05", 3), ("bad date", None, None), ("30-11--0001", "", 12), ("op 31-02-2007", None, 6)]
    got = spark.createDataFrame(rows, "d string, t string, m int").select(dates.iso_text(F.col("d"), F.col("t")).alias("iso"), dates.season(F.col("m")).alias("s")).withColumn("ts", dates.parsed(F.col("iso"))).collect()
    assert [x.iso for x in got] == ["2008-03-07T09:05:00", "", "", "2007-02-31"]
    assert [x.s for x in got] == ["lente", "winter", "winter", "zomer"]
    assert [x.ts is None for x in got] == [False, True, True, True]


def test_date_labels(spark):
    v = {"v": ("string", "2008-03-07T09:05:00")}
    c = F.col("v")
    assert one(spark, dates.long_label(c), **v) == "07 maart 2008"
    assert one(spark, dates.day_label(c), **v) == "7 mrt"
    assert one(spark, dates.month_key(c), **v) == "m-2008-03"
    assert one(spark, dates.month_label(dates.month_key(c)), **v) == "maart 2008"
    assert one(spark, dates.short_month_label(dates.month_key(c)), **v) == "mrt"
    assert one(spark, dates.date_time_label(c, F.lit("")), **v) == "07 maart 2008 · 09:05"
    assert one(spark, dates.month_label(F.lit("m-ongedateerd"))) == "Datum onbekend"
    assert one(spark, dates.year_label(dates.year_key(F.lit("nonsense")))) == "Geen datum"
    assert one(spark, dates.long_label(F.lit("ergens"))) == "ergens"
    assert one(spark, dates.gallery_month_key(F.lit(2008), F.lit(3))) == "2008-03"
    assert one(spark, dates.gallery_month_key(F.lit(0), F.lit(3))) == "unknown"
    assert str(one(spark, dates.prefix_date(F.lit("07-03-2008 x")))) == "2008-03-07"
    assert str(one(spark, dates.parse_any(F.lit("x"), F.lit("07/03/2008")))) == "2008-03-07 00:00:00"
    assert one(spark, dates.weekday(F.lit("2008-03-07").cast("date"))) == 5


def test_text(spark):
    t = F.lit
    assert one(spark, text.squeeze(t(" a \n b "))) == "a b"
    assert one(spark, text.plain_text(t("<style>x</style>a&nbsp;<b>b</b>&amp;c<!-- d -->"))) == "a b &c"
    assert one(spark, text.plain_text(t("&eacute;&amp;lt;"), exact=True)) == "é<"
    assert one(spark, text.metadata_text(t("<p> </p>"), t("none"))) == "none"
    assert one(spark, text.excerpt(t("one two three"), 9)) == "one two…"
    assert one(spark, text.excerpt(t("onetwothree"), 5)) == "onetw…"
    assert one(spark, text.metadata_excerpt(t("een twee drie, vier vijf"), 16)) == "een twee drie…" and one(spark, text.metadata_excerpt(t("eenheellangwoord en"), 10)) == "eenheella…"
    assert one(spark, text.short_label(t("abcdef"), 4)) == "abc…"
    assert one(spark, text.author_text(t("Tekst Reacties 01-02-2008 meer"))).strip() == "Tekst"
    assert one(spark, text.author_text(t("Tekst cheap shoes\nmeer"), spam_tail=True)) == "Tekst "
    assert one(spark, text.sentences(t("Een. Twee! drie? Vier"))) == ["Een.", "Twee! drie?", "Vier"]
    assert one(spark, text.topic_tokens(t("De Appel, een peer en l’été"))) == ["appels", "peren", "l'été"]
    assert one(spark, text.word_count(t("l'été, twee - 3"))) == 3
    assert one(spark, text.slug(t("Écoles & Zo!"))) == "ecoles-en-zo"
    assert one(spark, text.latin_slug(t("Écoles & Zo!"))) == "écoles-zo"
    assert one(spark, text.snippet(t("x" * 200 + " needle " + "y" * 400), ["needle"])).startswith("…")
    assert one(spark, text.highlight(t("Een boom"), ["boom"])) == "Een <mark>boom</mark>"
    assert one(spark, text.caption_range(t("1 & 2 bloemen"))) == (1, 2)
    assert one(spark, text.caption_range(t("1-3 bloemen"))) == (1, 3)
    assert one(spark, text.caption_range(t("bloemen"))) is None
    assert one(spark, text.title_case_list(t("fruit, tuin"))) == "Fruit, Tuin"
    assert one(spark, text.part_label(F.lit(0), F.lit(3))) == "Deel 1 van 3"
    assert [tuple(x) for x in one(spark, text.html_parts(t("a<img src='x'>b")))] == [("text", "a"), ("image", "<img src='x'>"), ("text", "b")]
    assert one(spark, text.token_prefix(text.words(t("een boom")), text.words(t("een boom groeit"))))
    assert one(spark, text.nfkd(t("éèﬁ"))) == "eefi"
    broken = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert one(spark, text.repair_encoding(F.col("v")), v=("string", broken)) == "é"
    assert not one(spark, text.meaningful(t("?")))


def test_urls(spark):
    t = F.lit
    for path, want in (("/posts/1/", "/base/posts/1/"), ("/base/x", "/base/x"), ("https://a.b/c", "https://a.b/c"), ("data:image/png;base64,x", "data:image/png;base64,x")):
        assert one(spark, urls.site_path(t(path), "/base")) == want
    assert one(spark, urls.download_name(t("/images/a%20b.jpg?x=1"), t("k"))) == "a b.jpg"
    assert one(spark, urls.download_name(t(""), t("k"))) == "k.jpg"
    assert one(spark, urls.url_path(t("https://a.b/c%20d?e#f"))) == "/c d"
    assert one(spark, urls.thumbnail(t("/archive-images/x/y.jpg?v=1"), 240)) == "/archive-thumbs-240/x/y.webp?v=1" and one(spark, urls.thumbnail(t("/archive-thumbs-240/y.webp"), 96)) == "/archive-thumbs-96/y.webp"
    assert one(spark, urls.post_file_id(t("x/archief.php?ID=123.html"))) == "123" and one(spark, urls.reaction_file_id(t("reageer.php?postID=9.html"))) == "9"
    hosts = (r"img\.host\.example", r"blog\.host\.example")
    for src, want in (("https://img.host.example/a/b.jpg", "/archive-images/a/b.jpg"), ("http://blog.host.example/img.host.example/b.jpg", "/archive-images/b.jpg"), ("../../img.host.example/b.jpg", "/archive-images/b.jpg"), ("b.PNG", "/archive-images/tuin/b.PNG"), ("data:image/gif;x", None), ("/Images/Skin/a.gif", None), ("https://other.example/b.jpg", None), ("", None)):
        assert one(spark, urls.local_image(t(src), t("tuin"), *hosts)) == want
    for href, want in (("archief.php?ID=12", "/posts/tuin-12/"), ("x/reageer.php%3FpostID%3D7", "/posts/tuin-7/#reactions"), ("img.host.example/c.jpg", "/archive-images/c.jpg"), ("https://other.example/", "https://other.example/")):
        assert one(spark, urls.local_link(t(href), t("tuin"), *hosts)) == want
    assert one(spark, urls.rewrite_assets(t('<img src = "/archive-images/a.jpg"><a href=/archive-images/b>'), "https://cdn.example")) == '<img src="https://cdn.example/archive-images/a.jpg"><a href=https://cdn.example/archive-images/b>'


def test_scalars(spark):
    t = F.lit
    assert one(spark, scalars.tag_list(t("b, a;b"))) == ["a", "b"]
    assert one(spark, scalars.canonical_json(t('{"b": 1, "a": [1, {"d": 2, "c": 3}]}'))) == '{"a":[1,{"c":3,"d":2}],"b":1}'
    assert one(spark, scalars.loose_json(t('text ```json\n{"a": 1}\n```'), "a int")).a == 1
    assert one(spark, scalars.loose_json(t('so: {"a": 2} end'), "a int")).a == 2
    assert one(spark, scalars.loose_json(t("none"), "a int")) is None
    assert one(spark, scalars.slideshow_seconds(t(float("nan")))) == 5 and one(spark, scalars.slideshow_seconds(t(99.0))) == 30
    assert one(spark, scalars.numeric_entries(F.create_map(t("a"), t("1"), t("b"), t("x")))) == {"a": 1.0}
    assert [x.key for x in one(spark, scalars.top_entries(F.create_map(t("a"), t(1.0), t("b"), t(3.0)), 1))] == ["b"]
    assert one(spark, scalars.split_scoped_key(scalars.scoped_key(t(3), t("tag")))) == (3, "tag")
    assert one(spark, scalars.string_seed(t("ab"))) == (97 * 31 + 98) % 9973
    assert one(spark, scalars.average(t(1), t(0))) == 0 and one(spark, scalars.columns_for_width(t(800))) == 4
    assert one(spark, scalars.ordered_union(F.array(t("b"), t("a")), F.array(t("a"), t("c")))) == ["b", "a", "c"]


def test_spam(spark):
    rows = [
        ("Nice", "x", "<a href='http://a.com'>a</a> buy cheap jerseys", "", True),
        ("Hello", "jan", "casino online", "", True),
        ("t", "u", '<a href="https://x.example">x</a> www.other.com', "", True),
        ("Mooie foto", "Piet", "Wat een prachtige bloemen in jouw tuin dit jaar", "07-03-2008", False),
        ("Groeten", "An", '<a href="https://blog.own.example/1">eigen</a> tot morgen op de wandeling', "2019", False),
        (None, None, None, None, False),
        ("Great", "Bob Longname", "nice post", "2022", True),
        ("Great", "Bob Longname", "nice post", "2019", False),
    ]
    got = spark.createDataFrame(rows, "title string, author string, html string, date string, want boolean").withColumn("got", spam.is_spam(F.col("title"), F.col("author"), F.col("html"), F.col("date"), r"own\.example")).collect()
    assert [x.got for x in got] == [x.want for x in got]
