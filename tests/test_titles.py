from stratalog.functions.titles import strip_title, without_title

PAIRS = [
    ("<p><strong>Rode Bessen</strong></p><p>Tekst volgt.</p>", "Rode bessen", "<p>Tekst volgt.</p>"),
    ("<p><b>Een lange titel</b></p><p><em>in stukken</em></p><p>Tekst.</p>", "Een lange titel in stukken", "<p>Tekst.</p>"),
    ("<p><b>Kort </b> met staart &amp; meer</p><p>Tekst.</p>", "Kort", "<p>met staart &amp; meer</p><p>Tekst.</p>"),
    ("<p><b>Een lange titel</b></p><p><b>in stukken</b>: en verder</p><p>T.</p>", "Een lange titel in stukken", "<p>en verder</p><p>T.</p>"),
    ("<p>Gewone tekst over bessen.</p>", "Rode bessen", "<p>Gewone tekst over bessen.</p>"),
    ("<div>\n\n<p>Étang</p>\n\n<p>Tekst <b>vet</b>.</p>\n\n</div>", "etang", "<div>\n\n\n\n<p>Tekst <b>vet</b>.</p>\n\n</div>"),
    ('<p><img src="/a.jpg"></p><p><b>Titel</b></p>', "Titel", '<p><img src="/a.jpg"></p><p><b>Titel</b></p>'),
    ("los <p><b>Titel</b></p>", "Titel", "los <p><b>Titel</b></p>"),
    ("<h2>Titel</h2>", "Titel", ""),
    (None, "Titel", None),
    ("<p>x</p>", "", "<p>x</p>"),
]


def test_titles(spark):
    assert [strip_title(h, t) for h, t, _ in PAIRS] == [want for _, _, want in PAIRS]
    got = spark.createDataFrame([(i, h, t) for i, (h, t, _) in enumerate(PAIRS)], "i int, h string, t string").select("i", without_title("h", "t").alias("x")).orderBy("i").collect()
    assert [x.x for x in got] == [want for _, _, want in PAIRS]
