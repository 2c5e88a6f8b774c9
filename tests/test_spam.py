"""The query spam_decisions against its SQL on rows that the tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog.functions import spam
from stratalog.plans import catalog

# what the SQL says of a turn: (role, text, spam)
EDGES = [
    ("user", "cosas de la ciónécondo", True),
    ("user", "Bäume im condoß heute", True),
    ("user", "tuin ere.inä", True),
    ("user", "a condo here", True),
    ("user", "a condominium here", False),
    ("user", "a cońdo here", False),
    ("user", "ein belgisch KÖRKORT", True),
    ("user", "jorſey or jerſey in town", True),
    ("user", "in town with Kors", False),
]
ODD = [
    ("user", "air\u000bmax for sale", False),
    ("user", "buy one\rhere online, see the page of a.com for all of its details", True),
    ("Karin\n", "wat een mooie tuin", False),
    (" Karin ", "wat een mooie tuin", True),
    ("user", "http://a.com\nmooie tuinen hier", True),
    ("user", "thanks &nbsp;&nbsp;&nbsp;&nbsp;&nbsp;&nbsp;", False),
    ("user", "<script>casino</script>", True),
    ("user", "eigen <a href='https://x.net/own.invalid'>een</a> <a href='https://x.net/own.invalid'>twee</a> <a href='https://x.net/own.invalid'>drie</a>", False),
    ("user", None, None),
    ("karin", None, True),
    (None, "mooie tuin", None),
    (None, "thanks", True),
]


@pytest.mark.parametrize("rows", [EDGES, ODD])
def test_spam_decisions(spark, tmp_path, rows):
    spark.createDataFrame([(i, 0, *r[:2]) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = {r[0]: r[2] for r in con.execute(catalog.ORACLES["spam_decisions"]).fetchall()}
    assert {i: (*rows[i][:2], x) for i, x in want.items()} == dict(enumerate(rows))
    assert {r.conv_id: r.spam for r in catalog.QUERIES["spam_decisions"](spark, str(tmp_path)).collect()} == want


def test_word_edges_of_comments(spark):
    rows = [("t", "Jan", "de écondo", True), ("t", "Jan", "de condominium", False), ("Mooi", "Jan Peeters", "ere.inä", True)]
    got = spark.createDataFrame(rows, "title string, author string, html string, want boolean").withColumn("got", spam.is_spam(F.col("title"), F.col("author"), F.col("html"), F.lit("2019"), r"own\.example")).collect()
    assert [x.got for x in got] == [x.want for x in got]
