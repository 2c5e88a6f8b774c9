"""Mirrored blog pages: posts and reactions of table layouts, reactions merged into posts.

A page holds tables whose title cell links to a post or to its reactions; the content cell stands in a
row below, with a signature line at its end, the date in a cell of the same table. Pages are parsed a
file at a time; all that follows (overrides, spam, merging, order) is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stratalog.functions import dates, spam, urls
from stratalog.functions.text import mojibake_repair
from stratalog.sources.documents import merge_reactions, sanitize_markup, whole_files

# Classes of cells, files that links lead to, and the line that signs a text.
TITLE, CONTENT, DAY = "post_titel", "bericht_content", "datum"
POST_FILE, REACTION_FILE = "archief.php", "reageer.php"
SIGNATURE = re.compile(r"(\d{2}-\d{2}-\d{4}),\s*(\d{2}:\d{2})\s+geschreven door\s+(.+)", re.IGNORECASE)
REACTIONS = re.compile(r"Reageer\s*\((\d+)\)", re.IGNORECASE)
UNTITLED, SIGNED = "Naamloos bericht", "geschreven door"
HIDDEN = {"script", "style", "link", "meta", "object", "embed", "iframe", "form", "input", "button", "textarea", "select", "xml"}

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
#: Open elements that a start tag ends, up to the nearest table.
_ENDS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def below(self) -> Iterator[Node]:
        for part in self.parts:
            if isinstance(part, Node):
                yield part
                yield from part.below()

    def all(self, tag: str, name: str = "") -> list[Node]:
        return [n for n in self.below() if n.tag == tag and (not name or name in n.attrs.get("class", "").split())]

    def text(self, without: tuple[str, ...] = ()) -> str:
        raw = "".join(p if isinstance(p, str) else p.text(without) if p.tag not in without else "" for p in self.parts)
        return " ".join(raw.split()) if self.tag == "td" else raw

    def inner(self) -> str:
        return "".join(escape(p, quote=False) if isinstance(p, str) else p.outer() for p in self.parts)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in _VOID else f"{self.inner()}</{self.tag}>")

    def nearest(self, tag: str) -> Node:
        at = self
        while at.up is not None and at.tag != tag:
            at = at.up
        return at


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, set())
        up = self.at
        while ends and up.up is not None and up.tag != "table":
            if up.tag in ends:
                self.at = up.up
            up = up.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.up is not None and up.tag != tag:
            if up.tag == "table":
                return
            up = up.up
        if up.up is not None:
            self.at = up.up

    def handle_data(self, data):
        self.at.parts.append(data)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _without_signatures(content: Node) -> Node:
    """``content`` without headings that sign it or are empty, and without what is never shown."""
    for node in [content, *content.below()]:
        node.parts = [p for p in node.parts if isinstance(p, str) or not (p.tag in HIDDEN or (p.tag == "h1" and (not _squeezed(p.text()) or SIGNED in p.text().lower())))]
    return content


def _entry(cell: Node) -> dict | None:
    """What the table of a title cell says; none without a content cell in a row below."""
    row, table = cell.nearest("tr"), cell.nearest("table")
    rows = [p for p in row.up.parts if isinstance(p, Node)] if row.up else []
    content = next((c for r in rows[rows.index(row) + 1 :] if r.tag == "tr" for c in r.all("td", CONTENT)), None) if row in rows else None
    if content is None:
        return None
    heads = content.all("h1")
    signed = SIGNATURE.search(_squeezed(heads[-1].text())) if heads else None
    day = next((_squeezed(c.text()) for c in table.all("td", DAY)), "")
    counted = REACTIONS.search(_squeezed(table.text()))
    title = _squeezed(cell.text(("a", "img")))
    content = _without_signatures(content)
    images = list(dict.fromkeys(i.attrs["src"] for i in content.all("img") if i.attrs.get("src")))
    return {
        "title": title or UNTITLED,
        "day": day,
        "signed_day": signed[1] if signed else "",
        "time": signed[2] if signed else "",
        "author": _squeezed(signed[3]) if signed else "",
        "text": _squeezed(content.text()),
        "html": sanitize_markup(content.inner()),
        "images": images,
        "counted": int(counted[1]) if counted else 0,
    }


def _parse(html: str | None, post_id: str | None) -> list[dict]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    cells = tree.root.all("td", TITLE)
    link = lambda c: next((a.attrs.get("href", "") for a in c.all("a")), "")
    posts = [c for c in cells if POST_FILE in link(c)]
    own = [c for c in posts if post_id and re.search(rf"ID(?:%3D|=){re.escape(post_id)}", link(c))]
    out = []
    for cell in (own or posts)[:1]:
        number = re.search(r"ID(?:%3D|=)(\d+)", link(cell))
        found, number = _entry(cell), post_id or (number[1] if number else "")
        if found and number:
            out.append({"kind": "post", "pos": 0, "id": number, **found})
    for k, cell in enumerate(cells):
        if REACTION_FILE in link(cell) and (found := _entry(cell)) and (found["text"] or found["html"]):
            out.append({"kind": "reaction", "pos": k, "id": f"{post_id}-{k}", **found})
    return out


_ENTRY = StructType([StructField(c, IntegerType() if c in ("pos", "counted") else ArrayType(StringType()) if c == "images" else StringType()) for c in ("kind", "pos", "id", "title", "day", "signed_day", "time", "author", "text", "html", "images", "counted")])


@F.pandas_udf(ArrayType(_ENTRY))
def entries(html: pd.Series, post_id: pd.Series) -> pd.Series:
    """The post of a page (of the given id, else the first) and its reactions."""
    return pd.Series([_parse(x, i) for x, i in zip(mojibake_repair(html), post_id, strict=True)], dtype=object)


def read_mirror(spark: SparkSession, root: str, blogs: list[str]) -> DataFrame:
    """blog, kind (post, reaction), post_id, html, path of the mirrored pages of each blog's folder."""
    out = None
    for blog in blogs:
        files = whole_files(spark, f"{root.rstrip('/')}/{blog}", "*.html").withColumn("blog", F.lit(blog))
        out = files if out is None else out.unionByName(files)
    path = F.replace(F.replace("path", F.lit("%3F"), F.lit("?")), F.lit("%3D"), F.lit("="))
    post, reaction = urls.post_file_id(path), urls.reaction_file_id(path)
    kind = F.when(post != "", "post").when(reaction != "", "reaction")
    return out.select("blog", kind.alias("kind"), F.when(post != "", post).otherwise(reaction).alias("post_id"), F.col("text").alias("html"), "path").where("kind is not null")


def _author(author: Column, nicknames: tuple[str, ...], default: str) -> Column:
    """The name as given; the default for a blank name or one of the nicknames."""
    return F.when((author == "") | F.lower(author).isin(*nicknames), F.lit(default)).otherwise(author)


def import_order(posts: DataFrame) -> list[Column]:
    """Newest first, undated last; then by number downwards."""
    return [F.desc(F.coalesce("isoDate", F.lit(""))), F.desc(F.col("id").cast("long"))]


def mirror_posts(pages: DataFrame, own_host: str, author: str, nicknames: tuple[str, ...] = ("",), unknown: str = "Onbekend", overrides: DataFrame | None = None, hosts: tuple[str, str] | None = None) -> DataFrame:
    """One row per post of ``pages`` (blog, kind, post_id, html, path), with its reactions that are no spam.

    The post page is the source of a post, its reaction page only where there is none. ``overrides``
    (slug, date, time) go before the date cell, that before the signature. A title that is missing is
    the text's beginning, or the number. reactionCount is what the page says unless there is a reaction
    page: then those that stay are counted. ``hosts`` (of images, of the blog): image addresses become
    local paths, and those that have none go. Null pages hold nothing; without pages: empty result.
    """
    found = pages.select("blog", "path", F.col("kind").alias("page"), "post_id", F.explode(entries("html", "post_id")).alias("e")).select("blog", "path", "page", "post_id", "e.*")
    slug = lambda number: F.concat_ws("-", "blog", number)
    entry = found.where("kind = 'post'").withColumn("slug", slug(F.col("id")))
    best = F.struct(F.col("page") != "post", "path")
    posts = entry.groupBy("slug").agg(F.min_by(F.struct(*[c for c in entry.columns if c != "slug"]), best).alias("p")).select("slug", "p.*")
    if overrides is not None:
        posts = posts.join(overrides.select("slug", F.col("date").alias("own_day"), F.col("time").alias("own_time")), "slug", "left")
    else:
        posts = posts.withColumns({"own_day": F.lit(None).cast("string"), "own_time": F.lit(None).cast("string")})
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    date = F.coalesce(given("own_day"), given("day"), given("signed_day"), F.lit(""))
    time = F.coalesce(given("own_time"), F.col("time"))
    title = F.when(F.col("title") != UNTITLED, F.col("title")).when(F.col("text") != "", F.substring("text", 1, 72)).otherwise(F.concat(F.lit("Bericht "), F.col("id")))
    posts = posts.select("slug", "blog", "id", title.alias("title"), date.alias("date"), time.alias("time"), _author(F.col("author"), nicknames, author).alias("author"), F.substring("text", 1, 240).alias("excerpt"), "html", "images", "counted", F.col("path").alias("sourcePath"))
    if hosts is not None:
        posts = posts.withColumn("images", F.array_distinct(F.array_compact(F.transform("images", lambda s: urls.local_image(s, F.col("blog"), *hosts)))))
    posts = posts.withColumn("isoDate", dates.iso_text(F.col("date"), F.col("time")))
    said = F.coalesce(given("day"), F.col("signed_day"))
    voices = found.where("kind = 'reaction' and page = 'reaction'").select(slug(F.col("post_id")).alias("slug"), "pos", "id", "title", said.alias("date"), dates.iso_text(said, F.col("time")).alias("isoDate"), "time", F.when(F.col("author") == "", F.lit(unknown)).otherwise(F.col("author")).alias("author"), "html")
    voices = voices.where(~spam.is_spam(F.col("title"), F.col("author"), F.col("html"), F.col("date"), own_host))
    met = pages.where("kind = 'reaction'").select(slug(F.col("post_id")).alias("slug"), F.lit(True).alias("met")).distinct()
    merged = merge_reactions(posts, voices).where(F.col("id").isNotNull()).join(met, "slug", "left")
    count = F.when(F.col("met"), F.col("reaction_count")).otherwise(F.col("counted"))
    return merged.withColumn("reactionCount", count).drop("counted", "reaction_count", "met")
