"""Document sources: JSON, Markdown with front matter, HTML directories; unions with priorities."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from stratalog.functions.text import plain_text, squeeze

POST = "id string, slug string, title string, date string, isoDate string, html string, cleanedText string, excerpt string, topicId string, imageCount int, reactionCount int, images array<string>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, text of every file below a folder."""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("text"))


def front_matter(text: Column) -> Column:
    """(meta map, body) of Markdown; scalars and one-line lists of the header, everything is body without one."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
    has = text.rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(text, pattern, 1), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))
    return F.struct(F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, meta, body of every Markdown file, in the order of paths."""
    return whole_files(spark, path, "*.md").select("path", front_matter(F.col("text")).alias("f")).select("path", "f.meta", "f.body").orderBy("path")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, title (the file's stem without one), text, html of every HTML file."""
    files = whole_files(spark, path, "*.{htm,html}")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.html?$", "")
    return files.select("path", F.coalesce(F.nullif(html_title(F.col("text")), F.lit("")), stem).alias("title"), plain_text(F.col("text")).alias("plain"), F.col("text").alias("html"))


def html_title(markup: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " "))


def first_source_wins(sources: list[DataFrame], key: str, pos: str) -> DataFrame:
    """Union by name; of rows with one key the first source's stands, inside a source the first by ``pos``."""
    out = None
    for k, s in enumerate(sources):
        ranked = s.withColumn("source_rank", F.lit(k))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    best = F.row_number().over(W.partitionBy(key).orderBy("source_rank", pos))
    return out.withColumn("r_", best).where("r_ = 1").drop("r_")


def merge_chunks(chunks: DataFrame, key: str, chunk: str) -> DataFrame:
    """Of rows with one key the latest chunk's stands."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(chunk)))
    return chunks.withColumn("r_", last).where("r_ = 1").drop("r_")


def merge_reactions(posts: DataFrame, reactions: DataFrame, key: str = "slug") -> DataFrame:
    """Posts with their reactions in order; reactions without a post stay, as a row of their own."""
    grouped = reactions.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*[c for c in reactions.columns if c not in (key, "pos")]).alias("r")))), lambda x: x["r"]).alias("reactions"))
    return posts.join(grouped, key, "full").withColumn("reaction_count", F.coalesce(F.size("reactions"), F.lit(0)))


class _Images(HTMLParser):
    """Images with their alternative texts, captions and the texts near them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.figure = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            a = dict(attrs)
            self.found.append([a.get("src") or "", a.get("alt") or "", ""])
            if self.figure:
                self.figure[-1][0].append(len(self.found) - 1)
        elif tag in ("figure", "figcaption"):
            if tag == "figure":
                self.figure.append([[], False])
            elif self.figure:
                self.figure[-1][1] = True

    def handle_endtag(self, tag):
        if tag == "figure" and self.figure:
            self.figure.pop()
        elif tag == "figcaption" and self.figure:
            self.figure[-1][1] = False

    def handle_data(self, data):
        if self.figure and self.figure[-1][1]:
            for k in self.figure[-1][0]:
                self.found[k][2] += data


_IMAGE = StructType([StructField("index", IntegerType()), StructField("src", StringType()), StructField("alt", StringType()), StructField("caption", StringType())])


def _extract(markup: pd.Series) -> pd.Series:
    def one(x):
        p = _Images()
        p.feed(x or "")
        p.close()
        return [{"index": i, "src": s, "alt": a, "caption": " ".join(c.split())} for i, (s, a, c) in enumerate(p.found)]

    return markup.map(one)


#: Array of (index, src, alt, caption) of an HTML column.
html_images = F.pandas_udf(_extract, ArrayType(_IMAGE))


class _Sanitizer(HTMLParser):
    DROPPED = {"script", "style", "form", "noscript", "iframe", "object", "input", "button", "select", "textarea"}
    KEPT = {"p", "div", "br", "b", "strong", "i", "em", "u", "ul", "ol", "li", "a", "img", "table", "tbody", "thead", "tr", "td", "th", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "figure", "figcaption"}
    ATTRIBUTES = {"a": ("href",), "img": ("src", "alt", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
    VOID = {"br", "img", "hr", "input"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.skip += tag not in self.VOID
        elif not self.skip and tag in self.KEPT:
            kept = "".join(f' {k}="{(v or "").replace(chr(34), "&quot;")}"' for k, v in attrs if k in self.ATTRIBUTES.get(tag, ()) and not (v or "").strip().lower().startswith("javascript:"))
            self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.KEPT and tag not in self.VOID:
            if self.out and self.out[-1] == f"<{tag}>" and tag in ("p", "div", "blockquote", "ul", "ol", "li"):
                self.out.pop()  # an empty block
            else:
                self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip and data:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def sanitize_markup(markup: str | None) -> str | None:
    if markup is None:
        return None
    p = _Sanitizer()
    p.feed(markup)
    p.close()
    return "".join(p.out).strip()


def _sanitize(markup: pd.Series) -> pd.Series:
    return markup.map(sanitize_markup)


#: HTML of whitelisted elements and attributes; forms and scripts go with their content, other elements are unwrapped.
sanitize_html = F.pandas_udf(_sanitize, StringType())


def candidates_from_yaml(text: str) -> list[dict]:
    """Items of a small candidate file: a list of mappings, on its own or under `candidates:`.

    Scalars, quotes, comments, one-line lists and lists of `- ` lines are understood; deeper nesting is not.
    """
    plain = lambda v: v.strip().strip("\"'")
    out: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#") or body == "candidates:":
            continue
        item = body.startswith("- ")
        name, colon, value = (body[2:] if item else body).partition(":")
        if item and not colon:
            if out and key:
                out[-1][key] = [*(out[-1][key] or []), plain(name)]
            continue
        if item:
            out.append({})
        if not out or not colon:
            continue
        key, value = plain(name), value.strip()
        if value.startswith("[") and value.endswith("]"):
            out[-1][key] = [plain(v) for v in value[1:-1].split(",") if v.strip()]
        else:
            out[-1][key] = plain(value) or None
    return out


def explorer_rows(text: Column) -> Column:
    """Key and value rows of a JSON object as (key, value) entries."""
    return F.map_entries(F.from_json(text, "map<string,string>"))
