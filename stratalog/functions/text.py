"""Text as Column expressions: cleaning, excerpts, tokens, snippets."""

from __future__ import annotations

import contextlib
import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are no topic, and words that stand for others.
STOPWORDS = """aan al als bij dan dat de deze die dit door een en er ge geen haar had heb hebben heeft hem het hier hij hoe hun
ik in is ja je kan kunnen maar me men met mijn naar niet nog nu of om ons ook op over te tot uit uw van veel voor
was wat we wel werd wij worden wordt ze zei zijn zo zal zou""".split()
SYNONYMS = {"appel": "appels", "appelen": "appels", "peer": "peren", "pruim": "pruimen", "bes": "bessen"}
SPAM_TAIL = r"(?is)\b(outlet|shoes|nike|jordan|kors|coach|sunglasses|replica|cheap|wholesale)\b.*$"

_SPACE = r"[\s\u00a0]+"


def _plain_letters() -> dict[str, str]:
    """Characters up to U+1FFF that NFKD makes one ASCII letter with combining marks."""
    out = {}
    for point in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            out[chr(point)] = plain
    return out


_LETTERS = _plain_letters()


def squeeze(text: Column) -> Column:
    """White space and no-break spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def without_accents(text: Column) -> Column:
    """Latin letters without their accents, of one character or with combining marks; see :func:`nfkd` for all of Unicode."""
    return F.translate(F.regexp_replace(text, r"[\u0300-\u036f]", ""), "".join(_LETTERS), "".join(_LETTERS.values()))


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities, twice."""
    return texts.map(lambda x: None if x is None else html.unescape(html.unescape(x)))


def basic_entities(text: Column) -> Column:
    """The five entities that cover most exports, without Python."""
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_tags(text: Column) -> Column:
    """Script, style and noscript with their content, comments and tags become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]+>", " ")


def plain_text(markup: Column, exact: bool = False) -> Column:
    """Text of HTML; ``exact`` resolves every entity by a pandas UDF."""
    text = strip_tags(F.coalesce(markup, F.lit("")))
    return squeeze(unescape(text) if exact else basic_entities(text))


def metadata_text(markup: Column, fallback: Column) -> Column:
    text = plain_text(markup)
    return F.when(text == "", fallback).otherwise(text)


def excerpt(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis; without a space the full cut stays."""
    cut = F.substring(text, 1, limit)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, r"\s+\S*\z", "")), F.lit("…")))


def metadata_excerpt(text: Column, limit: int) -> Column:
    """At most ``limit`` characters with the ellipsis; cut at the last space if that keeps 65 % of it, without punctuation in front."""
    cut = F.rtrim(F.substring(text, 1, max(0, limit - 1)))
    word = F.regexp_replace(cut, r"\s\S*\z", "")
    kept = F.when(F.char_length(word) > limit * 0.65, F.when(F.char_length(word) < F.char_length(cut), word).otherwise(cut)).otherwise(cut)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(kept, r"[\s,.;:!?-]+\z", ""), F.lit("…")))


def short_label(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def author_text(text: Column, spam_tail: bool = False) -> Column:
    """What stands before the comments; with ``spam_tail`` also before the first shop word."""
    text = F.split(text, r"(?i)\bReacties\b\s+\d{2}[-/]\d{2}[-/]\d{4}", 2)[0]
    if spam_tail:
        text = F.regexp_replace(F.split(text, r"(?i)\bComments\b\s+\d{2}[-/]\d{2}[-/]\d{4}", 2)[0], SPAM_TAIL, "")
    return text


def sentences(text: Column) -> Column:
    """Squeezed text split behind . ! ? before a capital or a digit."""
    parts = F.split(squeeze(text), r"(?<=[.!?])\s+(?=[A-ZÀ-Ý0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"))


def topic_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS, synonyms: dict[str, str] | None = None) -> Column:
    """Lower-cased words of three letters or more without stopwords, synonyms replaced."""
    found = F.regexp_extract_all(F.translate(F.lower(text), "’", "'"), F.lit(r"([a-zà-ÿ][a-zà-ÿ'-]{2,})"), F.lit(1))
    swap = F.create_map(*[F.lit(x) for pair in (SYNONYMS if synonyms is None else synonyms).items() for x in pair])
    found = F.transform(found, lambda t: F.coalesce(F.try_element_at(swap, t), t))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def token_prefix(prefix: Column, full: Column) -> Column:
    """Whether the first token array begins the second."""
    return (F.size(prefix) > 0) & (F.size(prefix) <= F.size(full)) & (F.slice(full, F.lit(1), F.size(prefix)) == prefix)


def slug(text: Column, limit: int = 90) -> Column:
    base = F.regexp_replace(F.lower(without_accents(F.replace(text, F.lit("&"), F.lit(" en ")))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.btrim(base, F.lit("-")), 1, limit), "-+$", "")


def latin_slug(text: Column) -> Column:
    """Slug that keeps Latin-1 letters."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9à-ÿ]+", "-"), F.lit("-"))


def snippet(text: Column, terms: Sequence[str], before: int = 130, after: int = 260, plain: int = 320) -> Column:
    """Around the earliest term, case aside; the first ``plain`` characters without one."""
    low = F.lower(text)
    places = F.filter(F.array(*[F.locate(t.lower(), low) for t in terms]), lambda p: p > 0) if terms else F.array().cast("array<int>")
    at = F.array_min(places)
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(text, start, at + after - start)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(at + after <= F.char_length(text), "…").otherwise(""))
    return F.coalesce(cut, F.substring(text, 1, plain))


def highlight(text: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return text
    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({pattern})", "<mark>$1</mark>")


def meaningful(text: Column) -> Column:
    """Two letters or digits at least."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]")) >= 2


def caption_range(text: Column) -> Column:
    """(first, last) of `1 ...`, `1 & 2 ...`, `1-3 ...`; null without a number in front."""
    pattern = r"^\s*(\d+)(?:\s*(?:&|-|–|en|t/m)\s*(\d+))?(?!\d)"
    first, last = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int") for k in (1, 2))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.coalesce(last, first).alias("last")))


def title_case_list(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ", ")


def part_label(index: Column, total: Column) -> Column:
    """`Deel i van n`, index from 0."""
    return F.concat(F.lit("Deel "), (index + 1).cast("string"), F.lit(" van "), total.cast("string"))


def html_parts(markup: Column) -> Column:
    """Text and image parts in order: array of (kind, value)."""
    texts = F.split(markup, r"(?i)<img\b[^>]*>")
    images = F.regexp_extract_all(markup, F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    both = F.flatten(F.transform(texts, lambda t, i: F.array(F.struct(F.lit("text").alias("kind"), t.alias("value")), F.struct(F.lit("image").alias("kind"), F.coalesce(F.get(images, i), F.lit("")).alias("value")))))
    return F.filter(both, lambda p: F.trim(p["value"]) != "")


# What is left of sequences that lost bytes, and what it stands for, in the order of repair.
_BEFORE_ENTITY = (r"Â(?=&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);)", "")
_LEFTOVERS = (
    (r"(?<=[A-Za-z])â(?=s(?![A-Za-z0-9_]))", "’"),
    (r"â¦", "…"),
    (r"Ã(?=\s+la(?![A-Za-z0-9_]))", "à"),
    (r"Â(?=\s|$)", ""),
    (r"â(?=[A-Z])", "“"),
    (r"(?<=[^\W_])â(?=[\s.,;:!?)]|$)", "”"),
)


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character is in Windows-1252; the C1 controls and undefined bytes are themselves."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        with contextlib.suppress(UnicodeDecodeError):
            out[bytes([b]).decode("cp1252")] = b
    return out


_BYTES = _bytes_of_characters()
_CONTROLS = {b: c for c, b in _BYTES.items() if b < 0xA0 and ord(c) > 0xFF}
_HIGH = f"[{''.join(map(re.escape, sorted(_BYTES)))}]"
_BROKEN = "[ÃÂâ\u0080-\u009f]"


def _decoded(found: re.Match) -> str:
    try:
        return bytes(_BYTES[c] for c in found[0]).decode("utf-8")
    except UnicodeDecodeError:
        return found[0]


def mojibake_repair(texts: pd.Series, passes: int = 4) -> pd.Series:
    """Undo UTF-8 read as Windows-1252 where it stands, in at most ``passes`` rounds; what is sound beside it stays.

    Sequences of two and three bytes are decoded, then the known leftovers of broken ones replaced;
    controls that remain are read as Windows-1252. Null stays null.
    """
    steps = [_BEFORE_ENTITY, (f"â{_HIGH}{_HIGH}", _decoded), (f"[ÃÂ]{_HIGH}", _decoded), *_LEFTOVERS]
    steps = [(re.compile(p), to) for p, to in steps]

    def fix(x):
        for _ in range(passes):
            before = x
            for pattern, to in steps:
                x = pattern.sub(to, x)
            if x == before:
                break
        return x.translate(_CONTROLS)

    return texts.map(lambda x: fix(x) if x is not None and re.search(_BROKEN, x) else x)


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return mojibake_repair(texts)


def repair_encoding(text: Column) -> Column:
    """:func:`mojibake_repair` of a column; texts without a suspect character don't go through Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_repaired(F.when(text.rlike(_BROKEN), text)), text)
