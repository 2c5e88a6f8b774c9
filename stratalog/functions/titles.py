"""Post bodies without the title that they repeat in front, as a pandas UDF over (html, title)."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WORD = re.compile(r"[^\W_]+")
_WRAPPERS, _BLOCKS, _EMPHASIS = {"article", "div", "section"}, {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6"}, {"strong", "b", "em"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "wbr"}
MOST_BLOCKS = 5


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def _words(text: str) -> list[str]:
    return [_fold(m.group()) for m in _WORD.finditer(text)]


@dataclass
class _Node:
    """An element with the places of its tags in the source."""

    tag: str
    start: int = 0
    inner: int = 0
    inner_end: int = 0
    end: int = 0
    children: list[_Node] = field(default_factory=list)
    own_text: str = ""
    text: str = ""

    def has(self, tags: set[str]) -> bool:
        return any(c.tag in tags or c.has(tags) for c in self.children)


class _Outline(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.root = _Node("", inner_end=len(source), end=len(source))
        self.open = [self.root]
        self.leading: list[tuple[_Node, int, str]] = []
        self.feed(source)
        self.close()
        for node in self.open[1:]:
            node.inner_end = node.end = len(source)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        start = self._at()
        node = _Node(tag, start, start + len(self.get_starttag_text()))
        self.open[-1].children.append(node)
        if tag in _VOID:
            node.inner_end = node.end = node.inner
            if tag == "br":
                self._say(" ")
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            node = self.open.pop()
            node.inner_end = node.end = node.inner

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            at = self._at()
            while True:
                node = self.open.pop()
                node.inner_end = at
                node.end = at
                if node.tag == tag:
                    break
            node.end = at + len(tag) + 3

    def _say(self, text: str) -> None:
        for node in self.open:
            node.text += text

    def handle_data(self, data):
        self._say(data)
        owner = self.open[-1]
        if data.strip():
            owner.own_text += data
            if not owner.children:
                owner.children.append(_Node("#text"))


def _leading(node: _Node) -> _Node | None:
    """The first element, inside wrappers that hold nothing but elements; none where text comes first."""
    if not node.children or node.children[0].tag == "#text":
        return None
    first = node.children[0]
    if first.tag in _WRAPPERS and not first.own_text and first.children and not first.has({"img"}):
        return _leading(first) or first
    return first


def strip_title(source: str | None, title: str | None) -> str | None:
    """Remove up to five leading blocks that repeat the title, whole or in parts; a subtitle behind it stays."""
    wanted, used = _words(title or ""), 0
    if not source or not wanted:
        return source
    for _ in range(MOST_BLOCKS):
        block = _leading(_Outline(source).root)
        if block is None or block.tag not in _BLOCKS or block.has({"img"}):
            break
        said = _words(block.text)
        bold = block.tag.startswith("h") or block.has(_EMPHASIS)
        rest = wanted[used:]
        if not said:
            break
        if said == wanted or (bold and rest and said == rest[: len(said)]):
            source = source[: block.start] + source[block.end :]
            used += len(said)
            continue
        if bold and rest and said[: len(rest)] == rest:
            text = " ".join(block.text.split())
            behind = text[[m.end() for m in _WORD.finditer(text)][len(rest) - 1] :]
            behind = re.sub(r"^[\s:;,.\-–—]+", "", behind).strip()
            kept = source[block.start : block.inner] + entities.escape(behind, quote=False) + source[block.inner_end : block.end] if behind else ""
            source = source[: block.start] + kept + source[block.end :]
        break
    return source


@F.pandas_udf(StringType())
def without_title(html: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([strip_title(h, t) for h, t in zip(html, title, strict=True)], dtype=object)
