"""Queries as query strings: parsed with defaults, written back, compiled by the operators."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode


def _first(query: str) -> dict[str, str]:
    return {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}


@dataclass(frozen=True)
class GalleryQuery:
    query: str = ""
    theme: str = "all"
    species: str = "all"
    year: str = ""
    season: str = "all"
    people_plants: bool = False
    newest: bool = True
    viewer: str | None = None

    @classmethod
    def from_query_string(cls, text: str) -> GalleryQuery:
        p = _first(text)
        return cls(p.get("q", ""), p.get("theme") or "all", p.get("species") or "all", p.get("year", ""), p.get("season") or "all", p.get("peoplePlants") == "1", p.get("sort") != "old", p.get("img") or p.get("image") or None)

    def to_query_string(self, viewer: bool = True) -> str:
        parts = [("q", self.query.strip()), ("theme", self.theme if self.theme != "all" else ""), ("species", self.species if self.species != "all" else ""), ("year", self.year), ("season", self.season if self.season != "all" else ""), ("peoplePlants", "1" if self.people_plants else ""), ("sort", "" if self.newest else "old"), ("img", (self.viewer or "") if viewer else "")]
        return urlencode([p for p in parts if p[1]])

    def active(self) -> bool:
        return bool(self.query.strip() or self.year or self.people_plants or "all" not in (self.theme,) or self.species != "all" or self.season != "all")


#: The seasons that a query may name.
SEASONS = ("lente", "zomer", "herfst", "winter")


@dataclass(frozen=True)
class AtlasQuery:
    category: str = ""
    year: str = ""
    season: str = "all"
    images: bool = False
    query: str = ""
    point: str | None = None
    cluster: str | None = None

    @classmethod
    def from_query_string(cls, text: str) -> AtlasQuery:
        p = _first(text)
        year, season = p.get("year", ""), p.get("season", "all")
        return cls(p.get("category") or p.get("topic") or "", year if re.fullmatch(r"\d{4}", year) else "", season if season in SEASONS else "all", p.get("images") == "1", p.get("q", ""), p.get("point") or None, p.get("cluster") or None)

    def to_query_string(self) -> str:
        parts = [("category", self.category), ("year", self.year), ("season", self.season if self.season != "all" else ""), ("images", "1" if self.images else ""), ("q", self.query.strip()), ("point", self.point or ""), ("cluster", self.cluster or "")]
        return urlencode([p for p in parts if p[1]])


@dataclass(frozen=True)
class ArchiveQuery:
    category: str = ""

    @classmethod
    def from_query_string(cls, text: str) -> ArchiveQuery:
        p = _first(text)
        return cls((p.get("category") or p.get("topic") or "").strip())

    def to_query_string(self) -> str:
        return urlencode([("category", self.category)]) if self.category else ""


@dataclass(frozen=True)
class SearchQuery:
    query: str = ""
    category: str = ""

    @classmethod
    def from_query_string(cls, text: str) -> SearchQuery:
        p = _first(text)
        return cls(p.get("q", ""), p.get("category", ""))

    def to_query_string(self) -> str:
        return urlencode([p for p in (("q", self.query.strip()), ("category", self.category)) if p[1]])

    def runs(self) -> bool:
        """Shorter queries are not run."""
        return len(self.query.strip()) >= 2
