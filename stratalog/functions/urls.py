"""Paths and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "/archive-images/"
_IMAGE = r"(?i)\.(jpe?g|png|gif|webp)(?:[?#].*)?$"


def _to_prefix(src: Column, image_host: str, blog_host: str) -> Column:
    """The five spellings of the image host's addresses to the local prefix."""
    return F.regexp_replace(src, rf"(?i)^(?:https?://(?:{blog_host}/)?|\.\./(?:\.\./)?)?{image_host}/", PREFIX)


def local_image(src: Column, blog: Column, image_host: str, blog_host: str) -> Column:
    """Local path of an image address, bare file names under their blog; null for skins, spacers, other schemes and other hosts.

    Hosts are regexes. Whether the file exists is a semi join with a file listing.
    """
    raw = F.replace(F.trim(src), F.lit("&amp;"), F.lit("&"))
    path = _to_prefix(raw, image_host, blog_host)
    path = F.when(~path.startswith("/") & ~path.rlike("(?i)^https?://") & path.rlike(r"(?i)\.(jpe?g|png|gif|webp)$"), F.concat(F.lit(PREFIX), blog, F.lit("/"), path)).otherwise(path)
    dropped = raw.rlike(r"(?i)/Images/Skin/|pixel\.gif|pijl\.gif|^(file|cid|data):") | ~path.startswith(PREFIX)
    return F.when(F.coalesce(dropped, F.lit(True)), F.lit(None)).otherwise(path)


def local_link(href: Column, blog: Column, image_host: str, blog_host: str) -> Column:
    """Links to images, posts and comments of the archive become local ones; others stay."""
    raw = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    part = lambda script, name: F.nullif(F.regexp_extract(raw, rf"(?i){script}\.php(?:%3F|\?){name}(?:%3D|=)(\d+)", 1), F.lit(""))
    image = F.when(raw.rlike(_IMAGE) | raw.rlike(rf"(?i){image_host}"), local_image(href, blog, image_host, blog_host))
    post, reaction = part("archief", "ID"), part("reageer", "postID")
    return F.coalesce(image, F.concat(F.lit("/posts/"), blog, F.lit("-"), post, F.lit("/")), F.concat(F.lit("/posts/"), blog, F.lit("-"), reaction, F.lit("/#reactions")), raw)


def post_file_id(path: Column) -> Column:
    """Post id in a mirrored file's name; empty without one."""
    return F.regexp_extract(path, r"archief\.php\?ID=(\d+)\.html$", 1)


def reaction_file_id(path: Column) -> Column:
    return F.regexp_extract(path, r"reageer\.php\?postID=(\d+)\.html$", 1)


#: Folders of thumbnails by width.
THUMBS = {640: "/archive-thumbs/", 240: "/archive-thumbs-240/", 96: "/archive-thumbs-96/"}


def thumbnail(src: Column, width: int) -> Column:
    """Thumbnail path of an image or of another thumbnail, as webp, query and fragment kept; others stay."""
    path, suffix = F.regexp_extract(src, r"^([^?#]*)", 1), F.regexp_extract(src, r"^[^?#]*(.*)$", 1)
    folder = r"^/archive-(?:images|thumbs(?:-240|-96)?)/"
    moved = F.regexp_replace(F.regexp_replace(path, folder, THUMBS[width]), r"\.[^/.]+$", ".webp")
    return F.when(path.startswith(THUMBS[width]), src).when(path.rlike(folder), F.concat(moved, suffix)).otherwise(src)


def absolute(path: Column, base: str) -> Column:
    """An image path of the archive behind a base address; others stay."""
    return F.when(path.startswith(PREFIX), F.concat(F.lit(base.rstrip("/")), path)).otherwise(path)


def rewrite_assets(markup: Column, base: str) -> Column:
    """Image paths in src and href, quoted or not, behind a base address."""
    return F.regexp_replace(markup, rf"""(?i)\b(src|href)\s*=\s*(["']?){PREFIX}""", "$1=$2" + base.rstrip("/") + PREFIX)


def site_path(path: Column, base: str) -> Column:
    """Rooted paths get the base once; all else stays."""
    base = "/" + base.strip("/")
    if base == "/":
        return path
    return F.when(path.startswith("/") & ~path.startswith("//") & (path != base) & ~path.startswith(base + "/"), F.concat(F.lit(base), path)).otherwise(path)


def url_path(url: Column) -> Column:
    """Unescaped path component."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def download_name(src: Column, key: Column) -> Column:
    """Last segment without query, percent-decoded; `key`.jpg without one."""
    last = F.try_element_at(F.filter(F.split(F.split(src, "[?#]")[0], "/"), lambda p: p != ""), F.lit(-1))
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), F.concat(key, F.lit(".jpg")))
