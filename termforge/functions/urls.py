"""URL expressions."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from termforge.functions.constants import TRACKING


def normalize_url(url: Column) -> Column:
    """No trailing slashes, no fragment, no query if it has a tracking parameter; lower case."""
    bare = F.substring_index(F.regexp_replace(url, "/+$", ""), "#", 1)
    tracked = F.split_part(bare, F.lit("?"), F.lit(2)).rlike(rf"(?:^|&)(?:{'|'.join(TRACKING)})(?:=|&|$)")
    return F.lower(F.when(tracked, F.substring_index(bare, "?", 1)).otherwise(bare))


def host(url: Column) -> Column:
    """The authority as written, port included."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_key(normal: Column) -> Column:
    return F.xxhash64(normal)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v or "" for k, v in attrs if k == "href"][:1]


def links_of(html: str | None, base: str | None) -> list[str]:
    """Absolute targets of all anchors with http or https, without query and fragment."""
    parser = _Links()
    parser.feed(html or "")
    out = []
    for href in parser.found:
        try:
            to = urlsplit(urljoin(base or "", href))
        except ValueError:
            continue
        path = to.path.split(";")[0] if ";" in to.path.rsplit("/", 1)[-1] else to.path
        if to.scheme in ("http", "https") and to.netloc:
            out.append(f"{to.scheme}://{to.netloc}{path}")
    return out


@F.pandas_udf(ty.ArrayType(ty.StringType()))
def page_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links_of(h, b) for h, b in zip(html, base)])


def page_links_native(html: Column, base: Column) -> Column:
    """``page_links`` for quoted absolute, ``//`` and ``/`` references, without Python."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z]+):", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    full = F.transform(hrefs, lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(root, h)))
    return F.transform(F.filter(full, lambda u: u.rlike("^https?://[^/]")), lambda u: F.regexp_replace(u, r"[?#].*$", ""))
