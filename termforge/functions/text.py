"""Normalising, tokenising and stemming as Spark expressions, with Python twins for query strings.

All native but for rare entities, signs that stand for several letters, and character offsets: for these
there is no built-in, and the texts that hold them go through Arrow UDFs.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from termforge.functions.constants import MAX_TOKEN, MIN_TERM, MIN_TOKEN, STEM_RULES, STOPWORDS

ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"),
    ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
)
TAGS, URLS, DROPPED = r"<[^>]+>", r"https?://\S+|www\.\S+", r"[^a-z0-9\s\-]"
_TOKENS = ty.ArrayType(ty.StructType().add("term", ty.StringType()).add("position", ty.IntegerType()).add("start_char", ty.IntegerType()).add("end_char", ty.IntegerType()))
TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"


#: What Python's patterns and ``str.split`` take for space; Java's ``\\s`` is ASCII only.
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_URLS = URLS.replace(r"\S", f"[^{SPACES}]")
#: An ampersand that may begin an entity beyond ``ENTITIES``.
_RARE = "&(?!(?:" + "|".join(e[1:-1] for e, _ in ENTITIES) + ");)[#A-Za-z]"


@cache
def _letters() -> tuple[str, str, str]:
    """All of Unicode by compatibility decomposition without combining marks: signs of one letter or digit and
    these, with signs of nothing at the end; and as a class of a pattern, signs that become several, of which one counts."""
    one, many, nothing = [], set(), []
    for code in range(0x80, sys.maxunicode + 1):
        sign = chr(code)
        if not unicodedata.decomposition(sign) and not unicodedata.combining(sign):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))
        if not plain:
            nothing.append(sign)
        elif re.search("[a-zA-Z0-9-]", plain):
            if len(plain) == 1:
                one.append((sign, plain))
            else:
                many.add(code)
    many |= {code for code in range(0x80, sys.maxunicode + 1) if (low := chr(code).lower()) != chr(code) and any(ord(c) in many for c in low)}
    begins = [code for code in sorted(many) if code - 1 not in many]
    ends = [code for code in sorted(many) if code + 1 not in many]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(begins, ends))
    return "".join(a for a, _ in one) + "".join(nothing), "".join(b for _, b in one), rf"(?=[^\x00-\x7f])[{ranges}]"  # ASCII is past the first test


def unescape(c: Column) -> Column:
    """All entities: those of ``ENTITIES`` natively, ampersands last; only texts that may hold others go to ``unescape_all``."""
    return F.coalesce(unescape_all(F.when(c.rlike(_RARE), c)), _usual(c))


def unescape_named(c: Column) -> Column:
    """The names of HTML 4 with their semicolons, ``&#39;``, ``&apos;`` and then ampersands, also without one: what can be listed in SQL."""
    return F.coalesce(unescape_listed(F.when(c.rlike(_RARE), c)), _usual(c))


def _usual(c: Column) -> Column:
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


@F.pandas_udf(ty.StringType())
def unescape_all(c: pd.Series) -> pd.Series:
    """All named and numeric entities."""
    return c.map(entities.unescape, na_action="ignore")


_LISTED = {f"&{name};": chr(code) for name, code in name2codepoint.items() if name != "amp"} | {"&#39;": "'", "&apos;": "'"}


@F.pandas_udf(ty.StringType())
def unescape_listed(c: pd.Series) -> pd.Series:
    """``unescape_named`` of texts."""

    def plain(text: str) -> str:
        return re.sub("&amp;?", "&", re.sub("&(?:#39|[A-Za-z0-9]+);", lambda m: _LISTED.get(m[0], m[0]), text))

    return c.map(plain, na_action="ignore")


@F.pandas_udf(ty.StringType())
def decompose(c: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return c.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)), na_action="ignore")


def _plain(c: Column) -> Column:
    """Letters and digits without accents and in their plain forms; signs that become several letters stay."""
    signs, plain, _ = _letters()
    return F.translate(c, signs, plain)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def normalize(c: Column, lowercase: bool = True, strip_html: bool = True, strip_urls: bool = True, accents: bool = True) -> Column:
    """Entities, tags, URLs, case, accents, then anything but letters, digits and hyphens; null is ''.

    Native but for texts that hold rare entities or signs that become several letters; these alone go to Python.
    """
    raw = c = F.coalesce(c.cast("string"), F.lit(""))
    marked, foreign = raw.rlike("[&<]"), raw.rlike(r"[^\x00-\x7f]|&#")  # plain texts skip what can't change them

    def where(test: Column, changed: Column, c: Column) -> Column:
        return F.when(test, changed).otherwise(c)

    if strip_html:
        c = where(marked, F.regexp_replace(_usual(c), TAGS, " "), c)
    if strip_urls:
        c = where(marked | raw.contains("http") | raw.contains("www"), F.regexp_replace(c, _URLS, " "), c)
    if lowercase:
        c = F.lower(c)
    if accents:
        c = where(foreign, _plain(c), c)
    native = F.array_join(F.regexp_extract_all(c, F.lit("([a-z0-9-]+)"), F.lit(1)), " ")  # Java takes ten times as long to find what to drop
    hard = [p for p, on in ((_RARE, strip_html), (_letters()[2], accents)) if on]
    if not hard:
        return native

    @F.pandas_udf(ty.StringType())
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize_string(t, lowercase, strip_html, strip_urls, accents), na_action="ignore")

    return F.coalesce(whole(F.when((foreign | raw.contains("&")) & raw.rlike("|".join(hard)), raw)), native)


def page_title(html: Column, entities: Callable[[Column], Column] = unescape) -> Column:
    return F.regexp_replace(entities(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), f"^[{SPACES}]+|[{SPACES}]+$", "")


def page_text(html: Column, entities: Callable[[Column], Column] = unescape) -> Column:
    """Visible text: no scripts, styles and tags; case, accents and URLs stay."""
    c = F.regexp_replace(entities(F.coalesce(html, F.lit(""))), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return collapse(F.regexp_replace(c, TAGS, " "))


def tokens(normal: Column, remove_stopwords: bool = True, shortest: int = MIN_TOKEN, longest: int = MAX_TOKEN) -> Column:
    """The kept tokens of normalised text, in order, not yet stemmed."""
    found = F.regexp_extract_all(normal, F.lit(f"({TOKEN})"), F.lit(1))

    def kept(t: Column) -> Column:
        fits = F.length(t).between(shortest, longest)
        return fits & ~t.isin(*STOPWORDS) if remove_stopwords else fits

    return F.filter(found, kept)


def stem(t: Column) -> Column:
    """The light stemmer as one CASE, so it stays inside generated code."""
    out = F.when(F.length(t) <= 3, t)
    for suffix, rest in STEM_RULES:
        n = len(suffix)
        fits = t.endswith(suffix) & (F.length(t) >= 3 + n - len(rest))
        out = out.when(fits, F.concat(t.substr(F.lit(1), F.length(t) - n), F.lit(rest)))
    return out.otherwise(t)


def stem_sql(t: str) -> str:
    """The same as SQL text for other engines."""
    rules = " ".join(f"WHEN right({t}, {len(s)}) = '{s}' AND length({t}) >= {3 + len(s) - len(r)} THEN substr({t}, 1, length({t}) - {len(s)}) || '{r}'" for s, r in STEM_RULES)
    return f"CASE WHEN length({t}) <= 3 THEN {t} {rules} ELSE {t} END"


def terms(normal: Column, remove_stopwords: bool = True, shortest: int = MIN_TOKEN, longest: int = MAX_TOKEN) -> Column:
    """Array of stemmed terms. A stem has ``MIN_TERM`` letters at least, as the token has: no second filter is needed."""
    found = F.transform(tokens(normal, remove_stopwords, shortest, longest), stem)
    return found if shortest >= MIN_TERM else F.filter(found, lambda t: F.length(t) >= MIN_TERM)


def offsets_of(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Each term with its position and character range in the normalised text."""
    position = 0
    for m in re.finditer(TOKEN, text):
        if MIN_TOKEN <= len(m[0]) <= MAX_TOKEN and m[0] not in _STOP:
            yield stem_word(m[0]), position, m.start(), m.end()
            position += 1


@F.pandas_udf(_TOKENS)
def tokens_with_offsets(normal: pd.Series) -> pd.Series:
    """Terms with their positions and character ranges in the normalised text. For few texts: a batch of results is held at once."""
    names = ("term", "position", "start_char", "end_char")
    return normal.fillna("").map(lambda text: [dict(zip(names, t)) for t in offsets_of(text)])


_STOP = frozenset(STOPWORDS)


def stem_word(word: str) -> str:
    if len(word) > 3:
        for suffix, rest in STEM_RULES:
            if word.endswith(suffix) and len(word) - len(suffix) + len(rest) >= 3:
                return word[: len(word) - len(suffix)] + rest
    return word


def unstemmed(terms: Iterable[str]) -> list[str]:
    """All tokens whose stem is one of ``terms``."""
    wanted = set(terms)
    words = wanted | {t[: len(t) - len(rest)] + suffix for t in wanted for suffix, rest in STEM_RULES if t.endswith(rest)}
    return sorted(w for w in words if stem_word(w) in wanted)


def normalize_string(text: str | None, lowercase: bool = True, strip_html: bool = True, strip_urls: bool = True, accents: bool = True) -> str:
    """``normalize`` for one string in Python."""
    text = text or ""
    if strip_html:
        text = re.sub(TAGS, " ", entities.unescape(text))
    if strip_urls:
        text = re.sub(URLS, " ", text)
    if lowercase:
        text = text.lower()
    if accents:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(DROPPED, " ", text).split())


def terms_of(text: str | None) -> list[str]:
    """``terms`` for one string on the driver: a query."""
    found = [t for t in re.findall(TOKEN, normalize_string(text)) if MIN_TOKEN <= len(t) <= MAX_TOKEN and t not in _STOP]
    return [t for t in map(stem_word, found) if len(t) >= MIN_TERM]
