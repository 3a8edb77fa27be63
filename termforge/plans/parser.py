"""Query strings to trees, and trees to sets of documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import boolean

_OPERATOR = re.compile(r"\s+(AND|OR|NOT)\s+")
#: Columns of the document table that a field may name.
FIELDS = ("title", "url")
_FIELD = re.compile(r"(\w+):(\S+)")


@dataclass
class Query:
    """``kind``: keyword, phrase or boolean. ``name`` is the field of a ``name:value`` query."""

    kind: str
    terms: list[str] = field(default_factory=list)
    phrase: str | None = None
    operator: str | None = None
    children: list[Query] = field(default_factory=list)
    name: str | None = None

    def all_terms(self) -> list[str]:
        """Terms in reading order, those behind NOT too."""
        own = self.terms + (self.phrase.lower().split() if self.phrase else [])
        return own + [t for c in self.children for t in c.all_terms()]

    def __str__(self) -> str:
        if self.kind == "boolean":
            return f"({self.children[0]} {self.operator} {self.children[1]})"
        return f'"{self.phrase}"' if self.kind == "phrase" else (f"{self.name}:" if self.name else "") + " ".join(self.terms)


def parse(query: str) -> Query:
    """One quoted phrase; operators in capitals, from left to right without precedence; a field; or words."""
    query = query.strip()
    quoted = re.findall(r'"([^"]*)"', query)
    if len(quoted) == 1 and quoted[0] and query == f'"{quoted[0]}"':
        return Query("phrase", phrase=quoted[0])
    if re.search(r" (?:AND|OR|NOT) ", query):
        first, *rest = _OPERATOR.split(query)
        tree = parse(first)
        for operator, part in zip(rest[::2], rest[1::2]):
            tree = Query("boolean", operator=operator, children=[tree, parse(part)])
        return tree
    named = _FIELD.match(query)
    if named:
        return Query("keyword", terms=[named[2]], name=named[1])
    return Query("keyword", terms=query.lower().split())


def looked_for(query: Query) -> list[str]:
    """The terms that ``evaluate`` looks for."""
    own = T.terms_of(query.phrase) if query.phrase else [t for w in query.terms for t in T.terms_of(w)]
    return own + [t for c in query.children for t in looked_for(c)]


def evaluate(query: Query, stream: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(doc_id) that satisfy the tree strictly; words of a keyword query are alternatives.

    ``name:value`` looks for all words of the value in the column ``name`` of ``meta``; where there is none, anywhere in the text.
    """
    if query.kind == "phrase":
        return boolean.having_phrase(stream, T.terms_of(query.phrase))
    if query.kind == "boolean":
        left, right = (evaluate(c, stream, meta) for c in query.children)
        return {"AND": boolean.both, "OR": boolean.either, "NOT": boolean.without}[query.operator](left, right)
    terms = [t for w in query.terms for t in T.terms_of(w)]
    if not terms:
        return stream.select("doc_id").where(F.lit(False))
    if query.name and meta is not None and query.name.lower() in FIELDS:
        said = T.terms(T.normalize(F.col(query.name.lower()), strip_urls=query.name.lower() != "url"))
        return meta.withColumn("__said", said).where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains("__said", t))).select("doc_id").distinct()
    return boolean.having_any(stream, terms)
