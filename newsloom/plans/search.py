"""The search language: terms, phrases, negation, OR groups and fields, lowered to predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("domain", "domainis", "sourcelang", "sourcecountry", "theme", "location", "actor", "quadclass")
LISTS = {"theme": "themes", "location": "locations", "actor": "actors"}
_LEXEME = re.compile(r'(?P<paren>[()])|(?P<word>-?[A-Za-z]+:"[^"]*"|"[^"]*"|[^\s()]+)')


class QueryError(ValueError):
    """A query that can't be served."""


@dataclass(frozen=True)
class Term:
    field: str | None
    value: str

    def predicate(self, columns: list[str]) -> Column:
        value = self.value.lower()
        holds = lambda c: F.contains(F.lower(c), F.lit(value))
        match self.field:
            case None:
                return F.contains(F.col("searchtext"), F.lit(value))
            case "domain" | "sourcecountry":
                return holds(F.col(self.field))
            case "domainis":
                return F.lower("domain") == value
            case "sourcelang":
                return (F.lower("language") == value) | F.startswith(F.lower("language"), F.lit(value[:3]))
            case "quadclass":
                if not value.isdigit():
                    raise QueryError(f"quadclass takes a number from 1 to 4, not {self.value!r}")
                return F.array_contains("quadclasses", int(value))
        column = LISTS[self.field]
        if column not in columns:
            raise QueryError(f"this collection has no {self.field}")
        return F.exists(column, holds)


@dataclass(frozen=True)
class Group:
    """Terms of which one must hold, or none if the group is negated."""

    terms: tuple[Term, ...]
    negate: bool

    def predicate(self, columns: list[str]) -> Column:
        any_of = reduce(lambda a, b: a | b, (t.predicate(columns) for t in self.terms))
        return ~any_of if self.negate else any_of


def _term(word: str) -> tuple[Term, bool]:
    negate, word = word[0] == "-", word.removeprefix("-")
    if re.match(r"[A-Za-z]+[<>]", word):
        raise QueryError(f"comparisons such as {word!r} are not served")
    field, value = None, word
    if not word.startswith('"') and ":" in word:
        name, _, rest = word.partition(":")
        if name.lower() in FIELDS:
            field, value = name.lower(), rest
        elif name.lower() not in ("http", "https"):
            raise QueryError(f"unknown field {name!r}")
    value = value.strip('"').strip()
    if not value:
        raise QueryError("a term is empty")
    return Term(field, value), negate


def parse(query: str | None) -> list[Group]:
    """The groups of a query. A group's sign is that of its first term."""
    groups: list[list[tuple[Term, bool]]] = []
    is_open = inside = after_or = False
    for lexeme in _LEXEME.finditer(query or ""):
        if lexeme["paren"]:
            inside, is_open, after_or = lexeme["paren"] == "(", False, False
        elif lexeme["word"].upper() == "OR":
            if not is_open:
                raise QueryError("OR belongs between two terms")
            after_or = True
        else:
            term = _term(lexeme["word"])
            if is_open and (after_or or inside):
                groups[-1].append(term)
            else:
                groups.append([term])
            is_open, after_or = True, False
    return [Group(tuple(t for t, _ in g), g[0][1]) for g in groups]


def compile_query(query: str | None, columns: list[str]) -> Column | None:
    """One predicate for the whole query, for Catalyst to push down; None for an empty query."""
    parts = [g.predicate(columns) for g in parse(query)]
    return reduce(lambda a, b: a & b, parts) if parts else None


def search(articles: DataFrame, query: str | None) -> DataFrame:
    test = compile_query(query, articles.columns)
    return articles if test is None else articles.where(test)
