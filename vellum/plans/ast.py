"""Syntax tree of a search string."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Term(Node):
    term: str
    field: str | None = None
    boost: float | None = None


@dataclass(frozen=True)
class Phrase(Node):
    terms: tuple[str, ...]
    field: str | None = None
    slop: int | None = None
    boost: float | None = None


@dataclass(frozen=True)
class Wildcard(Node):
    pattern: str
    field: str | None = None
    boost: float | None = None


@dataclass(frozen=True)
class Range(Node):
    field: str
    low: str | None
    high: str | None
    inclusive: bool = True
    boost: float | None = None


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    boost: float | None = None
