"""From a syntax tree to what a plan needs: which postings to read, how they score, and when a document matches.

A document is a hit where its structure matches, its score is positive, no excluded word occurs in it and it isn't deleted.  Each leaf's
match and score depend on that leaf alone:

* a term scores and matches by its own lowercased form, in one field or in all;
* a phrase scores like its words, each with the phrase's boost divided by their number, whether or not their places fit; it matches where
  the places fit, within the slop, of what the field's analyzer makes of its words;
* a wildcard scores and matches like all terms of its pattern.

A required clause must match; without required clauses one of the others must.  Excluded clauses count at the top only, where they exclude
by any of their analyzed words; wildcards exclude nothing.  A top that is a term or a wildcard has no condition but its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from vellum.config import IndexConfig
from vellum.plans.ast import Bool, Node, Phrase, Range, Term, Wildcard
from vellum.plans.parser import contains_range

RANGE_ERROR = (
    "Range queries ([min TO max]) are not yet implemented. Use the filter option for numeric/date range filtering, for instance filter=F.col('year') >= 2020"
)


def wildcard_regex(pattern: str) -> str:
    """``*`` is any run of characters, ``?`` any one; all others stand for themselves; case is ignored; the whole term must fit."""
    parts = (".*" if c == "*" else "." if c == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", c) for c in pattern)
    return "(?i)^" + "".join(parts) + r"\z"


@dataclass(frozen=True)
class Leaf:
    """A term or a wildcard (``regex``) in one field or, with None, in all."""

    field: str | None
    term: str
    regex: bool = False


@dataclass(frozen=True)
class PhraseIn:
    """A phrase as one field's analyzer sees it: (term, offset) of its words."""

    field: str
    words: tuple[tuple[str, int], ...]
    slop: int


# Conditions: ("leaf", Leaf) | ("phrase", PhraseIn) | ("active", field) | ("and" | "or", [...]) | ("true",) | ("false",)
Condition = tuple


@dataclass
class Compiled:
    scores: list[tuple[Leaf, float]] = field(default_factory=list)
    condition: Condition = ("true",)
    excluded: list[Leaf] = field(default_factory=list)
    loaded: set[Leaf] = field(default_factory=set)  # what makes a field active: the analyzed words of all but excluded clauses, and all wildcards

    def phrases(self) -> list[PhraseIn]:
        out: dict[PhraseIn, None] = {}

        def walk(c: Condition) -> None:
            if c[0] in ("and", "or"):
                for x in c[1]:
                    walk(x)
            elif c[0] == "phrase":
                out[c[1]] = None

        walk(self.condition)
        return list(out)

    def uses_active(self) -> bool:
        def walk(c: Condition) -> bool:
            return c[0] == "active" or c[0] in ("and", "or") and any(map(walk, c[1]))

        return walk(self.condition)

    def leaves(self) -> list[Leaf]:
        """All leaves that the condition asks for."""
        out: dict[Leaf, None] = {}

        def walk(c: Condition) -> None:
            if c[0] in ("and", "or"):
                for x in c[1]:
                    walk(x)
            elif c[0] == "leaf":
                out[c[1]] = None

        walk(self.condition)
        return list(out)


def phrase_words(terms: tuple[str, ...], name: str, config: IndexConfig) -> tuple[tuple[str, int], ...]:
    """Terms and offsets of a phrase: a word without a token takes one place, one with several takes as many as they span."""
    analyzer, out, offset = config.analyzer(name), [], 0
    for raw in terms:
        tokens = analyzer.words(raw)
        out += [(t, offset + p) for t, p in tokens]
        offset += tokens[-1][1] if tokens else 1
    return tuple(out)


def compile_query(root: Node, fields: list[str], config: IndexConfig) -> Compiled:
    """``fields`` are all fields that any segment indexes."""
    if contains_range(root):
        raise ValueError(RANGE_ERROR)
    out = Compiled()

    def analyzed(n: Node) -> list[Leaf]:
        """Terms that a clause stands for after analysis."""
        if isinstance(n, Bool):
            return [leaf for c in (*n.must, *n.should) for leaf in analyzed(c)]
        if isinstance(n, Term):
            return [Leaf(f, t) for f in ([n.field] if n.field else fields) for t in ([t for t, _ in config.analyzer(f).words(n.term)] or [n.term.lower()])]
        if isinstance(n, Phrase):
            return [Leaf(f, t) for f in ([n.field] if n.field else fields) for t, _ in phrase_words(n.terms, f, config)]
        return []

    def score(n: Node) -> None:
        boost = 1.0 if n.boost is None else n.boost
        if isinstance(n, Term):
            out.scores.append((Leaf(n.field, n.term), boost))
        elif isinstance(n, Phrase):
            out.scores.extend((Leaf(n.field, t), boost / len(n.terms)) for t in n.terms)
        elif isinstance(n, Wildcard):
            out.scores.append((Leaf(n.field, n.pattern, True), boost))
        elif isinstance(n, Bool):
            for c in (*n.must, *n.should):
                score(c)

    def wildcards(n: Node) -> list[Leaf]:
        if isinstance(n, Bool):
            return [x for c in (*n.must, *n.should, *n.must_not) for x in wildcards(c)]
        return [Leaf(n.field, n.pattern, True)] if isinstance(n, Wildcard) else []

    def structure(n: Node, top: bool) -> Condition:
        if isinstance(n, (Term, Wildcard)) and top or isinstance(n, Range):
            return ("true",)
        if isinstance(n, Term):
            return ("leaf", Leaf(n.field, n.term))
        if isinstance(n, Wildcard):
            return ("leaf", Leaf(n.field, n.pattern, True))
        if isinstance(n, Phrase):
            if not n.terms:
                return ("true",)
            options: list[Condition] = []
            for f in [n.field] if n.field else fields:
                words = phrase_words(n.terms, f, config)
                if words:
                    options.append(("phrase", PhraseIn(f, words, n.slop or 0)))
                else:
                    options.append(("true",) if n.field else ("active", f))
            return ("or", options) if options else ("false",)
        if n.must:
            return ("and", [structure(c, False) for c in n.must])
        return ("or", [structure(c, False) for c in n.should]) if n.should else ("true",)

    score(root)
    out.condition = structure(root, True)
    out.loaded = {*analyzed(root), *wildcards(root)}
    if isinstance(root, Bool):
        out.excluded = list(dict.fromkeys(leaf for c in root.must_not for leaf in analyzed(c)))
    return out
