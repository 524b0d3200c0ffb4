"""Analyzers, each as a Column function (for documents) and as a Python function (for query words).

The standard analyzer lowercases, takes runs of ASCII letters, digits and underscores as tokens, numbers all of them from 1
and then drops tokens of one character and stop words, so positions keep gaps.  The keyword analyzer
makes one token of the trimmed, lowercased value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import scan

STOP_WORDS = tuple(
    sorted(
        set(
            "yet would with will while where when was until unless to though this then the that so since should shall or on of "
            "nor not no neither might may it is in if had has have from for else either does do did could can by but "
            "both been because be at as are were an although and a".split()
        )
    )
)

TOKENS = "array<struct<term:string,position:int>>"
_RUN = re.compile(r"[a-z0-9_]+")


@dataclass(frozen=True)
class Analyzer:
    """``cut`` and ``token``, which an analyzer may leave out, tell its tokens before they are made: ``cut`` has the word at each place, from 1,
    and ``token`` is the token of a word and whether it is one, so that tokens are counted and sought without making the others.  ``counter`` and
    ``finder``, which it may leave out too, do the same for whole texts: the number of tokens, and the tokens that are one of some terms."""

    name: str
    column: Callable[[Column], Column]
    words: Callable[[str], list[tuple[str, int]]]
    cut: Callable[[Column], Column] | None = None
    token: Callable[[Column], tuple[Column, Column]] | None = None
    counter: Callable[[Column], Column] | None = None
    finder: Callable[[Column, tuple[str, ...]], Column] | None = None

    def count(self, text: Column) -> Column:
        """The number of the text's tokens."""
        if self.counter is not None:
            return self.counter(text)
        if self.cut is None:
            return F.size(self.column(text))
        return F.size(F.filter(self.cut(text), lambda t: self.token(t)[1]))

    def sought(self, text: Column, wanted: Callable[[Column], Column], terms: tuple[str, ...] | None = None) -> Column:
        """array<struct<tokens, length>>: the tokens with a wanted term and the number of all, or nothing where no term is wanted.

        The text is cut once; tokens are counted only where one is wanted.  ``terms`` are all wanted ones, where they can be listed.
        """
        if terms is not None and self.finder is not None:
            return self.finder(text, terms)
        if self.cut is None:
            pick = lambda ts: F.filter(ts, lambda t: wanted(t["term"]))
            words, size = self.column(text), F.size
        else:
            pick = lambda ts: made(ts, self.token, wanted)
            words, size = self.cut(text), lambda ts: F.size(F.filter(ts, lambda t: self.token(t)[1]))
        some = lambda ts: F.filter(F.array(pick(ts)), lambda p: F.size(p) > 0)
        return F.get(F.transform(F.array(words), lambda ts: F.transform(some(ts), lambda p: F.struct(p.alias("tokens"), size(ts).alias("length")))), F.lit(0))


def made(words: Column, token: Callable[[Column], tuple[Column, Column]], wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<term, position>> of the words that are tokens, and wanted ones."""

    def one(t: Column, i: Column) -> Column:
        term, kept = token(t)
        kept = kept if wanted is None else wanted(term) & kept
        return F.when(kept, F.struct(term.alias("term"), i.cast("int").alias("position")))

    return F.filter(F.transform(words, one), lambda t: t.isNotNull())


def plain(text: Column) -> Column:
    """Of all characters but ASCII letters two have a lowercase form that holds one; they get it before words are lowercased."""
    return F.replace(F.replace(text, F.lit("\u212a"), F.lit("k")), F.lit("\u0130"), F.lit("i\u0307"))


def runs(text: Column) -> Column:
    """The runs of ASCII letters, digits and underscores in the lowercased text, as they come.

    Runs are cut first and lowercased one by one, which takes a quarter of the time: lowercasing whole texts and splitting at a negated set are both
    slow.
    """
    return F.transform(F.filter(F.split(plain(text), r"\W+"), lambda t: t != ""), lambda t: F.lower(t))


def standard_cut(text: Column) -> Column:
    """The runs, not lowercased, each at its number from 1: a text that begins with no run's character has a blank at 0."""
    return F.split(F.concat(F.lit(" "), plain(text)), r"\W+")


def standard_token(word: Column) -> tuple[Column, Column]:
    """Words are ASCII, so their bytes are their length; those longer than any stop word aren't looked up."""
    term, size = F.lower(word), F.octet_length(word)
    return term, (size >= 2) & ((size > max(map(len, STOP_WORDS))) | ~term.isin(*STOP_WORDS))


def standard_tokens(text: Column) -> Column:
    """array<struct<term, position>> of a string column; null and empty texts have none."""
    return made(standard_cut(text), standard_token)


def standard_words(text: str) -> list[tuple[str, int]]:
    stop = frozenset(STOP_WORDS)
    return [(t, i) for i, t in enumerate(_RUN.findall(text.lower()), 1) if len(t) >= 2 and t not in stop]


def keyword_cut(text: Column) -> Column:
    return F.array(F.lit(""), F.trim(F.lower(text)))


def keyword_token(word: Column) -> tuple[Column, Column]:
    return word, word != ""


def keyword_tokens(text: Column) -> Column:
    value = F.trim(F.lower(text))
    one = F.array(F.struct(value.alias("term"), F.lit(1).alias("position")))
    return F.when(value != "", one).otherwise(F.array().cast(TOKENS))


def keyword_words(text: str) -> list[tuple[str, int]]:
    value = text.lower().strip()
    return [(value, 1)] if value else []


def standard_count(text: Column) -> Column:
    return scan.count(text, STOP_WORDS)


def standard_find(text: Column, terms: tuple[str, ...]) -> Column:
    return scan.find(text, terms, STOP_WORDS)


STANDARD = Analyzer("standard", standard_tokens, standard_words, standard_cut, standard_token, standard_count, standard_find)
KEYWORD = Analyzer("keyword", keyword_tokens, keyword_words, keyword_cut, keyword_token)
_registry = {a.name: a for a in (STANDARD, KEYWORD)}


def register_analyzer(analyzer: Analyzer) -> None:
    """Makes an analyzer known by its name (an extension: the two built-in ones are all that queries need)."""
    _registry[analyzer.name] = analyzer


def get_analyzer(name: str) -> Analyzer:
    """The analyzer of that name; the standard one for any other name."""
    return _registry.get(name, STANDARD)
