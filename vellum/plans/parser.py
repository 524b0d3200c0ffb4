"""Parser of search strings.  It never fails: what it can't read becomes an empty term, which matches nothing.

    quick fox           either word            title:quick        in one field
    "quick fox"~2^3     phrase, slop, boost    qu?ck fo*          wildcards
    +quick -fox         required, excluded     a AND b, NOT c     the same in words
    (a b)^2             group                  year:[1 TO 9]      range (read, but not searchable)
"""

from __future__ import annotations

import re
from dataclasses import replace

from vellum.plans.ast import Bool, Node, Phrase, Range, Term, Wildcard

_STOPS = re.compile(r'[ \t\n:"()\[\]^+\-]')
_INTEGER = re.compile(r"\s*([+-]?\d+)")
_NUMBER = re.compile(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))")
_MUST, _SHOULD, _NOT = "must", "should", "must_not"


def parse(text: str) -> Node:
    return _Reader(text.strip()).clauses()


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def blanks(self) -> None:
        while self.next().isspace():
            self.at += 1

    def keyword(self, word: str) -> bool:
        """Takes the word if it stands here and a blank or the end follows."""
        end = self.at + len(word)
        if not self.text.startswith(word, self.at) or (end < len(self.text) and not self.text[end].isspace()):
            return False
        self.at = end
        self.blanks()
        return True

    def token(self) -> str:
        stop = _STOPS.search(self.text, self.at)
        begin, self.at = self.at, stop.start() if stop else len(self.text)
        return self.text[begin : self.at]

    def until(self, char: str) -> str:
        end = self.text.find(char, self.at)
        begin, self.at = self.at, end if end >= 0 else len(self.text)
        return self.text[begin : self.at].strip()

    def number(self, sign: str, form: re.Pattern, kind: type):
        """What follows the sign, or None; without a number nothing is taken."""
        if self.next() != sign:
            return None
        begin = self.at
        self.at += 1
        found = form.match(self.token())
        if not found:
            self.at = begin
            return None
        return kind(found[1].replace("Infinity", "inf"))

    def boost(self) -> float | None:
        return self.number("^", _NUMBER, float)

    def clauses(self) -> Node:
        found: list[tuple[str, Node]] = []
        while True:
            self.blanks()
            if self.next() in ("", ")"):
                break
            if self.keyword("OR"):
                continue
            if self.keyword("AND"):
                if found and found[-1][0] == _SHOULD:
                    found[-1] = (_MUST, found[-1][1])
                found.append((_MUST, self.clause()))
            elif self.keyword("NOT"):
                found.append((_NOT, self.clause()))
            elif self.next() in "+-":
                occur = _MUST if self.next() == "+" else _NOT
                self.at += 1
                found.append((occur, self.clause()))
            else:
                found.append((_SHOULD, self.clause()))
        if not found:
            return Term("")
        if len(found) == 1 and found[0][0] == _SHOULD:
            return found[0][1]
        return Bool(**{occur: tuple(n for o, n in found if o == occur) for occur in (_MUST, _SHOULD, _NOT)})

    def clause(self) -> Node:
        self.blanks()
        if self.next() == "(":
            self.at += 1
            inner = self.clauses()
            self.blanks()
            if self.next() == ")":
                self.at += 1
            boost = self.boost()
            return inner if boost is None else replace(inner, boost=boost)
        if self.next() == "[":
            return self.range("_default_")
        if self.next() == '"':
            return self.phrase(None)
        word = self.token()
        if not word:
            self.at += 1
            return Term("")
        if self.next() != ":":
            return self.word(word.lower(), None)
        self.at += 1
        if self.next() == '"':
            return self.phrase(word)
        if self.next() == "[":
            return self.range(word)
        return self.word(self.token(), word)

    def word(self, word: str, field: str | None) -> Node:
        boost = self.boost()
        if "*" in word or "?" in word:
            return Wildcard(word, field, boost)
        return Term(word.lower(), field, boost)

    def phrase(self, field: str | None) -> Phrase:
        self.at += 1
        end = self.text.find('"', self.at)
        inside = self.text[self.at : end if end >= 0 else len(self.text)]
        self.at = end + 1 if end >= 0 else len(self.text)
        terms = tuple(t.lower() for t in re.split("[ \t]+", inside) if t)
        slop = self.number("~", _INTEGER, int)
        return Phrase(terms, field, slop, self.boost())

    def range(self, field: str) -> Range:
        self.at += 1
        self.blanks()
        low = self.until(" ")
        self.blanks()
        if self.text.startswith("TO", self.at):
            self.at += 2
        self.blanks()
        high = self.until("]")
        if self.next() == "]":
            self.at += 1
        return Range(field, low or None, high or None, True, self.boost())


def contains_range(node: Node) -> bool:
    """Whether a range stands anywhere in the tree, excluded clauses included."""
    if isinstance(node, Bool):
        return any(contains_range(n) for part in (node.must, node.should, node.must_not) for n in part)
    return isinstance(node, Range)
