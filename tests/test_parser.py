"""Search strings and the trees that they stand for."""

import pytest

from vellum.plans.ast import Bool, Phrase, Range, Term, Wildcard
from vellum.plans.compile import RANGE_ERROR, compile_query
from vellum.config import IndexConfig
from vellum.plans.parser import contains_range, parse

a, b, c = Term("a"), Term("b"), Term("c")
CASES = {
    "apple": Term("apple"),
    "  APPLE  ": Term("apple"),
    "": Term(""),
    "title:Apple": Term("apple", "title"),
    "Title:x": Term("x", "Title"),
    "title:": Term("", "title"),
    "apple^2": Term("apple", boost=2.0),
    "title:apple^0.5": Term("apple", "title", 0.5),
    "apple^": Bool(should=(Term("apple"), Term(""))),
    '"red apple"': Phrase(("red", "apple")),
    '"Red  Apple"': Phrase(("red", "apple")),
    '""': Phrase(()),
    'body:"red apple"': Phrase(("red", "apple"), "body"),
    '"red apple"~3': Phrase(("red", "apple"), slop=3),
    '"red apple"~0': Phrase(("red", "apple"), slop=0),
    '"red apple"^2': Phrase(("red", "apple"), boost=2.0),
    '"red apple"~1^1.5': Phrase(("red", "apple"), slop=1, boost=1.5),
    '"never closed': Phrase(("never", "closed")),
    "app*": Wildcard("app*"),
    "ap?le": Wildcard("ap?le"),
    "*": Wildcard("*"),
    "title:Ap*e^3": Wildcard("Ap*e", "title", 3.0),
    "a b": Bool(should=(a, b)),
    "a b c": Bool(should=(a, b, c)),
    "+a b": Bool(must=(a,), should=(b,)),
    "+a -b": Bool(must=(a,), must_not=(b,)),
    "-a": Bool(must_not=(a,)),
    "+a": Bool(must=(a,)),
    "a AND b": Bool(must=(a, b)),
    "a AND b AND c": Bool(must=(a, b, c)),
    "a OR b": Bool(should=(a, b)),
    "a AND b OR c": Bool(must=(a, b), should=(c,)),
    "a NOT b": Bool(should=(a,), must_not=(b,)),
    "NOT a": Bool(must_not=(a,)),
    "ANDROID": Term("android"),
    "ORa": Term("ora"),
    "and": Term("and"),
    "a-b": Bool(should=(a,), must_not=(b,)),
    "(a b)": Bool(should=(a, b)),
    "((a))": a,
    "(a)^2": Term("a", boost=2.0),
    "(a b)^2 c": Bool(should=(Bool(should=(a, b), boost=2.0), c)),
    "+(a b) +(b c)": Bool(must=(Bool(should=(a, b)), Bool(should=(b, c)))),
    "(a (b (c": Bool(should=(a, Bool(should=(b, c)))),
    "a -(b +c)": Bool(should=(a,), must_not=(Bool(must=(c,), should=(b,)),)),
    "year:[1 TO 9]": Range("year", "1", "9"),
    "[1 TO 9]": Range("_default_", "1", "9"),
    "year:[1 TO 9]^2": Range("year", "1", "9", True, 2.0),
    "year:[1 TO": Range("year", "1", None),
}


@pytest.mark.parametrize("text", CASES)
def test_trees(text):
    assert parse(text) == CASES[text]


@pytest.mark.parametrize("text", [")", "]", ":", "^^", "~", '"', "+", "-", "(", "[", "a:b:c", "()", "+-a", "\t\n", "[TO]", "x^y"])
def test_any_string_has_a_tree(text):
    node = parse(text)
    assert parse(text) == node
    if not contains_range(node):
        compile_query(node, ["title"], IndexConfig())


def test_ranges_are_found_anywhere():
    for text in ("year:[1 TO 2]", "a +(b -(c [1 TO 2]))"):
        assert contains_range(parse(text))
        with pytest.raises(ValueError) as e:
            compile_query(parse(text), ["year"], IndexConfig())
        assert str(e.value) == RANGE_ERROR
    assert not contains_range(parse("a -(b c)"))
