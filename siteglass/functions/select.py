"""Selectors over the element array of a page.

``nodes`` is ``array<struct<i, tag, parent, last, cls, id, attrs, text, a, b, ka, kb>>`` in document order:

* ``i``, ``parent``, ``last`` are element positions: the subtree of an element is i..last;
* ``cls`` is the class list padded with blanks, ``' x y '``, so a whole-word test is a substring test;
* ``text`` is filled for small text-bearing elements (links, headings, terms, titles);
* ``a``/``b`` slice the page text, ``ka``/``kb`` the page text without boilerplate subtrees.

A predicate is a Python function from a node column to a boolean column; it becomes one
lambda of a higher-order function, so matching never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Predicate = Callable[[Column], Column]

# JavaScript white space, which is wider than Java's.
JS_SPACE_CHARS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
JS_SPACE = f"[{JS_SPACE_CHARS}]"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, by way of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(text, f"{JS_SPACE}+", " "))


def words_of_squeezed(text: Column) -> Column:
    """Words of a text whose white space is already collapsed."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(blanks + 1)


def word_count(text: Column) -> Column:
    return let(squeeze(text), words_of_squeezed)


def yes(condition: Column) -> Column:
    """Null-safe truth."""
    return F.coalesce(condition, F.lit(False))


def tag(*names: str) -> Predicate:
    return lambda n: n["tag"].isin(*names) if len(names) > 1 else n["tag"] == names[0]


def has_class(*names: str) -> Predicate:
    def test(n: Column) -> Column:
        hit = n["cls"].contains(f" {names[0]} ")
        for name in names[1:]:
            hit = hit | n["cls"].contains(f" {name} ")
        return hit

    return test


def class_has(*pieces: str) -> Predicate:
    def test(n: Column) -> Column:
        hit = n["cls"].contains(pieces[0])
        for piece in pieces[1:]:
            hit = hit | n["cls"].contains(piece)
        return hit

    return test


def id_has(*pieces: str) -> Predicate:
    def test(n: Column) -> Column:
        hit = n["id"].contains(pieces[0])
        for piece in pieces[1:]:
            hit = hit | n["id"].contains(piece)
        return hit

    return test


def attr_is(name: str, value: str, fold: bool = False) -> Predicate:
    if fold:
        return lambda n: F.lower(n["attrs"][name]) == value
    return lambda n: n["attrs"][name] == value


def attr_has(name: str, piece: str, fold: bool = False) -> Predicate:
    if fold:
        return lambda n: F.lower(n["attrs"][name]).contains(piece)
    return lambda n: n["attrs"][name].contains(piece)


def has_attr(name: str) -> Predicate:
    return lambda n: n["attrs"][name].isNotNull()


def either(*tests: Predicate) -> Predicate:
    def test(n: Column) -> Column:
        hit = yes(tests[0](n))
        for t in tests[1:]:
            hit = hit | yes(t(n))
        return hit

    return test


def both(*tests: Predicate) -> Predicate:
    def test(n: Column) -> Column:
        hit = yes(tests[0](n))
        for t in tests[1:]:
            hit = hit & yes(t(n))
        return hit

    return test


def any_node(nodes: Column, test: Predicate) -> Column:
    return yes(F.exists(nodes, lambda n: yes(test(n))))


def pick(nodes: Column, test: Predicate) -> Column:
    return F.filter(nodes, lambda n: yes(test(n)))


def count_nodes(nodes: Column, test: Predicate) -> Column:
    return F.size(pick(nodes, test))


def first_value(nodes: Column, test: Predicate, value: Callable[[Column], Column]) -> Column:
    """``value`` of the first match; the filter runs once and ``value`` on one element."""
    return F.get(F.transform(F.slice(pick(nodes, test), 1, 1), value), F.lit(0))


def inside(nodes: Column, outer: Predicate) -> Predicate:
    """Has an ancestor that matches ``outer``."""
    return lambda n: F.exists(nodes, lambda m: yes(outer(m)) & (m["i"] < n["i"]) & (m["last"] >= n["i"]))


def slice_text(text: Column, node: Column) -> Column:
    """Text of an element, cut from the page text."""
    return F.substring(text, node["a"] + 1, node["b"] - node["a"])


def slice_kept(kept: Column, node: Column) -> Column:
    return F.substring(kept, node["ka"] + 1, node["kb"] - node["ka"])


def first_attr(nodes: Column, test: Predicate, name: str) -> Column:
    return first_value(nodes, test, lambda n: n["attrs"][name])


def joined_text(nodes: Column, test: Predicate, text: Column) -> Column:
    """Text of all matches, one after the other."""
    return F.array_join(F.transform(pick(nodes, test), lambda n: slice_text(text, n)), "")


def nonempty(text: Column) -> Column:
    return F.when(text != "", text)
