from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siteglass.functions import urls as U

CASES = [
    # url, storage form, crawl form with the default ignore list, strict form
    ("HTTP://Shop.Example.com:80/A/?b=2&a=1#x", "http://shop.example.com/A?b=2&a=1#x", "http://shop.example.com/A?a=1&b=2", "https://shop.example.com/A?a=1&b=2"),
    ("https://e.com", "https://e.com/", "https://e.com/", "https://e.com/"),
    ("https://e.com:443/x/", "https://e.com/x", "https://e.com/x", "https://e.com/x"),
    ("http://e.com:443/", "http://e.com:443/", "http://e.com:443/", "https://e.com/"),
    ("https://e.com:8443/a/../b/./c", "https://e.com:8443/b/c", "https://e.com:8443/b/c", "https://e.com:8443/b/c"),
    ("https://e.com/p?utm_source=n&page=2&ref=y", "https://e.com/p?utm_source=n&page=2&ref=y", "https://e.com/p?page=2", "https://e.com/p?page=2"),
    ("https://e.com/p?source=a&mc_zz=1&z=1", "https://e.com/p?source=a&mc_zz=1&z=1", "https://e.com/p?z=1", "https://e.com/p?mc_zz=1&source=a&z=1"),
    ("https://e.com/p?a=x y&a=é", "https://e.com/p?a=x%20y&a=%C3%A9", "https://e.com/p?a=x+y&a=%C3%A9", "https://e.com/p?a=x+y&a=%C3%A9"),
    ("https://e.com/p?B=1&a=2&A=3", "https://e.com/p?B=1&a=2&A=3", "https://e.com/p?A=3&B=1&a=2", "https://e.com/p?a=2&A=3&B=1"),
    ("https://e.com/für", "https://e.com/f%C3%BCr", "https://e.com/f%C3%BCr", "https://e.com/f%C3%BCr"),
    ("mailto:a@b.no", "mailto:a@b.no", "mailto:a@b.no", None),
    ("not a url", "not a url", "not a url", None),
    ("ftp://e.com/a", "ftp://e.com/a", "ftp://e.com/a", None),
]


def test_three_forms(evaluate):
    u = F.col("u")
    got = evaluate([(c[0],) for c in CASES], "u string", {
        "storage": U.normalize_storage(u), "crawl": U.normalize_crawl(u, U.DEFAULT_IGNORE_PARAMS), "strict": U.normalize_strict(u),
    })
    for case, row in zip(CASES, got):
        assert (row["storage"], row["crawl"], row["strict"]) == case[1:], case[0]


def test_forms_are_idempotent_and_hash_agrees(evaluate):
    u = F.col("u")
    rows = evaluate([(c[0],) for c in CASES], "u string", {
        "strict": U.normalize_strict(u), "again": U.normalize_strict(U.normalize_strict(u)),
        "crawl": U.normalize_crawl(u), "crawl_again": U.normalize_crawl(U.normalize_crawl(u)), "hash": U.strict_url_hash(u),
    })
    for r in rows:
        assert r["strict"] == r["again"] and r["crawl"] == r["crawl_again"]
        assert (r["hash"] is None) == (r["strict"] is None)


def test_options(evaluate):
    u = F.col("u")
    row = evaluate([("https://e.com/x/?b=1&a=2#f",)], "u string", {
        "keep_slash": U.normalize_crawl(u, remove_trailing_slash=False), "unsorted": U.normalize_crawl(u, sort_params=False),
        "fragment": U.normalize_crawl(u, remove_fragment=False),
    })[0]
    assert row == {"keep_slash": "https://e.com/x/?a=2&b=1", "unsorted": "https://e.com/x?b=1&a=2", "fragment": "https://e.com/x?a=2&b=1#f"}


@pytest.mark.parametrize("url,expected", [
    ("https://e.com/?page=2", True), ("https://e.com/?q=1&pg", True), ("https://e.com/?homepage=2", False), ("https://e.com/page", False), ("nope", False),
])
def test_pagination(evaluate, url, expected):
    assert evaluate([(url,)], "u string", {"p": U.has_pagination_params(F.col("u"))})[0]["p"] is expected


def test_resolve(evaluate):
    base = "https://e.com/a/b?q=1#f"
    cases = [
        ("c", "https://e.com/a/c"), ("../c", "https://e.com/c"), ("/c?x#y", "https://e.com/c?x#y"), ("//o.com/x", "https://o.com/x"),
        ("?z=2", "https://e.com/a/b?z=2"), ("http://O.com", "http://o.com/"), ("mailto:x@y.z", "mailto:x@y.z"), ("", "https://e.com/a/b?q=1"),
    ]
    got = evaluate([(r, base) for r, _ in cases], "r string, b string", {"x": U.resolve(F.col("r"), F.col("b"))})
    assert [g["x"] for g in got] == [e for _, e in cases]


def test_canonical(evaluate):
    link = '<html><link href="/real/" rel="canonical"><meta property="og:url" content="https://og.com/">'
    og = "<meta property='og:url' content='https://og.com/x/'>"
    rel = '<link rel="canonical" href="https://E.com/p">'
    url = "http://e.com/p?utm_source=x"
    rows = evaluate([(url, link), (url, og), (url, rel), (url, None), ("mailto:x", rel)], "u string, h string", {
        "declared": U.canonical_from_html(F.col("h"), F.col("u")), "crawl": U.resolve_canonical_crawl(F.col("u"), F.col("h")),
        "s": U.resolve_canonical_strict(F.col("u"), F.col("h")),
    })
    assert [r["declared"] for r in rows[:4]] == ["/real/", "https://og.com/x/", "https://E.com/p", url]
    assert rows[1]["crawl"] == "https://og.com/x"
    assert rows[0]["s"] == {"url": "https://e.com/real", "is_canonical": False, "original_url": "https://e.com/p"}
    assert rows[1]["s"]["url"] == "https://e.com/p" and rows[1]["s"]["original_url"] is None
    assert rows[2]["s"]["is_canonical"] is True
    assert rows[4]["s"] == {"url": None, "is_canonical": False, "original_url": None}


def test_patterns_duplicates_slugs(evaluate):
    row = evaluate([("https://e.com/blog/x", "http://E.com/blog/x/")], "a string, b string", {
        "dup": U.duplicates(F.col("a"), F.col("b")), "eq": U.equivalent(F.col("a"), F.col("b")), "host": U.same_host(F.col("a"), F.col("b")),
        "none": U.duplicates(F.lit("x"), F.lit("x")), "inc": U.passes_patterns(F.col("a"), ["/news", "/blog"]), "exc": U.passes_patterns(F.col("a"), ["/blog"], ["e.com"]),
        "slug": U.slug(F.lit("--Acme & Søn AS! ")), "is": U.is_slug(F.lit("a-b-1")), "isnt": U.is_slug(F.lit("a--b")),
    })[0]
    assert row == {"dup": True, "eq": False, "host": True, "none": False, "inc": True, "exc": False, "slug": "acme-s-n-as", "is": True, "isnt": False}
