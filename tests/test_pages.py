"""Markup, extraction, features, page types and scores on hand-made pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siteglass.operators import features as P
from siteglass.operators import scoring
from siteglass.operators.extraction import extract, page_record
from siteglass.plans.analysis import analyze, analyze_features
from siteglass.sources.markup import Page, parse_pages

RICH = """<!doctype html><html><head><title> Plain &amp; title </title><meta property="og:title" content="Social title">
<meta name="description" content="What the page is about"><meta property="og:description" content="">
<meta name="viewport" content="width=device-width, initial-scale=1"><link rel="CANONICAL" href="/canon">
<meta name="robots" content="NOINDEX"><link rel="stylesheet" media="screen and (x)" href="https://cdn.e.com/a.css">
<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q1?","acceptedAnswer":{"@type":"Answer","text":"A1"}},
{"@type":"Question","name":"Q2?","acceptedAnswer":{"@type":"Answer","text":"A2"}},{"@type":"Other","name":"no"}]}</script>
<script type="application/ld+json">[{"@type":["Article","BlogPosting"]}]</script>
<script type="application/ld+json">{"author":{"@type":"Person","name":"Ld Author"},"datePublished":"2024-05-06","@type":"Article"}</script>
<script type="application/ld+json">{broken</script></head>
<body><header>Top bar</header><nav>Menu <a href="#x">skip</a></nav>
<main><h1>Main <em>head</em></h1><h2></h2><h2>How does it work?</h2><h3>Why not</h3>
<p>The answer is simple: read on.<p>Second paragraph, 42% of readers agree.
<a href="/in">Inside</a><a href="/in">Again</a><a href="https://en.wikipedia.org/x">Wiki</a><a href="javascript:void(0)">js</a><a href="mailto:me@e.com">mail</a>
<div class="faq-box"><dl><dt>Term?</dt><dd>Reply</dd><dt>Lonely?</dt></dl><div class="question">Ask?</div><div class="my-answer">Told.</div></div>
<img src="a.png" alt="A cat"><img src="b.png" alt=""><img srcset="c.png 2x"></main>
<div class="author-bio"><span class="byline">By <b>Kari Nordmann</b></span></div>
<time datetime="2024-01-02">Jan</time><aside>Aside</aside><script>var x = "</p>";</script><footer>Privacy policy</footer></body></html>"""


@pytest.fixture(scope="module")
def rich(spark):
    rows = spark.createDataFrame([(1, "https://e.com/dir/page", RICH)], "page_id long, url string, html string")
    return parse_pages(rows)


def test_extraction(rich):
    row = extract(rich).collect()[0].asDict(recursive=True)
    assert row["title"] == "Social title" and row["meta_description"] == "What the page is about" and row["canonical_url"] == "/canon"
    assert [(h["level"], h["text"]) for h in row["headings"]] == [(1, "Main head"), (2, "How does it work?"), (3, "Why not")]
    assert row["body"].startswith("Main head") and "Menu" not in row["body"] and "Privacy" not in row["body"] and "var x" not in row["body"]
    assert [(f["question"], f["answer"]) for f in row["faq"]] == [("Q1?", "A1"), ("Q2?", "A2"), ("Term?", "Reply"), ("Ask?", "Told.")]
    assert [(x["url"], x["anchor"]) for x in row["internal_links"]] == [("https://e.com/in", "Inside")]
    assert [x["url"] for x in row["outbound_links"]] == ["https://en.wikipedia.org/x", "mailto:me@e.com"]
    assert row["schema_types"] == ["FAQPage", "Question", "Answer", "Other", "Article", "BlogPosting", "Person"]
    assert row["author"] == "By Kari Nordmann" and row["date_published"] == "2024-01-02"
    assert row["metrics"]["content_length"] == len(RICH) and row["metrics"]["word_count"] == len(row["body"].split())


def test_json_ld_fallbacks(spark):
    html = '<body><script type="application/ld+json">{"author":"First"}</script><script type="application/ld+json">{"author":{"name":"Last"},"datePublished":"2020-01-01"}</script>x'
    row = extract(parse_pages(spark.createDataFrame([("https://e.com/", html)], "url string, html string"))).collect()[0]
    assert row["author"] == "Last" and row["date_published"] == "2020-01-01" and row["canonical_url"] == "https://e.com/"


def test_analysis_record(rich):
    row = page_record(rich).collect()[0].asDict(recursive=True)
    assert row["raw_title"].strip() == "Plain & title" and row["h2"] == ["", "How does it work?"]
    assert row["og_data"] == {"title": "Social title", "description": "", "image": "", "type": ""}
    assert row["links_internal"] == ["mailto:me@e.com"] and row["links_external"] == ["https://en.wikipedia.org/x"]
    assert [i["has_alt"] for i in row["images"]] == [True, False, False] and "var x" in row["body_text"]


def test_features(rich):
    row = P.with_page_type(P.features(rich, year=2024)).collect()[0].asDict(recursive=True)
    expected = {
        "has_direct_answer": True, "has_facts": True, "proper_hierarchy": True, "h2_count": 2, "heading_questions": 2, "question_headings": 2,
        "has_faq_section": True, "has_author": True, "has_author_bio": True, "has_contact": False, "authority_citations": 1,
        "publish_date": "2024-01-02", "update_date": None, "has_viewport": True, "has_mobile_css": True, "has_robots_meta": True, "noindex": True,
        "canonical_link": "/canon", "block_count": 3, "has_faq_schema": True, "faq_schema_questions": 3, "has_article_schema": True,
        "article_has_author": True, "article_has_date": True, "image_count": 3, "has_og_tags": True, "page_type": "blog", "has_table": False,
    }
    assert {k: row[k] for k in expected} == expected
    assert row["trust_signals"] == ["SSL certificate", "privacy policy"]
    assert row["images_with_alt"] == pytest.approx(100 / 3) and row["responsive_image_ratio"] == pytest.approx(1 / 3)
    assert row["block_types"] == ["FAQPage", "Article"]


TYPES = [
    ("https://e.com/", "", "homepage"), ("https://e.com/no", "", "homepage"), ("https://e.com/blog/x", "<button class='buy'>Buy product price</button>", "blog"),
    ("https://e.com/produkter/1", "", "product"), ("https://e.com/services/ai", "", "solution"), ("https://e.com/docs/intro", "", "resource"),
    ("https://e.com/pricing/?plan=pro", "", "conversion"),
    ("https://e.com/some-page", "<article><p class='byline'>Written by Ola Hansen</p></article>", "blog"),
    ("https://e.com/some-page", "<form class='signup-form'></form><p>Start free today</p>", "conversion"),
    ("https://e.com/some-page", "<div class='product'>technical details</div>", "product"),
    ("https://e.com/some-page", "<p>Our approach is to see the problem</p>", "solution"),
    ("https://e.com/some-page", "<p>A guide with examples</p>", "resource"),
    ("https://e.com/some-page", "<nav>x</nav> <header>h</header> <p>Welcome</p> <footer>f</footer>", "homepage"),
    ("https://e.com/some-page", "<p>Nothing to see.</p>", "resource"),
    ("https://e.com/some-page", "<p>kjøpt prissatt, helped</p>", "resource"),
]


def test_page_types(spark):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(TYPES)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["page_type"] for r in analyze_features(rows).select("page_id", "page_type").collect()}
    assert [got[i] for i in range(len(TYPES))] == [t for _, _, t in TYPES]


def test_scores_bounds_and_ranking(spark):
    rows = spark.createDataFrame([(1, "http://e.com/some/thing", RICH), (2, "https://e.com/x/y", "<p>short"), (3, "https://e.com/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r.asDict(recursive=True) for r in analyze(rows).collect()}
    for row in got.values():
        for c in ("overall_score", "content_score", "eat_score", "technical_score", "structured_data_score"):
            assert 0 <= row[c] <= 100
    # Structured data: present 20, FAQ 15 + 6, article 10 + 5 + 5, two kinds 3.
    assert got[1]["structured_data_score"] == 64
    issues = [r["issue"] for r in got[2]["recommendations"]]
    assert issues[:2] == ["No direct answer in opening", "Insufficient question-answer pairs"]
    assert issues.index("Content too short") < issues.index("Missing FAQ structured data") < issues.index("No structured data markup")
    ranks = [{"high": 3, "medium": 2, "low": 1}[r["priority"]] for r in got[2]["recommendations"]]
    assert ranks == sorted(ranks, reverse=True)
    assert "Site not using HTTPS" in [r["issue"] for r in got[1]["recommendations"]]


@pytest.mark.parametrize("kind,score", [("about", 45.0), ("contact", 55.0), ("service", 50.0), ("faq", 40.0), ("anything", 60.0)])
def test_eat_of_unreached_types(spark, kind, score):
    rows = spark.sql(
        "select true has_author, true has_author_bio, true has_contact, false has_contact_page, 1L authority_citations, true has_references,"
        "'2024' publish_date, '2024' update_date, array('expert') expertise, array('a') trust_signals, named_struct('score', 10.0D) trust_factors"
    )
    got = rows.select(scoring.eat_score(F.lit(kind)).alias("s")).collect()[0]["s"]
    table = scoring.EAT_POINTS["generic" if kind == "anything" else kind]
    expected = sum(table[:6]) + table[6][0] + table[7][0] + 10.0 * table[8][0]
    assert got == pytest.approx(expected)


def test_load_time_points_and_text(spark):
    rows = spark.createDataFrame([(1, "https://e.com/a/b", "<p>x", 3500)], "page_id long, url string, html string, ms int")
    found = analyze(rows, load_time=F.col("ms")).collect()[0]
    slow = [r for r in found["recommendations"] if r["issue"] == "Slow page loading"]
    assert slow and slow[0]["current"] == "Current load time: 3.50s"


def test_broken_markup():
    page = Page("<p>a<p>b<ul><li>x<li>y</ul></p><table><tr><td>1<td>2</table><a href=u>l<a href='v'>m</a><!-- <p> --><h2>t</h3>")
    assert page.tags == ["body", "p", "p", "ul", "li", "li", "p", "table", "tr", "td", "td", "a", "a", "h2"]
    texts = [page.text[a:b] for a, b in zip(page.a, page.b)]
    assert texts[1:6] == ["a", "b", "xy", "x", "y"] and texts[-3:] == ["l", "m", "t"]
    for i, last in enumerate(page.last):
        assert i <= last < len(page.tags) and page.parents[i] < i


def test_raw_text_entities_and_muting():
    page = Page('<title>a&lt;b</title><script>if (a<b) "</p>"</script><nav>n</nav><div role="navigation">m<b>k</b></div>keep')
    assert page.text[page.a[0] : page.b[0]] == "a<b" and page.kept == "a<bkeep"
    assert [page.ka[page.tags.index(t)] for t in ("nav", "b")] == [None, None]


def test_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, "https://e.com/", None), (2, "bad url", "<a href='/x'>y</a>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract(parse_pages(rows)).collect()}
    assert got[1]["body"] == "" and got[1]["metrics"]["word_count"] == 0 and got[2]["internal_links"] == []


def test_small_slices_give_the_same_rows(spark, monkeypatch):
    from siteglass.sources import markup

    rows = spark.createDataFrame([(i, "https://e.com/", f"<p data-x='1' class='c{i}'>{'w' * i}</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    want = {r["page_id"]: (r["page_text"], len(r["nodes"])) for r in parse_pages(rows).collect()}
    monkeypatch.setattr(markup, "SLICE_BYTES", 60)
    got = {r["page_id"]: (r["page_text"], len(r["nodes"])) for r in parse_pages(rows).collect()}
    assert got == want and len(got) == 40 and want[3] == ("www", 2)
