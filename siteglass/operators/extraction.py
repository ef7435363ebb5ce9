"""Structured extraction: parsed pages -> title, links, headings, FAQ, author, dates, body, metrics.

No shuffle: each stage is a projection over the element array of the same row. Values used
more than once become columns of an earlier stage, so a lambda never re-evaluates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import select as S
from ..functions.build import built_once
from ..functions import urls as U
from ..sources.markup import parse_pages

# --- fixed values: where the main text is looked for, in order ---------------
MAIN_REGIONS = (
    S.tag("main"),
    S.tag("article"),
    S.attr_is("role", "main"),
    lambda n: n["id"] == "content",
    lambda n: n["id"] == "main-content",
    S.has_class("content"),
    S.has_class("main-content"),
    S.tag("body"),
)
AUTHOR_MARKS = (
    S.both(S.tag("meta"), S.attr_is("name", "author")),
    S.both(S.tag("meta"), S.attr_is("property", "article:author")),
    S.attr_is("rel", "author", fold=True),
    S.has_class("author"),
    S.class_has("author"),
    S.attr_is("itemprop", "author"),
)
PUBLISHED_MARKS = (
    S.both(S.tag("meta"), S.attr_is("property", "article:published_time")),
    S.both(S.tag("meta"), S.attr_is("name", "publication_date")),
    S.both(S.tag("meta"), S.attr_is("name", "date")),
    S.both(S.tag("time"), S.has_attr("datetime")),
    S.attr_is("itemprop", "datePublished"),
)
FAQ_SECTION = S.either(S.class_has("faq"), S.id_has("faq"))
# ------------------------------------------------------------------------------
_FAQ_JSON = (
    "struct<`@type`:string,mainEntity:array<struct<`@type`:string,name:string,"
    "acceptedAnswer:struct<`@type`:string,text:string>>>>"
)
_QA = "array<struct<question:string,answer:string>>"


def meta(nodes: Column, key: str, value: str) -> Column:
    """``content`` of the first meta element with this name or property."""
    return S.first_attr(nodes, S.both(S.tag("meta"), S.attr_is(key, value)), "content")


def canonical_href(nodes: Column) -> Column:
    return S.first_attr(nodes, S.both(S.tag("link"), S.attr_is("rel", "canonical", fold=True)), "href")


def title_of(nodes: Column) -> Column:
    """All ``<title>`` text, untrimmed."""
    return F.array_join(F.transform(S.pick(nodes, S.tag("title")), lambda n: n["text"]), "")


def _sibling(nodes: Column, n: Column, test: S.Predicate) -> Column:
    """Next element with the same parent, if it matches."""
    nxt = F.get(nodes, n["last"] + 1)
    return F.when((nxt["parent"] == n["parent"]) & S.yes(test(nxt)), nxt)


def _faq_from_json(blocks: Column) -> Column:
    docs = F.filter(F.transform(blocks, lambda t: F.from_json(t, _FAQ_JSON)), lambda d: d["@type"] == "FAQPage")

    def answers(doc: Column) -> Column:
        items = F.filter(F.coalesce(doc["mainEntity"], F.array().cast(f"array<struct<`@type`:string,name:string,acceptedAnswer:struct<`@type`:string,text:string>>>")), lambda q: q["@type"] == "Question")
        return F.transform(
            items,
            lambda q: F.struct(
                F.coalesce(q["name"], F.lit("")).alias("question"),
                F.when(q["acceptedAnswer"]["@type"] == "Answer", q["acceptedAnswer"]["text"])
                .otherwise(F.coalesce(q["acceptedAnswer"]["text"], F.lit("")))
                .alias("answer"),
            ),
        )

    return F.flatten(F.transform(docs, answers))


@built_once
def _marked_columns() -> dict[str, Column]:
    nodes, text, blocks = F.col("nodes"), F.col("page_text"), F.col("json_ld")
    return {
        "faq": F.concat(_faq_from_json(blocks), _faq_from_markup(nodes, text)),
        "author": _author(nodes, text, blocks),
        "date_published": _published(nodes, blocks),
    }


def _faq_from_markup(nodes: Column, text: Column) -> Column:
    def pair(question: Column, answer: Column) -> Column:
        return F.struct(
            S.trim(question).alias("question"), F.coalesce(S.trim(answer), F.lit("")).alias("answer")
        )

    def of_section(section: Column) -> Column:
        within = F.slice(nodes, section["i"] + 2, section["last"] - section["i"])
        terms = F.transform(
            S.pick(within, S.tag("dt")), lambda n: pair(n["text"], _sibling(nodes, n, S.tag("dd"))["text"])
        )

        def block(n: Column) -> Column:
            reply = _sibling(nodes, n, S.class_has("answer"))
            return pair(S.slice_text(text, n), F.when(reply.isNotNull(), S.slice_text(text, reply)))

        blocks = F.transform(S.pick(within, S.class_has("question")), block)
        return F.filter(F.concat(terms, blocks), lambda p: (p["question"] != "") & (p["answer"] != ""))

    return F.flatten(F.transform(S.pick(nodes, FAQ_SECTION), of_section))


def _truthy_json(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "false", "0", "null")


def _last(values: Column) -> Column:
    return F.get(F.slice(values, -1, 1), F.lit(0))


def _author(nodes: Column, text: Column, blocks: Column) -> Column:
    def value(n: Column) -> Column:
        return F.coalesce(
            S.nonempty(n["attrs"]["content"]), S.nonempty(n["attrs"]["href"]), S.nonempty(S.trim(S.slice_text(text, n)))
        )

    named = F.filter(blocks, lambda t: _truthy_json(F.get_json_object(t, "$.author")))

    def from_json(t: Column) -> Column:
        plain = F.get_json_object(t, "$.author")
        return F.when(plain.rlike(r"^[\[{]"), F.get_json_object(t, "$.author.name")).otherwise(plain)

    return F.coalesce(
        *[S.first_value(nodes, m, value) for m in AUTHOR_MARKS], S.nonempty(_last(F.transform(named, from_json)))
    )


def _published(nodes: Column, blocks: Column) -> Column:
    def value(n: Column) -> Column:
        return F.coalesce(S.nonempty(n["attrs"]["content"]), S.nonempty(n["attrs"]["datetime"]))

    dated = F.filter(F.transform(blocks, lambda t: F.get_json_object(t, "$.datePublished")), _truthy_json)
    return F.coalesce(*[S.first_value(nodes, m, value) for m in PUBLISHED_MARKS], _last(dated))


def _main_text(nodes: Column, kept: Column) -> Column:
    def region(test: S.Predicate) -> Column:
        hits = F.filter(nodes, lambda n: n["ka"].isNotNull() & S.yes(test(n)))
        return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda n: S.slice_kept(kept, n)), ""))

    return F.coalesce(*[region(r) for r in MAIN_REGIONS], F.lit(""))


def _same_url_runs(sorted_links: Column) -> Column:
    """First link of every URL from links sorted by (url, pos)."""
    return F.filter(
        sorted_links,
        lambda x, i: (i == 0) | (F.get(sorted_links, F.greatest(i - 1, F.lit(0)))["url"] != x["url"]),
    )


def extract(parsed: DataFrame, url: str = "url", load_time: Column | None = None, render_method: str = "static") -> DataFrame:
    """Add the extraction columns and ``metrics`` to parsed pages."""
    nodes, kept = F.col("nodes"), F.col("kept_text")
    page_url = F.col(url)

    def link(n: Column) -> Column:
        return F.struct(
            U.resolve(n["attrs"]["href"], F.col(url)).alias("url"), n["i"].alias("pos"), S.trim(n["text"]).alias("anchor")
        )

    followed = S.both(
        S.tag("a"),
        lambda n: (n["attrs"]["href"] != "") & ~n["attrs"]["href"].startswith("#") & ~n["attrs"]["href"].startswith("javascript:"),
    )
    staged = (
        parsed.withColumn("host", U.host_of(page_url))
        .withColumn("_links", F.array_sort(F.filter(F.transform(S.pick(nodes, followed), link), lambda x: x["url"].isNotNull())))
        .withColumn("_distinct", F.array_sort(F.transform(
            _same_url_runs(F.col("_links")),
            lambda x: F.struct(x["pos"], x["url"], x["anchor"], S.yes(U.host_of(x["url"]) == F.col("host")).alias("own")),
        )))
        .withColumn("body", S.squeeze(_main_text(nodes, kept)))
    )

    def side(own: bool) -> Column:
        chosen = F.filter(F.col("_distinct"), lambda x: x["own"] if own else ~x["own"])
        return F.transform(chosen, lambda x: F.struct(x["url"].alias("url"), x["anchor"].alias("anchor")))

    headings = F.filter(
        F.transform(
            S.pick(nodes, S.tag("h1", "h2", "h3", "h4", "h5", "h6")),
            lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), S.trim(n["text"]).alias("text")),
        ),
        lambda h: h["text"] != "",
    )
    return (
        staged.withColumns(
            {
                "title": S.trim(F.coalesce(S.nonempty(meta(nodes, "property", "og:title")), title_of(nodes), F.lit(""))),
                "meta_description": S.trim(F.coalesce(
                    S.nonempty(meta(nodes, "property", "og:description")), meta(nodes, "name", "description"), F.lit("")
                )),
                "canonical_url": F.coalesce(
                    S.nonempty(canonical_href(nodes)), S.nonempty(meta(nodes, "property", "og:url")), page_url
                ),
                "headings": headings,
                **_marked_columns(),
                "internal_links": side(True),
                "outbound_links": side(False),
                "metrics": F.struct(
                    (F.lit(None) if load_time is None else load_time).cast("int").alias("load_time_ms"),
                    F.col("html_length").cast("int").alias("content_length"),
                    S.words_of_squeezed(F.col("body")).alias("word_count"),
                    F.lit(render_method).alias("render_method"),
                ),
            }
        ).drop("_links", "_distinct")
    )


EXTRACTION_FIELDS = (
    "title", "meta_description", "canonical_url", "headings", "body", "faq",
    "internal_links", "outbound_links", "schema_types", "author", "date_published",
)


def extract_pages(pages: DataFrame, closed_references: bool = False, **options) -> DataFrame:
    """Raw pages (page_id, url, html) to page_id, url, extraction struct columns and metrics."""
    return extract(parse_pages(pages, closed_references=closed_references), **options).drop("nodes", "page_text", "kept_text", "json_ld", "html_length")


def page_record(parsed: DataFrame, url: str = "url") -> DataFrame:
    """The analysis record: raw title, full body text, h1-h3, Open Graph data, links by host substring, images."""
    nodes, text = F.col("nodes"), F.col("page_text")
    hrefs = F.transform(S.pick(nodes, S.both(S.tag("a"), lambda n: n["attrs"]["href"] != "")), lambda n: n["attrs"]["href"])
    host = F.coalesce(F.col("page_host"), F.lit(""))

    def level(name: str) -> Column:
        return F.transform(S.pick(nodes, S.tag(name)), lambda n: S.trim(n["text"]))

    def og(name: str) -> Column:
        return F.coalesce(meta(nodes, "property", f"og:{name}"), F.lit("")).alias(name)

    return (
        parsed.withColumns({"page_host": U.host_of(F.col(url)), "hrefs": hrefs})
        .withColumns(
            {
                "raw_title": title_of(nodes),
                "raw_description": F.coalesce(meta(nodes, "name", "description"), F.lit("")),
                "body_text": S.joined_text(nodes, S.tag("body"), text),
                "og_data": F.struct(*[og(n) for n in ("title", "description", "image", "type")]),
                "h1": level("h1"),
                "h2": level("h2"),
                "h3": level("h3"),
                "links_internal": F.filter("hrefs", lambda h: h.contains(host)),
                "links_external": F.filter("hrefs", lambda h: h.startswith("http") & ~h.contains(host)),
                "images": F.transform(
                    S.pick(nodes, S.tag("img")),
                    lambda n: F.struct(
                        F.coalesce(n["attrs"]["src"], F.lit("")).alias("src"),
                        F.coalesce(n["attrs"]["alt"], F.lit("")).alias("alt"),
                        S.yes(n["attrs"]["alt"] != "").alias("has_alt"),
                    ),
                ),
            }
        )
        .drop("hrefs")
    )
