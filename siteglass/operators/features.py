"""Page features and page type, from parsed pages.

Three staged projections, no shuffle: (1) the page record, (2) markup and text flags,
(3) everything that depends on the page type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import select as S
from ..functions.build import built_once
from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import points, ratio
from .extraction import canonical_href, meta, page_record

# --- fixed values ---------------------------------------------------------------
PAGE_TYPES = ("homepage", "product", "solution", "blog", "resource", "conversion")
# Tested in this order against the whole URL.
URL_TYPES = (
    ("blog", r"/blog[gs]?|blogg|/article|/post|/news|nyheter"),
    ("product", r"/products?|produkter?|/shop|/buy|/item|kjop"),
    ("solution", r"/solutions?|losning|løsning|services?|tjenester?|/feature"),
    ("resource", r"/resources?|/guide|tutorial|documentation|/docs|/help|support|/faq|hjelp"),
    ("conversion", r"/pricing|/price|/contact|kontakt|/signup|register|/demo|/trial|get-started|bestill"),
)
AUTHORITY_DOMAINS = (
    "wikipedia.org", "gov", "edu", "nih.gov", "cdc.gov", "who.int", "nature.com", "science.org",
)
BLOG_TEXT = r"(?<![A-Za-z0-9_])(publisert|published|forfatter|author|av\s+[a-z]|written by|posted by)"
CTA_WORDS = ("get started", "sign up", "free trial", "request demo", "contact us", "book a demo", "start free", "subscribe")
ORDER_WORDS = ("kontakt oss", "få tilbud", "bestill", "order now", "buy now", "purchase")
PRODUCT_WORDS = (
    "produkt", "product", "buy", "kjøp", "price", "pris", "add to cart", "legg i handlekurv", "specifications", "specs")
FEATURE_WORDS = ("features", "benefits", "fordeler", "technical details", "dimensions")
SOLUTION_WORDS = ("solution", "løsning", "service", "tjeneste", "how we", "hvordan vi", "our approach", "vår tilnærming")
PROBLEM_WORDS = ("problem", "utfordring", "challenge", "need", "behov", "pain point")
OUTCOME_WORDS = ("benefit", "fordel", "advantage", "result", "resultat", "outcome")
SOLUTION_TITLE = "solution|løsning|service"
GUIDE_WORDS = ("guide", "veiledning", "tutorial", "how to", "hvordan", "documentation", "docs", "learn", "lær", "reference")
STEP_WORDS = ("step", "steg", "instruction", "tips", "best practices", "examples", "eksempler")
DOWNLOAD_WORDS = ("download", "last ned", "pdf", "template", "mal", "worksheet", "checklist")
WELCOME_WORDS = ("velkommen", "welcome", "hjem", "home", "hovedside")
COMPANY_WORDS = ("team", "ansatte", "grunnlagt", "founded", "historie", "history")
MISSION_WORDS = ("mission", "visjon", "vision", "values", "verdier")
PLACE_WORDS = ("addresse", "address", "location", "lokasjon")
GUARANTEE_WORDS = ("garantie", "guarantee", "refund", "pengene tilbake")
PHONE_TEXT = r"\+?[0-9]{2,4}[\s\-]?[0-9]{2,4}[\s\-]?[0-9]{2,4}"
EMAIL_TEXT = r"@[A-Za-z0-9_.\-]+\.[A-Za-z0-9_]+"

# Date marks in order, as SQL over an element ``n`` (class lists are padded with blanks).
_TIME = "n.tag = 'time' and n.attrs['datetime'] is not null"


def _is_class(name: str, n: str = "n") -> str:
    return f"contains({n}.cls, ' {name} ')"


def _inside(outer: str, inner: str) -> str:
    """``inner`` holds for the element and ``outer`` (over ``m``) for one of its ancestors."""
    return f"{inner} and exists(nodes, m -> {outer} and m.i < n.i and m.last >= n.i)"


PUBLISH_MARKS = (
    _TIME,
    "n.attrs['datetime'] is not null",
    "n.attrs['property'] = 'article:published_time'",
    "n.attrs['name'] = 'article:published_time'",
    "n.attrs['property'] = 'datePublished'",
    *[_is_class(c) for c in ("published", "date", "post-date", "entry-date", "publish-date")],
    "contains(n.cls, 'publish')", "contains(n.cls, 'date')", "contains(n.id, 'date')",
    *[_is_class(c) for c in ("dato", "publisert", "opprettet", "blogg-dato", "artikkel-dato")],
    "contains(n.cls, 'dato')", "contains(n.cls, 'publiser')", "contains(n.id, 'dato')",
    *[_inside(_is_class(c, "m"), _is_class("date")) for c in ("byline", "meta", "post-meta", "article-meta")],
    _inside("m.tag = 'header'", _is_class("date")),
    _inside(_is_class("entry-meta", "m"), "n.tag = 'time'"),
    _inside(_is_class("post-info", "m"), _is_class("date")),
)
UPDATE_MARKS = (
    "n.attrs['property'] = 'article:modified_time'",
    "n.attrs['name'] = 'article:modified_time'",
    "n.attrs['property'] = 'dateModified'",
    f"{_TIME} and contains(n.cls, 'updated')",
    f"{_TIME} and contains(n.cls, 'modified')",
    "contains(n.cls, 'updated')", "contains(n.cls, 'modified')", "contains(n.cls, 'last-modified')",
    *[_is_class(c) for c in ("last-updated", "modified-date", "update-date")],
    "contains(n.cls, 'oppdatert')", "contains(n.cls, 'endret')", "contains(n.cls, 'sist-endret')",
    *[_is_class(c) for c in ("oppdatert", "endret", "sist-endret", "sist-oppdatert")],
    *[_inside(_is_class(c, "m"), _is_class("updated")) for c in ("meta", "post-meta", "article-meta")],
)
AUTHOR_ELEMENT = S.either(
    S.attr_is("rel", "author", fold=True), S.class_has("author", "writer"), S.id_has("author"),
    S.has_class("byline", "posted-by", "written-by"),
)
FAQ_ELEMENT = S.either(S.class_has("faq", "question"), S.id_has("faq", "question"))
NAVIGATION = S.either(S.tag("nav"), S.attr_is("role", "navigation"))
# ----------------------------------------------------------------------------------


def _date(marks: Sequence[str], patterns: Sequence[str]) -> Column:
    """Value of the first mark whose first element carries one longer than four characters, else a date in the text."""
    value = (
        "n -> coalesce(nullif(n.attrs['datetime'], ''), nullif(n.attrs['content'], ''), "
        f"nullif(regexp_replace(substring(page_text, n.a + 1, n.b - n.a), r'^{S.JS_SPACE}+|{S.JS_SPACE}+$', ''), ''))"
    )
    found = [
        f"get(filter(transform(slice(filter(marked, n -> coalesce({mark}, false)), 1, 1), {value}), v -> length(v) > 4), 0)" for mark in marks
    ]
    return F.coalesce(F.expr(f"coalesce({', '.join(found)})"), X.first_date(F.col("body_text"), patterns))


def _ld_type(t: Column) -> Column:
    return F.get_json_object(t, "$['@type']")


def _json_size(t: Column, path: str) -> Column:
    """Length of a JSON array (or string) member; 0 where there is none."""
    member = F.get_json_object(t, path)
    return F.coalesce(F.when(member.startswith("{"), F.lit(0)).otherwise(F.coalesce(F.json_array_length(member), F.length(member))), F.lit(0))


def _first_block(test) -> Column:
    return F.get(F.filter("json_ld", test), F.lit(0))


def record(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Stage 1: page record plus the element subset that carries attributes."""
    base = page_record(parsed, url)
    return base.withColumns(
        {
            "body_lower": F.lower("body_text"),
            "marked": F.filter("nodes", lambda n: (F.size(n["attrs"]) > 0) | n["cls"].isNotNull() | n["id"].isNotNull()),
            "url_path": F.coalesce(U.path_of(F.col(url)), F.lit("")),
        }
    )


def features(parsed: DataFrame, url: str = "url", load_time: Column | None = None, year: int | None = None) -> DataFrame:
    """Stages 1 and 2: one flat row of features per page (page type not yet decided).

    ``year`` is the year looked for as "current"; without it that flag is false. A missing load
    time counts as 0, as for pages read without a browser.
    """
    rows = record(parsed, url)
    for stage in feature_stages(url, year):
        rows = rows.withColumns(stage)
    load = F.coalesce(F.lit(0) if load_time is None else load_time, F.lit(0)).cast("double")
    return rows.withColumn("load_time", load).drop("_marked_lists", "_lists")


@built_once
def feature_stages(url: str, year: int | None) -> tuple[dict[str, Column], ...]:
    """The feature columns in stages: a stage only uses columns of earlier ones."""
    nodes, marked, body, lower = (F.col(c) for c in ("nodes", "marked", "body_text", "body_lower"))
    question_headings = S.pick(nodes, S.both(S.tag("h2", "h3", "h4"), lambda n: X.is_question(n["text"])))
    ordered, bulleted = S.tag("ol"), S.tag("ul")
    lists = S.pick(nodes, S.tag("ol", "ul"))
    first_p = S.first_value(nodes, S.tag("p"), lambda n: S.slice_text(F.col("page_text"), n))
    first = {
            "_marked_lists": S.pick(nodes, S.tag("li", "ol", "ul")),
            "_lists": lists,
            "first_paragraph": F.coalesce(first_p, F.lit("")),
            "paragraph_count": S.count_nodes(nodes, S.tag("p")),
            "heading_texts": F.concat("h1", "h2", "h3"),
            "footer_text": S.joined_text(nodes, S.tag("footer"), F.col("page_text")),
            "overview_keywords": X.matched_keywords(lower, X.AI_OVERVIEW_KEYWORDS),
            "publish_date": _date(PUBLISH_MARKS, X.PUBLISH_DATES),
            "update_date": _date(UPDATE_MARKS, X.UPDATE_DATES),
            "faq_block": _first_block(lambda t: (_ld_type(t) == "FAQPage") | (_ld_type(t).startswith("[") & _ld_type(t).contains('"FAQPage"'))),
            "howto_block": _first_block(lambda t: _ld_type(t) == "HowTo"),
            "article_block": _first_block(lambda t: _ld_type(t).isin("Article", "BlogPosting", "NewsArticle")),
            "breadcrumb_block": _first_block(lambda t: _ld_type(t) == "BreadcrumbList"),
        }

    def items_in(kind: S.Predicate) -> Column:
        """Items inside a list of the kind. Elements stand in document order and nest, so an item is inside one exactly
        where the furthest end of the lists before it is not behind it: one pass, however many lists there are."""
        start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))

        def step(acc: Column, n: Column) -> Column:
            inside = ((n["tag"] == "li") & (acc["end"] >= n["last"])).cast("int")
            end = F.when(kind(n) & (n["last"] > acc["end"]), n["last"]).otherwise(acc["end"])
            return F.struct(end.alias("end"), (acc["n"] + inside).alias("n"))

        return F.aggregate("_marked_lists", start, step, lambda acc: acc["n"])

    second = {
            "ordered_items": items_in(ordered),
            "bulleted_items": items_in(bulleted),
            "list_items": items_in(S.tag("ol", "ul")),
            "question_headings": F.size(question_headings),
        }
    images = F.size("images")

    def marks(test: S.Predicate) -> Column:
        return S.any_node(marked, test)

    flags = {
        # content
        "word_count": S.word_count(body),
        "has_direct_answer": X.direct_answer(S.trim(F.col("first_paragraph"))),
        "content_format": X.content_format(lower, F.col("list_items")),
        "has_facts": X.has_facts(lower),
        "h1_count": F.size("h1"),
        "h2_count": F.size("h2"),
        "h3_count": F.size("h3"),
        "proper_hierarchy": (F.size("h1") == 1) & (F.size("h2") > 0),
        "heading_questions": F.size(F.filter("heading_texts", X.is_question)),
        "faq_elements": S.count_nodes(marked, FAQ_ELEMENT),
        "has_faq_section": marks(FAQ_ELEMENT),
        "mentions_year": body.contains(str(year)) if year else F.lit(False),
        "readability_score": X.readability(body),
        "question_answering_score": X.question_answering(body, F.col("paragraph_count")),
        # expertise, authority, trust
        "author_from_text": X.has_byline(lower),
        "has_author": marks(AUTHOR_ELEMENT) | X.has_byline(lower),
        "has_author_bio": marks(S.either(S.class_has("author-bio"), S.has_class("author-description"))),
        "has_contact": X.has_contact(lower),
        "has_contact_page": marks(S.both(S.tag("a"), S.attr_has("href", "contact"))),
        "external_links": F.size("links_external"),
        "authority_citations": F.size(F.filter(
            "links_external", lambda h: h.rlike("|".join(d.replace(".", r"\.") for d in AUTHORITY_DOMAINS)))),
        "has_references": marks(S.class_has("reference", "citation")),
        "expertise": X.matched_keywords(lower, X.EXPERTISE_KEYWORDS),
        "trust_signals": F.array_compact(F.array(
            F.when(marks(S.either(S.attr_has("src", "ssl"), S.attr_has("href", "https"))), "SSL certificate"),
            F.when(marks(S.either(S.has_class("testimonial"), S.class_has("review"))), "testimonials"),
            F.when(marks(S.class_has("award", "certification")), "certifications"),
            F.when(F.lower("footer_text").contains("privacy"), "privacy policy"),
        )),
        # technical
        "is_https": F.col(url).startswith("https://"),
        "has_viewport": F.coalesce(meta(marked, "name", "viewport").contains("width=device-width"), F.lit(False)),
        "responsive_image_ratio": ratio(S.count_nodes(marked, S.both(S.tag("img"), S.has_attr("srcset"))), images),
        "has_mobile_css": marks(S.both(S.tag("link"), S.attr_has("media", "screen", fold=True))),
        "meta_description_length": F.length("raw_description"),
        "has_og_tags": F.col("og_data.title") != "",
        "title_length": F.length("raw_title"),
        "internal_link_count": F.size("links_internal"),
        "image_count": images,
        "images_with_alt": F.when(images == 0, F.lit(100.0)).otherwise(F.size(F.filter("images", lambda i: i["has_alt"])) / images * 100.0),
        "has_robots_meta": marks(S.both(S.tag("meta"), S.attr_is("name", "robots"))),
        "noindex": F.coalesce(F.lower(meta(marked, "name", "robots")).contains("noindex"), F.lit(False)),
        "canonical_link": canonical_href(marked),
        # structured data
        "block_count": F.size("json_ld"),
        "block_types": F.array_distinct(F.filter(F.transform("json_ld", _ld_type), lambda t: t != "")),
        "has_faq_schema": F.col("faq_block").isNotNull(),
        "faq_schema_questions": _json_size(F.col("faq_block"), "$.mainEntity"),
        "has_howto_schema": F.col("howto_block").isNotNull(),
        "howto_steps": _json_size(F.col("howto_block"), "$.step"),
        "has_article_schema": F.col("article_block").isNotNull(),
        "article_has_author": F.coalesce(F.get_json_object("article_block", "$.author") != "", F.lit(False)),
        "article_has_date": F.coalesce(F.get_json_object("article_block", "$.datePublished") != "", F.lit(False)),
        "has_breadcrumb_schema": F.col("breadcrumb_block").isNotNull(),
        "breadcrumb_items": _json_size(F.col("breadcrumb_block"), "$.itemListElement"),
        # AI readiness
        "overview_score": X.overview_score(F.col("overview_keywords")),
        "is_listicle": (F.col("ordered_items") > 3) | (F.col("bulleted_items") > 5),
        "has_numbered_points": body.rlike(r"[0-9]+\."),
        "comparison_words": X.matched_keywords(lower, X.COMPARISON_WORDS),
        "answer_density": X.answer_density(body),
        "has_list": F.size("_lists") > 0,
        "has_table": S.any_node(nodes, S.tag("table")),
        "has_definition": F.length("first_paragraph") > 50,
        "conversational_tone": X.conversational_tone(body),
    }
    snippet = sum((points(F.col(c), 1.0) for c in ("has_list", "has_table")), points(F.col("has_definition"), 1.0))
    return first, second, flags, {"snippet_score": snippet * 33.33}


def _votes(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total


def url_page_type(url: Column, path: Column) -> Column:
    """Page type from the URL alone; null where the URL does not tell."""
    found = F.when(F.length(path) <= 3, F.lit("homepage"))
    for name, pattern in URL_TYPES:
        found = found.when(url.rlike(pattern), F.lit(name))
    return found


def content_page_type(title: Column, lower: Column) -> Column:
    """Page type by votes over lower-cased text and markup (columns of ``record``); last resort ``resource``.

    ``lower`` must be a plain column: it is tested dozens of times.
    """
    nodes, marked = F.col("nodes"), F.col("marked")

    def marks(test: S.Predicate) -> Column:
        return S.any_node(marked, test)

    def tags(*names: str) -> Column:
        return S.any_node(nodes, S.tag(*names))

    name = F.lower(title)
    form = S.both(S.tag("form"), S.class_has("contact", "signup", "register"))
    button = S.both(S.tag("button"), S.class_has("buy", "cart", "purchase"))
    asked = S.count_nodes(nodes, S.both(S.tag("h2", "h3", "h4"), lambda n: n["text"].contains("?")))
    sections = S.count_nodes(nodes, S.tag("section"))
    return (
        F.when(_votes(F.col("has_author"), F.col("publish_date").isNotNull(), lower.rlike(BLOG_TEXT),
                      marks(S.class_has("author", "byline", "date", "publish")), tags("article")) >= 2, F.lit("blog"))
        .when(_votes(marks(form), X.has_word(lower, CTA_WORDS), marks(S.class_has("price", "plan", "pricing")),
                     marks(S.class_has("cta", "call-to-action")), X.has_word(lower, ORDER_WORDS)) >= 2, F.lit("conversion"))
        .when(_votes(X.has_word(lower, PRODUCT_WORDS), marks(S.either(S.class_has("price"), S.has_class("pricing"))),
                     marks(S.class_has("product", "item")), X.has_word(lower, FEATURE_WORDS), marks(button)) >= 2, F.lit("product"))
        .when(_votes(X.has_word(lower, SOLUTION_WORDS), X.has_word(lower, PROBLEM_WORDS), X.has_word(lower, OUTCOME_WORDS),
                     name.rlike(SOLUTION_TITLE)) >= 2, F.lit("solution"))
        .when(_votes(X.has_word(lower, GUIDE_WORDS), X.has_word(lower, STEP_WORDS), asked >= 3, F.col("has_faq_section"),
                     X.has_word(lower, DOWNLOAD_WORDS)) >= 2, F.lit("resource"))
        .when(_votes(X.has_word(lower, WELCOME_WORDS), S.any_node(nodes, NAVIGATION), marks(S.class_has("hero", "banner")),
                     tags("header") & tags("footer"), sections >= 3) >= 3, F.lit("homepage"))
        .otherwise(F.lit("resource"))
    )


def with_page_type(rows: DataFrame, url: str = "url", title: str = "raw_title", lower: str = "body_lower") -> DataFrame:
    """Stage 3: decide ``page_type`` and the trust factors that depend on it. ``lower`` names the lower-cased text."""
    return rows.withColumn("page_type", _page_type(url, title, lower)).withColumn("trust_factors", _trust_by_type())


@built_once
def _page_type(url: str, title: str, lower: str) -> Column:
    return F.coalesce(url_page_type(F.col(url), F.col("url_path")), content_page_type(F.col(title), F.col(lower)))


@built_once
def _trust_by_type() -> Column:
    return trust_factors(F.col("page_type"))


def trust_factors(page_type: Column) -> Column:
    """struct<score, factors> of the checks that apply to one page type."""
    nodes, marked, body, lower = (F.col(c) for c in ("nodes", "marked", "body_text", "body_lower"))

    def marks(test: S.Predicate) -> Column:
        return S.any_node(marked, test)

    def factor(condition: Column, name: str, score: int) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("name"), F.lit(float(score)).alias("score")))

    def group(*factors: Column) -> Column:
        found = F.array_compact(F.array(*factors))
        return F.struct(
            F.aggregate(found, F.lit(0.0), lambda acc, f: acc + f["score"]).alias("score"),
            F.transform(found, lambda f: f["name"]).alias("factors"),
        )

    asked = S.count_nodes(nodes, S.both(S.tag("h2", "h3", "h4"), lambda n: n["text"].contains("?")))
    answered = F.when(asked >= 5, F.struct(
        F.concat(asked.cast("string"), F.lit(" questions answered")).alias("name"),
        F.least(F.lit(40.0), asked * 5.0).alias("score"),
    ))
    team = S.either(S.both(S.tag("img"), S.either(S.attr_has("alt", "team"), S.attr_has("alt", "person"))), S.has_class("team"))
    return (
        F.when(page_type == "homepage", group(
            factor(S.any_node(nodes, NAVIGATION), "clear navigation", 20),
            factor(marks(S.class_has("hero", "value")), "value proposition", 15),
            factor(F.length("footer_text") > 100, "comprehensive footer", 10)))
        .when(page_type == "about", group(
            factor(X.has_word(lower, COMPANY_WORDS), "company background", 25),
            factor(X.has_word(lower, MISSION_WORDS), "mission/vision", 20),
            factor(marks(team), "team photos", 15)))
        .when(page_type == "contact", group(
            factor(body.rlike(PHONE_TEXT), "phone number", 20),
            factor(body.rlike(EMAIL_TEXT), "email address", 15),
            factor(S.any_node(nodes, S.tag("form")), "contact form", 20),
            factor(X.has_word(lower, PLACE_WORDS), "physical address", 15)))
        .when(page_type == "service", group(
            factor(marks(S.either(S.class_has("price"), S.has_class("pricing"))), "pricing information", 20),
            factor(marks(S.class_has("review", "testimonial")), "customer testimonials", 25),
            factor(X.has_word(lower, GUARANTEE_WORDS), "guarantee/refund policy", 15)))
        .when(page_type == "blog", group(factor(F.lit(True), "editorial content", 100)))
        .when(page_type == "faq", group(
            answered,
            factor(marks(S.either(S.attr_is("type", "search", fold=True), S.has_class("search"))), "search functionality", 20)))
        .otherwise(group(factor(F.lit(True), "standard page", 50)))
    )
