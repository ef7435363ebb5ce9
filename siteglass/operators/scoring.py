"""Category scores, overall score, checklist and ranked recommendations of a feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.build import built_once
from ..functions.numbers import points, round_half_up

C = F.col

# --- fixed values: points and rules -------------------------------------------------
FORMAT_POINTS = {"listicle": 10, "step-by-step guide": 9, "comparison": 8, "review": 7, "article": 5}
ACTIONABLE_FORMATS = ("listicle", "step-by-step guide", "comparison")
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}
CATEGORY_RANK = {
    "AI Optimization": 5, "Content Quality": 4, "FAQ Schema": 4, "Technical SEO": 3,
    "E-A-T (Expertise)": 3, "Structured Data": 2, "Mobile Optimization": 2,
}
# E-A-T by page type: author, bio, contact, any citation, publish date, update date,
# per expertise term (limit), per trust signal (limit), share of trust factors (limit)
EAT_POINTS = {
    "homepage": (0, 0, 25, 10, 0, 5, (3, 15), (4, 20), (0.25, 25)),
    "about": (5, 0, 20, 10, 0, 5, (4, 20), (3, 15), (0.25, 25)),
    "contact": (0, 0, 40, 0, 0, 5, (2, 10), (3, 15), (0.3, 30)),
    "service": (5, 0, 20, 15, 0, 10, (4, 20), (3, 15), (0.15, 15)),
    "faq": (0, 0, 15, 15, 0, 10, (5, 25), (3, 15), (0.2, 20)),
    "generic": (10, 5, 15, 10, 5, 5, (3, 15), (3, 15), (0.2, 20)),
}
# ---------------------------------------------------------------------------------------


def _upto(limit: float, value: Column) -> Column:
    return F.least(F.lit(float(limit)), value.cast("double"))


def _steps(value: Column, *steps: tuple[float, float], otherwise: float = 0.0) -> Column:
    """First step whose threshold the value exceeds."""
    out = None
    for threshold, score in steps:
        hit = value > threshold
        out = F.when(hit, F.lit(float(score))) if out is None else out.when(hit, F.lit(float(score)))
    return out.otherwise(F.lit(float(otherwise)))


def content_score() -> Column:
    form = F.lit(3.0)
    for name, value in FORMAT_POINTS.items():
        form = F.when(C("content_format") == name, F.lit(float(value))).otherwise(form)
    heading = F.when((C("h1_count") > 0) & C("proper_hierarchy"), 8.0).when(C("h1_count") > 0, 5.0).otherwise(0.0)
    return _upto(
        100,
        _steps(C("word_count"), (1000, 10), (500, 7), (300, 4))
        + points(C("has_direct_answer"), 15)
        + form
        + points(C("has_facts"), 10)
        + heading
        + _upto(2, C("heading_questions"))
        + points(C("has_faq_section"), 5)
        + _upto(5, C("question_headings"))
        + _upto(10, C("readability_score") / 10)
        + _upto(10, C("question_answering_score") / 10)
        + _upto(10, C("overview_score") / 10)
        + points(C("is_listicle"), 3)
        + points(F.size("comparison_words") > 0, 2),
    )


def eat_score(page_type: Column) -> Column:
    """E-A-T score. Types without points of their own use the generic row."""
    contact = C("has_contact") | C("has_contact_page")
    cited = C("authority_citations") > 0

    def table(kind: str) -> Column:
        author, bio, reach, cite, published, updated, expert, trust, special = EAT_POINTS[kind]
        return (
            points(C("has_author"), author) + points(C("has_author_bio"), bio) + points(contact, reach)
            + points(cited, cite) + points(C("publish_date").isNotNull(), published)
            + points(C("update_date").isNotNull(), updated)
            + _upto(expert[1], F.size("expertise") * expert[0])
            + _upto(trust[1], F.size("trust_signals") * trust[0])
            + _upto(special[1], C("trust_factors.score") * special[0])
        )

    blog = (
        points(C("has_author"), 20) + points(C("has_author_bio"), 10) + points(contact, 10)
        + _upto(20, C("authority_citations") * 4) + points(C("has_references"), 5)
        + points(C("publish_date").isNotNull(), 10) + points(C("update_date").isNotNull(), 10)
        + _upto(10, F.size("expertise") * 2) + _upto(5, F.size("trust_signals"))
    )
    score = F.when(page_type == "blog", blog)
    for kind in EAT_POINTS:
        if kind != "generic":
            score = score.when(page_type == kind, table(kind))
    return _upto(100, score.otherwise(table("generic")))


def technical_score() -> Column:
    length, title = C("meta_description_length"), C("title_length")
    description = (
        F.when(length.between(120, 160), 8.0).when(length.between(100, 180), 5.0).when(length > 0, 3.0).otherwise(0.0)
    )
    return _upto(
        100,
        points(C("is_https"), 15)
        + points(C("has_viewport"), 10)
        + _upto(10, C("responsive_image_ratio") * 10)
        + points(C("has_mobile_css"), 5)
        + F.when(C("load_time") < 2000, 20.0).when(C("load_time") < 3000, 15.0).when(C("load_time") < 5000, 10.0).otherwise(5.0)
        + description
        + F.when(title.between(30, 60), 7.0).when(title > 0, 4.0).otherwise(0.0)
        + points(C("internal_link_count") > 5, 5)
        + _upto(5, C("internal_link_count") / 5)
        + F.when(C("image_count") == 0, F.lit(5.0)).otherwise(_upto(10, C("images_with_alt") / 10))
        + points(C("canonical_link") != "", 3)
        + points(C("has_robots_meta"), 2),
    )


def structured_data_score() -> Column:
    def schema(flag: str, base: float, extra: Column) -> Column:
        return F.when(C(flag), F.lit(float(base)) + extra).otherwise(F.lit(0.0))

    kinds = F.size("block_types")
    return _upto(
        100,
        points(C("block_count") > 0, 20)
        + schema("has_faq_schema", 15, _upto(10, C("faq_schema_questions") * 2))
        + schema("has_howto_schema", 10, _upto(10, C("howto_steps") * 2))
        + schema("has_article_schema", 10, points(C("article_has_author"), 5) + points(C("article_has_date"), 5))
        + schema("has_breadcrumb_schema", 5, _upto(5, C("breadcrumb_items")))
        + F.when(kinds >= 3, 5.0).when(kinds >= 2, 3.0).otherwise(0.0),
    )


SCORES = ("content", "eat", "technical", "structured_data")


@built_once
def _raw_scores() -> dict[str, Column]:
    return {
        "_content": content_score(),
        "_eat": eat_score(C("page_type")),
        "_technical": technical_score(),
        "_structured_data": structured_data_score(),
    }


def with_scores(rows: DataFrame) -> DataFrame:
    """Add the four scores (rounded) and ``overall_score`` from the unrounded quarters."""
    raw = rows.withColumns(_raw_scores())
    quarter = sum((C(f"_{s}") * 0.25 for s in SCORES[1:]), C(f"_{SCORES[0]}") * 0.25)
    return raw.withColumns(
        {"overall_score": round_half_up(quarter), **{f"{s}_score": round_half_up(C(f"_{s}")) for s in SCORES}}
    ).drop(*[f"_{s}" for s in SCORES])


#: Why each finding matters, and an example where one helps (own wording; the level is that of the finding's impact).
ADVICE = {
    "Content too short": ("High: thorough pages are quoted far more often than thin ones", None),
    "No direct answer in opening": ("High: answer engines lift the opening sentences", "Before: 'People often ask how tall it is.' After: 'It is 324 metres tall.'"),
    "Content format not optimized for AI": ("Medium: lists, comparisons and steps are easier to quote", None),
    "Lacks factual backing": ("Medium: backed claims carry more authority", "'According to the 2023 census, 41% of households ...'"),
    "Poor heading hierarchy": ("Medium: headings in order show how the text is built", None),
    "Insufficient question-answer pairs": ("High: a question with its answer can be quoted as it stands", "A heading 'What is a sitemap?' with a two-sentence answer below."),
    "Missing author information": ("High: a named expert is a main sign of trust", None),
    "No contact information": ("Medium: a reachable publisher is trusted more", None),
    "No authoritative citations": ("Medium: links to authorities raise credibility", "Link a figure to the study or the agency that published it."),
    "No publication or update dates": ("Medium: dated, current pages are preferred", None),
    "Site not using HTTPS": ("High: an encrypted site is the least that is expected", None),
    "Missing viewport meta tag": ("High: pages are judged by their mobile view", None),
    "Slow page loading": ("High: slow pages rank lower", None),
    "Missing meta description": ("Medium: the description tells what the page answers", "'How to repot an orchid in five steps, with the right season and soil.'"),
    "Images missing alt text": ("Medium: alt texts help readers and machines alike", None),
    "No structured data markup": ("High: markup states outright what a page is about", None),
    "Missing FAQ structured data": ("High: marked-up questions are shown directly", "A page with three or more questions carries one FAQPage block."),
    "Missing HowTo structured data": ("Medium: marked-up steps are read as instructions", None),
    "Missing Article structured data": ("Medium: the content type becomes explicit", None),
}


def _rules() -> list[tuple[str, str, str, str, str, Column, Column | None]]:
    """(score group, category, priority, issue, advice, condition, current value)."""
    contact = C("has_contact") | C("has_contact_page")
    cq, at, tech, sd = SCORES
    seconds = F.concat(F.lit("Current load time: "), F.format_string("%.2f", C("load_time") / 1000), F.lit("s"))
    alt = F.concat(round_half_up(C("images_with_alt")).cast("string"), F.lit("% of images have alt text"))
    return [
        (cq, "Content Quality", "high", "Content too short", "Write at least 500 to 1000 words that answer the topic in full.", C("word_count") < 300, None),
        (cq, "AI Optimization", "high", "No direct answer in opening", "Answer the main question in the first two or three sentences.", ~C("has_direct_answer"), None),
        (cq, "Content Structure", "medium", "Content format not optimized for AI", "Turn the content into a list, a comparison or numbered steps.", ~C("content_format").isin(*ACTIONABLE_FORMATS), None),
        (cq, "Content Authority", "medium", "Lacks factual backing", "Support claims with statistics, research or named sources.", ~C("has_facts"), None),
        (cq, "Content Structure", "medium", "Poor heading hierarchy", "Use one H1 and H2 headings for the main sections.", ~C("proper_hierarchy"), None),
        (cq, "AI Optimization", "high", "Insufficient question-answer pairs", "Ask questions in H2 or H3 headings and answer them below.", C("question_headings") < 3, None),
        (at, "E-A-T (Expertise)", "high", "Missing author information", "Name the author and describe their background.", ~C("has_author"), None),
        (at, "E-A-T (Trust)", "medium", "No contact information", "Show contact details or link to a contact page.", ~contact, None),
        (at, "E-A-T (Authority)", "medium", "No authoritative citations", "Link to authoritative sources for the claims made.", C("authority_citations") == 0, None),
        (at, "Content Freshness", "medium", "No publication or update dates", "Show when the page was published and last updated.", C("publish_date").isNull() & C("update_date").isNull(), None),
        (tech, "Technical SEO", "high", "Site not using HTTPS", "Serve the page over HTTPS.", ~C("is_https"), None),
        (tech, "Mobile Optimization", "high", "Missing viewport meta tag", "Add a viewport meta tag with width=device-width.", ~C("has_viewport"), None),
        (tech, "Page Speed", "high", "Slow page loading", "Bring the load time below two seconds.", C("load_time") > 3000, seconds),
        (tech, "Meta Optimization", "medium", "Missing meta description", "Write a meta description of 120 to 160 characters.", C("meta_description_length") == 0, None),
        (tech, "Image SEO", "medium", "Images missing alt text", "Describe every image in its alt text.", (C("image_count") > 0) & (C("images_with_alt") < 80), alt),
        (sd, "Structured Data", "high", "No structured data markup", "Add JSON-LD, starting with an Article or BlogPosting.", C("block_count") == 0, None),
        (sd, "FAQ Schema", "high", "Missing FAQ structured data", "Mark up question-answer pairs as FAQPage.", ~C("has_faq_schema") & (C("faq_schema_questions") < 3), None),
        (sd, "HowTo Schema", "medium", "Missing HowTo structured data", "Mark up instructions as HowTo.", ~C("has_howto_schema"), None),
        (sd, "Article Schema", "medium", "Missing Article structured data", "Add an Article with author, datePublished and headline.", ~C("has_article_schema"), None),
    ]


@built_once
def recommendations() -> Column:
    """Ranked array of findings; a group speaks only while its rounded score is below 70."""
    found = []
    for pos, (group, category, priority, issue, advice, condition, current) in enumerate(_rules()):
        item = F.struct(
            F.lit(-PRIORITY_RANK[priority]).alias("by_priority"),
            F.lit(-CATEGORY_RANK.get(category, 0)).alias("by_category"),
            F.lit(pos).alias("pos"),
            F.lit(category).alias("category"),
            F.lit(priority).alias("priority"),
            F.lit(issue).alias("issue"),
            F.lit(advice).alias("recommendation"),
            (F.lit(None).cast("string") if current is None else current).alias("current"),
            F.lit(ADVICE[issue][0]).alias("impact"),
            F.lit(ADVICE[issue][1]).cast("string").alias("example"),
        )
        found.append(F.when((C(f"{group}_score") < 70) & condition, item))
    ranked = F.array_sort(F.array_compact(F.array(*found)))
    fields = ("category", "priority", "issue", "recommendation", "current", "impact", "example")
    return F.transform(ranked, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def with_recommendations(rows: DataFrame) -> DataFrame:
    return rows.withColumn("recommendations", recommendations())


def checklist(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Pass/fail items per page in long form: key, section, item, passed."""
    contact = C("has_contact") | C("has_contact_page")
    dated = C("publish_date").isNotNull() | C("update_date").isNotNull()
    items = [
        ("content", "word count", C("word_count") >= 500),
        ("content", "direct answer", C("has_direct_answer")),
        ("content", "content format", C("content_format").isin(*ACTIONABLE_FORMATS)),
        ("content", "faq section", C("has_faq_section")),
        ("content", "overview keywords", F.size("overview_keywords") > 0),
        ("eat", "author information", C("has_author")),
        ("eat", "contact information", contact),
        ("eat", "external citations", C("authority_citations") > 0),
        ("eat", "content freshness", dated),
        ("eat", "page-specific trust", F.when(F.size("trust_factors.factors") > 0, C("trust_factors.score") > 50)),
        ("technical", "https", C("is_https")),
        ("technical", "mobile viewport", C("has_viewport")),
        ("technical", "meta description", C("meta_description_length") > 0),
        ("technical", "page speed", C("load_time") < 3000),
        ("technical", "image alt text", C("images_with_alt") >= 80),
        ("structured_data", "schema markup", C("block_count") > 0),
        ("structured_data", "faq schema", C("has_faq_schema")),
        ("structured_data", "article schema", C("has_article_schema")),
        ("structured_data", "howto schema", C("has_howto_schema")),
        ("structured_data", "schema types", F.size("block_types") >= 2),
    ]
    # Trust factors are listed only where the page has any.
    listed = F.array_compact(F.array(*[
        F.when(passed.isNotNull(), F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), passed.alias("passed")))
        for section, item, passed in items
    ]))
    return rows.select(key, F.inline(listed))
