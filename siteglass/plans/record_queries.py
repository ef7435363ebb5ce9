"""Registered queries over page records, canonical classes and the validation of rubrics, principles and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import urls as U
from ..operators import links, quality, reports, rubric, scoring, tables
from ..operators.ordered import ranked
from .bindings import Tables
from .page_queries import RULES_SQL, URL_PARTS, WITH_URLS, _features
from .registry import query

C = F.col


# --- page records --------------------------------------------------------------------------------
@query("page_records", "A6", WITH_URLS + "SELECT page_id, storage AS url, sha256(storage) AS url_hash FROM f")
def page_records(t: Tables):
    return tables.page_rows(t.raw("pages").select("page_id", "url"))


_VARIANTS = """v AS (SELECT page_id * 2 AS page_id, url, html FROM pages UNION ALL
 SELECT page_id * 2 + 1, CASE page_id % 5 WHEN 0 THEN base || '#part' WHEN 1 THEN base || mark || 'utm_source=mail' WHEN 2 THEN CASE WHEN url LIKE 'https:%' THEN 'http' || base[6:] ELSE 'https' || base[5:] END
 WHEN 3 THEN 'ftp://' || base ELSE base || mark || 'offset=9' END, html FROM (SELECT *, regexp_replace(url, '#.*', '') AS base, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END AS mark FROM pages)), """


@query("strict_duplicates", "H9", "WITH " + _VARIANTS + URL_PARTS.replace("FROM pages", "FROM v") + """SELECT CAST(a.page_id // 2 AS BIGINT) AS page_id, b.url AS variant, a.strict = b.strict AS duplicate,
 a.crawl = b.crawl AS equivalent FROM f a JOIN f b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0""")
def strict_duplicates(t: Tables):
    # Each URL against a variant of it: with a fragment, a tracking parameter, the other scheme, no web scheme, another parameter.
    u, k = C("url"), C("page_id") % 5
    base, mark = F.regexp_replace("url", "#.*", ""), F.when(u.contains("?"), "&").otherwise("?")
    other = F.when(u.startswith("https:"), F.regexp_replace(base, "^https", "http")).otherwise(F.regexp_replace(base, "^http", "https"))
    variant = (
        F.when(k == 0, F.concat(base, F.lit("#part"))).when(k == 1, F.concat(base, mark, F.lit("utm_source=mail"))).when(k == 2, other)
        .when(k == 3, F.concat(F.lit("ftp://"), base)).otherwise(F.concat(base, mark, F.lit("offset=9")))
    )
    pairs = t.raw("pages").select("page_id", "url", variant.alias("variant"))
    return pairs.select("page_id", "variant", U.duplicates(u, C("variant")).alias("duplicate"), U.equivalent(u, C("variant")).alias("equivalent"))


# Which page a page names as its canonical: chains that end, pairs that name each other, and pages that name none.
_TARGET = "CASE WHEN page_id % 10 = 1 THEN page_id + 1 WHEN page_id % 10 = 2 THEN page_id - 1 WHEN page_id % 10 = 5 THEN NULL ELSE page_id * 3 // 5 END"


@query("canonical_classes", "D19 L7", "WITH RECURSIVE " + URL_PARTS + f""", g AS (SELECT page_id, url, clean AS node, {_TARGET} AS tid FROM f),
 c AS (SELECT a.node, COALESCE(min(b.node) FILTER (b.node <> a.node), a.node) AS target FROM g a LEFT JOIN g b ON b.page_id = a.tid GROUP BY a.node),
 w(start, node, step) AS (SELECT node, node, 0 FROM c UNION ALL SELECT start, target, step + 1 FROM w JOIN c ON c.node = w.node AND c.node <> c.target WHERE step < 200),
 last AS (SELECT start, max(step) = 200 AS cyclic, CASE WHEN max(step) = 200 THEN min(node) FILTER (step >= 100) ELSE arg_max(node, step) END AS final FROM w GROUP BY start)
 SELECT final AS canonical_url, url, cyclic, row_number() OVER (PARTITION BY final ORDER BY page_id) AS position FROM g JOIN last ON start = node""")
def canonical_classes(t: Tables):
    pages, k = t.raw("pages"), C("page_id")
    named = F.when(k % 10 == 1, k + 1).when(k % 10 == 2, k - 1).when(k % 10 != 5, F.floor(k * 3 / 5))
    targets = pages.select(k.alias("tid"), C("url").alias("target"))
    linked = pages.select("page_id", "url", "html", named.alias("tid")).join(targets, "tid", "left")
    link = F.coalesce(F.concat(F.lit('<link rel="canonical" href="'), C("target"), F.lit('">')), F.lit(""))
    classes = links.canonical_classes(linked.select("page_id", "url", F.concat(link, "html").alias("html")))
    # One row per member: a class of any size is never an array.
    return ranked(classes, ["canonical_url"], F.floor(k / 1000), [k], "position").select("canonical_url", "url", "cyclic", "position")


# --- recommendations -------------------------------------------------------------------------------
# --- fixed values: category of each rule, in the order of the rules ---
_CATEGORIES = (
    "Content Quality", "AI Optimization", "Content Structure", "Content Authority", "Content Structure", "AI Optimization", "E-A-T (Expertise)", "E-A-T (Trust)", "E-A-T (Authority)",
    "Content Freshness", "Technical SEO", "Mobile Optimization", "Page Speed", "Meta Optimization", "Image SEO", "Structured Data", "FAQ Schema", "HowTo Schema", "Article Schema",
)
_CATEGORY = "[" + ", ".join(f"'{c}'" for c in _CATEGORIES) + "][o + 1]"


@query("recommendation_categories", "D10", RULES_SQL + f"""SELECT page_id, count(*) FILTER (p = 3) AS high, count(*) FILTER (p = 2) AS medium, count(*) FILTER (p = 1) AS low,
 string_agg(DISTINCT {_CATEGORY}, ',' ORDER BY {_CATEGORY}) AS categories FROM (SELECT page_id, r.p AS p, r.o AS o FROM rules WHERE r.k) GROUP BY page_id""")
def recommendation_categories(t: Tables):
    found = scoring.with_recommendations(scoring.with_scores(_features(t))).select("page_id", F.inline_outer("recommendations"))
    return reports.priority_counts(found.filter(C("issue").isNotNull()), ["page_id"])


def _advised(t: Tables):
    """Orders as scores with two recommendations each, some of them incomplete."""
    o, c = C("o_orderkey"), C("o_custkey")
    text = F.when(o % 3 == 0, F.lit(None)).when(o % 3 == 1, C("o_orderpriority")).otherwise(F.concat(C("o_orderpriority"), F.lit(" order of customer "), c.cast("string")))
    first = F.struct(F.when(o % 4 == 0, "").otherwise(C("o_orderpriority")).alias("category"), text.alias("text"), F.when(o % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("references"))
    second = F.struct(C("o_orderstatus").alias("category"), F.lit("Name the supplier of this part").alias("text"), F.when(c % 2 == 1, F.array("o_orderstatus")).alias("references"))
    criteria = F.create_map(F.lit("readability"), c % 130 - 10, F.lit("performance"), o % 110)
    return t.raw("orders").select((o % 120 - 5).alias("overall"), criteria.alias("criteria"), F.when(o % 11 != 0, F.array(first, second)).alias("recs"))


_ADVISED = """r AS (SELECT o_orderkey AS o, o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority ELSE o_orderpriority || ' order of customer ' || o_custkey END AS text FROM orders)"""


@query("recommendation_validation", "B10", "WITH " + _ADVISED + """ SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN o % 11 = 0 THEN 'ai_recommendations must be an array' END,
 CASE WHEN o % 11 <> 0 AND o % 4 = 0 THEN 'Recommendation at index 0 must have a category (string)' END, CASE WHEN o % 11 <> 0 AND text IS NULL THEN 'Recommendation at index 0 must have text (string)' END]) AS error FROM r)
 WHERE error IS NOT NULL GROUP BY error""")
def recommendation_validation(t: Tables):
    return quality.error_report(_advised(t).withColumn("errors", quality.recommendation_errors(C("recs"))))


@query("score_warning_counts", "B10", "WITH " + _ADVISED + """ SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN o % 120 - 5 NOT BETWEEN 0 AND 100 THEN 'Overall score out of range' END,
 CASE WHEN c % 130 - 10 NOT BETWEEN 0 AND 100 THEN 'Criterion readability score out of range' END, CASE WHEN o % 110 > 100 THEN 'Criterion performance score out of range' END,
 CASE WHEN o % 11 <> 0 AND length(COALESCE(text, '')) < 20 THEN 'Recommendation 0 too short' END, CASE WHEN o % 11 <> 0 AND o % 5 = 0 THEN 'Recommendation 0 missing references' END,
 CASE WHEN o % 11 <> 0 AND c % 2 = 0 THEN 'Recommendation 1 missing references' END]) AS error FROM r) WHERE error IS NOT NULL GROUP BY error""")
def score_warning_counts(t: Tables):
    recs = F.coalesce("recs", F.array().cast("array<struct<category:string,text:string,references:array<string>>>"))
    return quality.error_report(_advised(t).withColumn("errors", quality.score_warnings(C("overall"), C("criteria"), recs)))


# --- rubrics and principles --------------------------------------------------------------------------
def _rubrics(t: Tables):
    """A rubric document per part, some of them incomplete."""
    p, s = C("p_partkey"), C("p_size")
    kind = "array<struct<name:string,description:string,scoringGuidance:string,bestPractices:array<string>>>"

    def criterion(name: Column, description: Column, guidance: Column) -> Column:
        return F.array(F.struct(name.alias("name"), description.alias("description"), guidance.alias("scoringGuidance"), F.array("p_type").alias("bestPractices"))).cast(kind)

    one = criterion(F.when(p % 5 != 0, C("p_brand")), F.when(p % 2 == 0, "").otherwise("about"), F.when(p % 7 != 0, "guide"))
    two = criterion(C("p_type"), F.when(s % 2 == 0, "about"), F.lit("guide"))
    named = lambda name, criteria: F.struct(name.alias("name"), F.lit(1.0).alias("weight"), criteria.alias("criteria"))
    both = F.array(named(F.when(p % 3 == 0, "").otherwise(C("p_brand")), F.when(p % 4 != 0, one)), named(C("p_type"), two))
    return t.raw("part").select(F.when(p % 6 != 0, both).alias("categories"), F.when(p % 8 != 1, F.create_map("p_brand", "p_type")).alias("pageTypeRubrics"))


@query("rubric_validation", "A4 B10", """SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 6 = 0 THEN 'Rubric must have categories array' END, CASE WHEN k % 8 = 1 THEN 'Rubric should have pageTypeRubrics for page-type-aware scoring' END,
 CASE WHEN k % 6 <> 0 AND k % 3 = 0 THEN 'Category at index 0 missing name' END,
 CASE WHEN k % 6 <> 0 AND k % 4 = 0 THEN 'Category ' || name || ' missing criteria array' END,
 CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 5 = 0 THEN 'Criterion at category ' || name || ', index 0 missing name' END,
 CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 2 = 0 THEN 'Criterion ' || brand || ' missing description' END,
 CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 7 = 0 THEN 'Criterion ' || brand || ' missing scoringGuidance' END,
 CASE WHEN k % 6 <> 0 AND p_size % 2 <> 0 THEN 'Criterion ' || p_type || ' missing description' END]) AS error
 FROM (SELECT p_partkey AS k, p_size, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'undefined' ELSE p_brand END AS brand FROM part)) WHERE error IS NOT NULL GROUP BY error""")
def rubric_validation(t: Tables):
    return quality.error_report(rubric.rubric_errors(_rubrics(t)))


@query("principle_validation", "B10", """SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 6 = 0 THEN 'principles.categories must be an array' END, CASE WHEN k % 6 <> 0 AND k % 3 = 0 THEN 'Category at index 0 missing name' END,
 CASE WHEN k % 6 <> 0 AND k % 4 = 0 THEN 'Category at index 0 missing criteria array' END, CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 5 = 0 THEN 'Criterion at category 0, index 0 missing name' END,
 CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 2 = 0 THEN 'Criterion at category 0, index 0 missing description' END,
 CASE WHEN k % 6 <> 0 AND p_size % 2 <> 0 THEN 'Criterion at category 1, index 0 missing description' END]) AS error FROM (SELECT p_partkey AS k, p_size FROM part)) WHERE error IS NOT NULL GROUP BY error""")
def principle_validation(t: Tables):
    return quality.error_report(rubric.principle_errors(_rubrics(t)))
