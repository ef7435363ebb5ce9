"""Rubric tables: loading, criteria per page type, merging, statistics, prompt text."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ordered import first_seen
from .quality import collect_errors

RUBRIC_SCHEMA = (
    "documentType string, version string,"
    "categories array<struct<name:string,weight:double,criteria:array<struct<"
    "name:string,description:string,scoringGuidance:string,bestPractices:array<string>>>>>,"
    "pageTypeRubrics map<string,struct<description:string,emphasizedCriteria:array<string>,"
    "deemphasizedCriteria:array<string>,excludedCriteria:array<string>>>"
)
# --- fixed values: criterion -> category of the score view; anything else is 'General' ----
VIEW_CATEGORIES = {
    "direct_answer": "Content Quality", "question_coverage": "Content Quality", "readability": "Content Quality",
    "eeat_signals": "E-A-T Signals", "outbound_links": "E-A-T Signals",
    "performance": "Technical SEO", "indexing": "Technical SEO", "internal_linking": "Technical SEO",
    "accessibility": "Technical SEO", "schema_markup": "Structured Data",
}
# -------------------------------------------------------------------------------------------


def load_rubric(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per rubric document: the default one, or every JSON file under ``path``."""
    if path:
        texts = spark.read.text(path, wholetext=True)
    else:
        text = resources.files("siteglass").joinpath("data/rubric.json").read_text(encoding="utf-8")
        texts = spark.createDataFrame([(text,)], "value string")
    return texts.select(F.from_json("value", RUBRIC_SCHEMA).alias("r")).select("r.*")


def criteria(rubric: DataFrame) -> DataFrame:
    """(category, criterion, description, ..., category_pos, criterion_pos)."""
    return (
        rubric.select("version", F.posexplode("categories").alias("category_pos", "c"))
        .select("version", "category_pos", F.col("c.name").alias("category"), F.col("c.weight").alias("weight"), F.posexplode("c.criteria").alias("criterion_pos", "k"))
        .select(
            "version", "category_pos", "criterion_pos", "category", "weight", F.col("k.name").alias("criterion"),
            F.col("k.description").alias("description"), F.col("k.scoringGuidance").alias("scoring_guidance"),
            F.col("k.bestPractices").alias("best_practices"),
        )
    )


def page_type_rules(rubric: DataFrame, field: str) -> DataFrame:
    """(page_type, criterion) pairs of one list: emphasizedCriteria, excludedCriteria, ..."""
    return rubric.select(F.explode("pageTypeRubrics").alias("page_type", "t")).select(
        "page_type", F.explode(F.col("t")[field]).alias("criterion")
    )


def criteria_for(types: DataFrame, rubric: DataFrame) -> DataFrame:
    """Criteria that apply to each distinct ``page_type`` of ``types``, with the emphasised flag.

    A type the rubric does not know gets every criterion. The rubric side is a fixed-size
    document, so it is broadcast.
    """
    wanted = types.select("page_type").distinct()
    all_criteria = F.broadcast(criteria(rubric).withColumn("_all", F.lit(1)))
    excluded = F.broadcast(page_type_rules(rubric, "excludedCriteria"))
    emphasized = F.broadcast(page_type_rules(rubric, "emphasizedCriteria").withColumn("_hit", F.lit(True)))
    return (
        wanted.withColumn("_all", F.lit(1))
        .join(all_criteria, "_all")
        .join(excluded, ["page_type", "criterion"], "left_anti")
        .join(emphasized, ["page_type", "criterion"], "left")
        .select("page_type", "criterion", "category", "description", "category_pos", "criterion_pos",
                F.coalesce("_hit", F.lit(False)).alias("emphasized"))
    )


def rubric_stats(rubric: DataFrame) -> DataFrame:
    return criteria(rubric).groupBy("category").agg(F.count("*").alias("criteria"), F.first("weight").alias("weight"))


def view_category(criterion: Column) -> Column:
    """Category of a criterion in the score view."""
    out = F.lit("General")
    for name, category in VIEW_CATEGORIES.items():
        out = F.when(criterion == name, F.lit(category)).otherwise(out)
    return out


def merge_rubrics(sets: DataFrame) -> DataFrame:
    """Union of criteria rows (``set_pos``, category, criterion, pos, ...): first per name wins."""
    rest = [c for c in sets.columns if c not in ("category", "criterion")]
    return first_seen(sets, ["category", "criterion"], ["set_pos", "pos"], rest)


def rubric_errors(rubric: DataFrame) -> DataFrame:
    """Rubric documents with an ``errors`` column."""
    def of_category(c: Column, i: Column) -> Column:
        at = F.concat(F.lit("Category at index "), i.cast("string"))
        items = F.coalesce(c["criteria"], F.array().cast(
            "array<struct<name:string,description:string,scoringGuidance:string,bestPractices:array<string>>>"))

        def of_criterion(k: Column, j: Column) -> Column:
            name = F.coalesce(k["name"], F.lit("undefined"))
            return F.array_compact(F.array(
                F.when(F.coalesce(k["name"], F.lit("")) == "", F.concat(
                    F.lit("Criterion at category "), c["name"], F.lit(", index "), j.cast("string"), F.lit(" missing name"))),
                F.when(F.coalesce(k["description"], F.lit("")) == "", F.concat(F.lit("Criterion "), name, F.lit(" missing description"))),
                F.when(F.coalesce(k["scoringGuidance"], F.lit("")) == "", F.concat(F.lit("Criterion "), name, F.lit(" missing scoringGuidance"))),
            ))

        own = F.array_compact(F.array(
            F.when(F.coalesce(c["name"], F.lit("")) == "", F.concat(at, F.lit(" missing name"))),
            F.when(c["criteria"].isNull(), F.concat(F.lit("Category "), F.coalesce(c["name"], i.cast("string")), F.lit(" missing criteria array"))),
        ))
        return F.concat(own, F.flatten(F.transform(items, of_criterion)))

    whole = collect_errors(
        (F.col("categories").isNull(), "Rubric must have categories array"),
        (F.col("pageTypeRubrics").isNull(), "Rubric should have pageTypeRubrics for page-type-aware scoring"),
    )
    nested = F.flatten(F.transform(F.coalesce("categories", F.array()), of_category))
    return rubric.withColumn("errors", F.concat(nested, whole))


def principle_errors(principles: DataFrame) -> DataFrame:
    """Extracted principles (``categories`` as in a rubric) with an ``errors`` column: by position, and without scoring guidance."""

    def of_category(c: Column, i: Column) -> Column:
        at = i.cast("string")

        def of_criterion(k: Column, j: Column) -> Column:
            place = F.concat(F.lit("Criterion at category "), at, F.lit(", index "), j.cast("string"))
            return collect_errors(*[(F.coalesce(k[f], F.lit("")) == "", F.concat(place, F.lit(f" missing {f}"))) for f in ("name", "description")])

        own = collect_errors(
            (F.coalesce(c["name"], F.lit("")) == "", F.concat(F.lit("Category at index "), at, F.lit(" missing name"))),
            (c["criteria"].isNull(), F.concat(F.lit("Category at index "), at, F.lit(" missing criteria array"))),
        )
        return F.concat(own, F.coalesce(F.flatten(F.transform(c["criteria"], of_criterion)), F.array().cast("array<string>")))

    whole = collect_errors((F.col("categories").isNull(), "principles.categories must be an array"))
    nested = F.coalesce(F.flatten(F.transform("categories", of_category)), F.array().cast("array<string>"))
    return principles.withColumn("errors", F.concat(whole, nested))


def criteria_list(per_type: DataFrame) -> DataFrame:
    """One prompt list per page type: ``- name [EMPHASIZED]: description`` lines in rubric order.

    The rubric bounds the lines of a type, so collecting them is safe.
    """
    line = F.concat(
        F.lit("- "), F.col("criterion"), F.when(F.col("emphasized"), F.lit(" [EMPHASIZED]")).otherwise(F.lit("")), F.lit(": "), F.col("description")
    )
    ordered = F.array_sort(F.collect_list(F.struct("category_pos", "criterion_pos", line.alias("line"))))
    return per_type.groupBy("page_type").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("criteria_list"))


def scoring_prompt(content: Column, page_type: Column, criteria_lines: Column) -> Column:
    """Request text for an outside scorer: the criteria that apply, then the page content."""
    return F.concat(
        F.lit("Analyze and score this "), page_type, F.lit(" page.\n\nCriteria to Evaluate:\n"), criteria_lines,
        F.lit("\n\nPage Content:\n"), content,
    )
