"""Tables, quality, history, reports, tenants, tokens and rubric on small frames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from siteglass.functions import keys as K
from siteglass.functions import text as X
from siteglass.operators import filters, history, ordered, quality, reports, rubric, tables, tenancy, tokens


def test_round_and_overall(evaluate):
    cases = [({"a": 50, "b": 51}, 51), ({"a": 50, "b": 50, "c": 100}, 67), ({"a": 0, "b": 100}, 50), ({}, 0), ({"a": 70, "b": None}, 70)]
    got = evaluate([(c,) for c, _ in cases], "m map<string,int>", {"s": tables.overall_score(F.col("m"))})
    assert [g["s"] for g in got] == [e for _, e in cases]


def test_score_rows_fill_defaults(spark):
    row = tables.score_rows(spark.createDataFrame([({"readability": 80},)], "criteria_scores map<string,int>")).collect()[0]
    assert len(row["criteria_scores"]) == 16 and row["overall_score"] == 5 and row["ai_tokens_used"] == 0


def _hot_events(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 9), i, rng.randint(0, 999), rng.choice("abc")) for i in range(600)]
    return spark.createDataFrame(rows, "key int, id int, minute int, value string").withColumn("at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins="minute"))


def test_bucketed_windows_equal_plain_windows(spark):
    events = _hot_events(spark)
    w = Window.partitionBy("key").orderBy("at", "id")
    bucket = F.date_trunc("hour", "at")
    got = ordered.with_previous(events, ["key"], bucket, ["at", "id"], "value", "p").withColumn("p", F.col("p.value"))
    assert got.select("id", "p").exceptAll(events.withColumn("p", F.lag("value").over(w)).select("id", "p")).isEmpty()
    run = ordered.running_before(events, ["key"], bucket, [F.col("at"), F.col("id")], F.col("minute"), "s")
    want = events.withColumn("s", F.coalesce(F.sum("minute").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert run.select("id", "s").exceptAll(want.select("id", "s")).isEmpty() and run.count() == 600
    rank = ordered.ranked(events, ["key"], bucket, [F.col("at"), F.col("id")], "n")
    assert rank.select("id", "n").exceptAll(events.withColumn("n", F.row_number().over(w).cast("long")).select("id", "n")).isEmpty()
    top = ordered.top_per_key(events, ["key"], [F.col("minute").desc(), F.col("id")], 4, F.col("id"))
    best = events.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("minute").desc(), "id"))).filter("rank <= 4")
    assert top.select("id", "rank").exceptAll(best.select("id", "rank")).isEmpty() and top.count() == best.count()


def test_bucketed_windows_lose_no_null(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([None, *range(300)]), rng.choice(["a", "b", None])) for i in range(300)]
    events = spark.createDataFrame(rows, "key int, id int, minute int, value string")
    w, bucket = Window.partitionBy("key").orderBy("minute", "id"), F.floor(F.col("minute") / 20)
    got = ordered.with_previous(events, ["key"], bucket, ["minute", "id"], "value", "p").select("id", F.col("p.value").alias("p"), F.col("p").isNull().alias("first"))
    want = events.select("id", F.lag("value").over(w).alias("p"), (F.row_number().over(w) == 1).alias("first"))
    assert got.count() == 300 and got.exceptAll(want).isEmpty()
    rank = ordered.ranked(events, ["key"], bucket, [F.col("minute"), F.col("id")], "n").select("id", "n")
    assert rank.count() == 300 and rank.exceptAll(events.select("id", F.row_number().over(w).cast("long").alias("n"))).isEmpty()
    plan = ordered.running_before(events, ["key"], bucket, [F.col("minute"), F.col("id")], F.lit(1), "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_validation_messages(evaluate):
    rows = evaluate([({"readability": 101, "nope": 5, "indexing": None},), (None,)], "m map<string,int>", {"e": quality.criteria_errors(F.col("m"))})
    assert sorted(rows[0]["e"]) == ["Invalid criterion: nope", "indexing must be a number", "readability must be between 0 and 100"]
    assert rows[1]["e"] == ["criteria_scores must be an object"]
    row = evaluate([(11, 0, None)], "d int, s int, t int", {"e": quality.config_errors(F.col("d"), F.col("s"), F.col("t"))})[0]
    assert row["e"] == ["depth_limit must be between 1 and 10", "sample_size must be greater than 0"]
    mails = evaluate([("a.b@c.no",), ("a@b",), ("a b@c.no",), (None,)], "m string", {"ok": quality.is_email(F.col("m"))})
    assert [m["ok"] for m in mails] == [True, False, False, False]
    rec = evaluate([([("", "long enough text here ok", ["r"]), ("c", "", [])],)], "r array<struct<category:string,text:string,references:array<string>>>", {
        "e": quality.recommendation_errors(F.col("r")), "w": quality.score_warnings(F.lit(120), F.create_map(F.lit("a"), F.lit(-1)), F.col("r"))})[0]
    assert rec["e"] == ["Recommendation at index 0 must have a category (string)", "Recommendation at index 1 must have text (string)"]
    assert rec["w"] == ["Overall score out of range", "Criterion a score out of range", "Recommendation 1 too short", "Recommendation 1 missing references"]


def test_extraction_validation(evaluate):
    texts = ['{"headings": []}', '{"headings": {}, "faq": 1}', "[1]", None]
    got = evaluate([(t,) for t in texts], "t string", {"e": quality.extraction_errors(F.try_parse_json("t"))})
    assert [g["e"] for g in got] == [[], ["extraction.headings must be an array", "extraction.faq must be an array"], ["extraction must be an object"], ["extraction must be an object"]]


def test_rubric_validation(spark):
    good = rubric.rubric_errors(rubric.load_rubric(spark)).collect()[0]["errors"]
    assert good == []
    text = '{"categories":[{"name":"A","criteria":[{"name":"x","description":"d"}]},{"criteria":null}]}'
    bad = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", rubric.RUBRIC_SCHEMA).alias("r")).select("r.*")
    assert rubric.rubric_errors(bad).collect()[0]["errors"] == [
        "Criterion x missing scoringGuidance", "Category at index 1 missing name", "Category 1 missing criteria array", "Rubric should have pageTypeRubrics for page-type-aware scoring"]


def test_rubric_per_type(spark):
    types = spark.createDataFrame([("homepage",), ("blog",), ("mystery",), ("blog",)], "page_type string")
    rows = rubric.criteria_for(types, rubric.load_rubric(spark)).collect()
    count = {t: sum(r["page_type"] == t for r in rows) for t in ("homepage", "blog", "mystery")}
    assert count == {"homepage": 14, "blog": 16, "mystery": 16}
    assert sum(r["emphasized"] for r in rows if r["page_type"] == "blog") == 8 and not any(r["emphasized"] for r in rows if r["page_type"] == "mystery")
    lists = {r["page_type"]: r["criteria_list"] for r in rubric.criteria_list(rubric.criteria_for(types, rubric.load_rubric(spark))).collect()}
    first = lists["blog"].split("\n")[0]
    assert first.startswith("- direct_answer [EMPHASIZED]: ") and "eeat_signals" not in lists["homepage"]
    stats = {r["category"]: r["criteria"] for r in rubric.rubric_stats(rubric.load_rubric(spark)).collect()}
    assert sum(stats.values()) == 16 and stats["Technical SEO"] == 5


def test_run_comparison_counts_repeats_once(spark):
    rows = [(1, 1, 10, "2024-01-01", "x"), (2, 1, 20, "2024-01-02", "x"), (3, 1, 50, "2024-02-01", "x"), (4, 2, 30, "2024-01-01", "y"), (5, 3, 40, "2024-02-01", "z")]
    df = spark.createDataFrame(rows, "score_id int, page_id int, overall_score int, day string, content_hash string").withColumn("scored_at", F.to_timestamp("day"))
    old, new = F.month("scored_at") == 1, F.month("scored_at") == 2
    got = {r["page_id"]: (r["old_score"], r["new_score"], r["change"]) for r in history.compare_runs(df, old, new).collect()}
    assert got == {1: (20, 50, 30), 2: (30, None, None), 3: (None, 40, None)}
    assert history.comparison_summary(history.compare_runs(df, old, new)).collect()[0].asDict() == {"improved": 1, "declined": 0, "stable": 0, "total_change": 30}
    assert [tuple(r) for r in history.unchanged_between(df, old, new).collect()] == [(1, "x", 2, 1)]
    assert [r["page_id"] for r in history.removed_pages(df, old, new).collect()] == [2]


def test_criteria_deltas(spark):
    pair = spark.createDataFrame([({"readability": 10, "indexing": 50, "performance": 5}, {"readability": 40, "performance": 5, "accessibility": 30})], "b map<string,int>, a map<string,int>")
    row = history.criteria_deltas(pair, "b", "a").collect()[0]
    assert [(x["criterion"], x["delta"]) for x in row["improved"]] == [("accessibility", 30), ("readability", 30)]
    assert [(x["criterion"], x["delta"]) for x in row["declined"]] == [("indexing", -50)]


def test_cache_uses_hash_and_version(spark):
    items = spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, h string").withColumn("cache_key", history.cache_key(F.col("h"), "1.1"))
    cache = spark.createDataFrame([("h1_1.1", 5, 1, 70), ("h1_1.1", 6, 2, 80), ("h2_1.0", 9, 3, 90)], "cache_key string, scored_at int, score_id int, overall_score int")
    got = {r["id"]: (r["hit"], r["overall_score"]) for r in history.with_cache(items, cache, ["overall_score"]).collect()}
    assert got == {1: (True, 80), 2: (False, None)}


def test_tenant_view_never_leaks(spark):
    members = spark.createDataFrame([(1, 10, "admin"), (2, 20, "viewer"), (2, 10, "editor")], "user_id int, organization_id int, role string")
    projects = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "project_id int, organization_id int")
    pages = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, 100)], "page_id int, project_id int")
    scores = spark.createDataFrame([(i, p) for i, p in enumerate([1, 1, 2, 3, 4])], "score_id int, page_id int")

    def seen(user, role="viewer"):
        return sorted(r["page_id"] for r in tenancy.tenant_view(scores, "page", members, user, projects, pages, role).collect())

    assert seen(1) == [1, 1, 4] and seen(2) == [1, 1, 2, 4] and seen(2, "editor") == [1, 1, 4] and seen(2, "admin") == [] and seen(9) == []
    flags = {(r["user_id"], r["organization_id"]): r["can_remove"] for r in tenancy.removable(members).collect()}
    assert flags == {(1, 10): False, (2, 20): True, (2, 10): True}


def test_reports(spark):
    scores = spark.createDataFrame([(1, "a", 50), (1, "a", 51), (2, "b", 10)], "project_id int, page_type string, overall_score int")
    projects = spark.createDataFrame([(1,), (2,), (3,)], "project_id int")
    got = {r["project_id"]: tuple(r)[1:] for r in reports.score_stats_for_all(projects, scores).collect()}
    assert got == {1: (2, 51, 50, 51), 2: (1, 10, 10, 10), 3: (0, 0, 100, 0)}
    pages = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "page_id int, overall_score int")
    assert [r["page_id"] for r in reports.order_pages(pages, "overall_score", False).collect()] == [3, 1, 2]
    assert [r["page_id"] for r in reports.page_of(reports.order_pages(pages, "overall_score", True), 2, 2).collect()] == [3]
    health = reports.queue_health(spark.createDataFrame([("q", "failed")] * 3 + [("q", "done")] * 7 + [("r", "done")], "queue string, state string"))
    assert {r["queue"]: r["health"] for r in health.collect()} == {"q": "degraded", "r": "healthy"}
    assert reports.system_health(health).collect()[0]["overall_health"] == "degraded"


def test_filters(evaluate):
    rows = evaluate([(30,), (90,), (3 * 3600,), (86400 * 2,), (86400 * 9,)], "s int", {
        "age": filters.relative_age(F.lit("2024-01-10").cast("timestamp") - F.make_dt_interval(secs="s"), F.lit("2024-01-10").cast("timestamp"))})
    assert [r["age"] for r in rows] == ["Just now", "1 minute ago", "3 hours ago", "2 days ago", "2024-01-01"]
    bands = evaluate([(80,), (79,), (40,), (0,)], "s int", {"b": filters.score_band(F.col("s"))})
    assert [b["b"] for b in bands] == ["Excellent", "Good", "Fair", "Poor"]
    roles = evaluate([("admin",), ("viewer",), ("ghost",), (None,)], "r string", {"ok": filters.at_least(F.col("r"), "editor")})
    assert [r["ok"] for r in roles] == [True, False, False, False]


def test_tokens(evaluate, spark):
    row = evaluate([("x" * 9,)], "t string", {
        "n": tokens.token_count(F.col("t")), "none": tokens.token_count(F.lit(None).cast("string")), "cut": tokens.truncate_to_tokens(F.col("t"), 2),
        "cost": tokens.cost(F.lit(1000), "gpt-4-turbo", "output"), "odd": tokens.cost(F.lit(1000), "zzz", "zzz"),
        "no": tokens.within_budget(F.lit(5), F.lit(6), F.lit(10)), "free": tokens.within_budget(F.lit(5), F.lit(6), F.lit(None).cast("int")),
        "left": tokens.remaining(F.lit(12), F.lit(10)), "inf": tokens.remaining(F.lit(12), F.lit(0)),
    })[0]
    assert row["n"] == 3 and row["none"] == 0 and row["cut"] == "x" * 8 and row["cost"] == pytest.approx(0.03) and row["odd"] == pytest.approx(0.03)
    assert row["no"] is False and row["free"] is True and row["left"] == 0.0 and row["inf"] == float("inf")
    items = spark.createDataFrame([(1, i, 30) for i in range(5)] + [(2, 0, 500), (2, 1, 1)], "run int, pos int, tokens int")
    kept = tokens.budget_cut(items, "run", F.floor(F.col("pos") / 2), [F.col("pos")], "tokens", F.lit(60)).collect()
    assert sorted((r["run"], r["pos"]) for r in kept) == [(1, 0), (1, 1), (2, 0)]


def test_chunks(evaluate):
    def greedy(text, limit):
        import re

        out, cur, n = [], "", 0
        for p in re.split(r"\n\n+", text):
            size = -(-len(p) // 4)
            if cur and n + size > limit:
                out.append(cur)
                cur, n = p, size
            else:
                cur, n = (cur + "\n\n" if cur else "") + p, n + size
        return out + ([cur] if cur else [])

    rng = random.Random(5)
    texts = ["\n\n".join("w" * rng.randint(0, 60) for _ in range(rng.randint(1, 30))) for _ in range(25)] + ["", "a\n\n\n\nb", "\n\nlead"]
    got = evaluate([(t,) for t in texts], "t string", {"c": tokens.chunks(F.col("t"), 20)})
    assert [g["c"] for g in got] == [greedy(t, 20) for t in texts]


def test_replies_and_clamp(evaluate):
    rows = evaluate([('```json\n{"a": 1}\n```',), ('{"a": 2}',), ("nope",)], "t string", {"a": F.try_variant_get(tokens.parse_json_reply(F.col("t")), "$.a", "int")})
    assert [r["a"] for r in rows] == [1, 2, None]
    got = evaluate([({"a": "150", "b": "-5", "c": "77 points", "d": "x", "e": None},)], "m map<string,string>", {"m": tokens.clamp_scores(F.col("m"))})[0]["m"]
    assert got == {"a": 100, "b": 0, "c": 77, "d": None, "e": None}


def test_prepared_content(spark):
    schema = ("title string, meta_description string, headings array<struct<level:int,text:string>>, faq array<struct<question:string,answer:string>>, internal_links array<string>,"
              "outbound_links array<string>, schema_types array<string>, author string, date_published string, metrics struct<word_count:int>, canonical_url string, body string, summary string")
    short = ("T", "", [(1, f"H{i}") for i in range(12)], [("Q1", "A")] * 4, ["a"], [], ["FAQPage"], None, None, (3,), "c", "one two three", None)
    long = ("T", "M", [], [], [], [], [], None, None, (9,), "", "x" * 4400, "y" * 400)
    rows = tokens.prepare_content(spark.createDataFrame([short, long], schema).coalesce(1), summary="summary").collect()
    assert rows[0]["method"] == "structured-only" and rows[0]["content"].endswith("Words: 3\n\nMain Content:\none two three")
    assert "H9 (H1)" in rows[0]["content"] and "H10" not in rows[0]["content"] and rows[0]["content"].count("Q1") == 3
    assert rows[1]["method"] == "ai-summarized" and rows[1]["savings_tokens"] == 1000 and rows[1]["savings_percent"] == 91
    assert tokens.prepare_content(spark.createDataFrame([long], schema)).collect()[0]["method"] == "needs-summary"


def test_text_features(evaluate):
    row = evaluate([("One two. Three four! " * 4 + "You and your team; let's see, we're here.",)], "t string", {
        "r": X.readability(F.col("t")), "empty": X.readability(F.lit("")), "long": X.readability(F.lit("w " * 30)), "mid": X.readability(F.lit("w " * 20)),
        "tone": X.conversational_tone(F.col("t")), "fmt": X.content_format(F.lit("step 1 do it. finally, stop"), F.lit(4)), "list": X.content_format(F.lit("x"), F.lit(6)),
        "nbsp": X.has_byline(F.lit("text by\u00a0ola nordmann")), "bord": X.has_byline(F.lit("nearby ola")), "o": F.lit("tøpris").rlike(X.words("pris")), "q": X.question_answering(F.lit("a? b?"), F.lit(1)),
        "no": X.first_date(F.lit("den 3. mai 2024 kl"), X.PUBLISH_DATES), "en": X.first_date(F.lit("on March 4, 2024"), X.PUBLISH_DATES), "up": X.first_date(F.lit("Sist endret: 1. juni 2023"), X.UPDATE_DATES),
        "label": X.initials_label(F.lit("direct_answer")),
    })[0]
    assert (row["r"], row["empty"], row["long"], row["mid"]) == (85, 0, 45, 65)
    assert row["fmt"] == "step-by-step guide" and row["list"] == "listicle" and row["nbsp"] is True and row["bord"] is False and row["q"] == 40.0
    assert row["o"] is True, "ø is no ASCII word character, so a border stands before 'pris'"
    assert (row["no"], row["en"], row["up"]) == ("3. mai 2024", "March 4, 2024", "Sist endret: 1. juni 2023") and row["label"] == "Direct Answer"
    assert row["tone"] == pytest.approx(4 / 24 * 100)


def test_keys(evaluate):
    row = evaluate([("ab", "c")], "a string, b string", {
        "j": K.joint_hash(F.col("a"), F.col("b")), "k": K.joint_hash(F.lit("a"), F.lit("bc")), "empty": K.content_key(F.lit("")), "short": K.short_hash(F.col("a")),
        "ver": K.versioned_key(F.col("a"), F.lit("")), "ns": K.namespaced_key("nope:", F.col("a"), F.col("b")), "same": K.identical(F.col("a"), F.lit("ab")),
        "hash_null": tables.content_hash(F.lit(None).cast("string")), "strict_null": tables.content_hash(F.lit(""), empty_is_null=True)})[0]
    assert row["j"] != row["k"] and row["empty"] is None and len(row["short"]) == 16 and row["ver"] is None and row["ns"] is None and row["same"] is True
    assert row["hash_null"].startswith("e3b0c442") and row["strict_null"] is None
