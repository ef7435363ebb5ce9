"""Registered queries over runs, pages, scores, tenants and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import initials_label
from ..operators import filters as L
from ..operators import history, links, ordered, paging, quality, reports, rubric, store, tables, tenancy, tokens
from .bindings import Tables, ctes
from .registry import query

C = F.col
AS_OF = "1999-01-10 00:00:00"
NOON = "2024-02-01 12:00:00"
#: Buckets of the stored tables that the queries make.
BUCKETS = 16


# --- filters -----------------------------------------------------------------------------------
@query("lookup_by_hash", "B1", ctes("site_pages") + """SELECT page_id, url FROM site_pages WHERE project_id = 3 AND sha256(url) IN (SELECT sha256(url) FROM site_pages WHERE page_type = 'building')""")
def lookup_by_hash(t: Tables):
    keyed = t.pages.withColumn("url_hash", U.url_hash(C("url")))
    wanted = t.pages.filter("page_type = 'building'").select(U.url_hash(C("url")).alias("url_hash"))
    return L.equals_any(keyed.filter("project_id = 3"), "url_hash", wanted).select("page_id", "url")


@query("lookup_by_email", "B1", ctes("users") + """SELECT user_id, name FROM users WHERE email = lower('Supplier.000000003@Example.com')""")
def lookup_by_email(t: Tables):
    return t.users.filter(C("email") == F.lower(F.lit("Supplier.000000003@Example.com"))).select("user_id", "name")


@query("active_runs", "B2", ctes("runs") + """SELECT run_id, status, created_at FROM runs WHERE status IN ('queued', 'running')""")
def active_runs(t: Tables):
    return L.active_runs(t.runs).select("run_id", "status", "created_at")


@query("score_range", "B3", ctes("scores") + """SELECT score_id, page_id, overall_score FROM scores WHERE overall_score BETWEEN 40 AND 80 AND page_type = 'view'""")
def score_range(t: Tables):
    return t.scores.filter(L.in_score_range(40, 80, "view")).select("score_id", "page_id", "overall_score")


@query("stale_pages", "B4", ctes("site_pages", "runs") + f""", seen AS (SELECT p.page_id, min(created_at) AS first_discovered_at, max(created_at) AS last_crawled_at FROM site_pages p LEFT JOIN runs r ON r.page_id = p.page_id AND r.status = 'completed' GROUP BY p.page_id)
 SELECT page_id, first_discovered_at, last_crawled_at FROM seen WHERE last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY first_discovered_at NULLS FIRST, page_id LIMIT 100""")
def stale_pages(t: Tables):
    done = t.runs.filter("status = 'completed'").groupBy("page_id").agg(F.min("created_at").alias("first_discovered_at"), F.max("created_at").alias("last_crawled_at"))
    pages = t.pages.select("page_id").join(done, "page_id", "left")
    return L.stale_pages(pages, F.lit(AS_OF).cast("timestamp_ntz")).select("page_id", "first_discovered_at", "last_crawled_at")


@query("project_search", "B5", ctes("projects") + """SELECT project_id, name FROM projects WHERE name ILIKE '%nation\\_1%' ESCAPE '\\'""")
def project_search(t: Tables):
    return t.projects.filter(L.name_contains("name", "nation_1")).select("project_id", "name")


@query("page_table", "B6 C2", ctes("site_pages", "scores") + """, cur AS (SELECT page_id, arg_max(overall_score, (scored_at, score_id)) AS overall_score, max(scored_at) AS scored_at FROM scores GROUP BY page_id)
 SELECT p.page_id, overall_score FROM site_pages p LEFT JOIN cur c ON c.page_id = p.page_id WHERE (lower(url) LIKE '%site1%' OR lower(title) LIKE '%site1%') AND overall_score >= 30""")
def page_table(t: Tables):
    cur = history.latest_score(t.scores, ["overall_score", "scored_at"])
    return t.pages.join(cur, "page_id", "left").filter(L.page_table_filter("Site1", low=30)).select("page_id", "overall_score")


@query("score_bands", "B11", ctes("scores") + """SELECT CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good' WHEN overall_score >= 40 THEN 'Fair' ELSE 'Poor' END AS band,
 CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good' WHEN overall_score >= 40 THEN 'Needs Work' ELSE 'Poor' END AS result_band, count(*) AS n FROM scores GROUP BY 1, 2""")
def score_bands(t: Tables):
    s = C("overall_score")
    return t.scores.groupBy(L.score_band(s).alias("band"), L.score_band(s, L.RESULT_BANDS).alias("result_band")).agg(F.count("*").alias("n"))


@query("run_list", "B12 D15 B18", ctes("runs") + """SELECT run_id, CASE WHEN pages_discovered > 0 THEN CAST(floor(pages_processed / pages_discovered * 100 + 0.5) AS INT) ELSE 0 END AS progress,
 CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ago'
 WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END || ' ago' ELSE strftime(created_at, '%Y-%m-%d') END AS age
 FROM (SELECT *, CAST(epoch(TIMESTAMP '2000-06-03 05:00:00') - epoch(created_at) AS BIGINT) AS s FROM runs WHERE status IN ('running', 'queued') AND created_at <= TIMESTAMP '2000-06-03 05:00:00')""")
def run_list(t: Tables):
    as_of = F.lit("2000-06-03 05:00:00").cast("timestamp_ntz")
    rows = t.runs.filter(L.run_list_filter("running") & (C("created_at") <= as_of))
    return rows.select("run_id", reports.progress(C("pages_processed"), C("pages_discovered")).alias("progress"), L.relative_age(C("created_at"), as_of).alias("age"))


@query("pending_users", "B15", ctes("users") + "SELECT user_id, email FROM users WHERE NOT approved")
def pending_users(t: Tables):
    return t.users.filter(~C("approved")).select("user_id", "email")


@query("api_projection", "B17", ctes("runs") + """SELECT run_id AS "crawlRunId", status, pages_discovered AS "pagesDiscovered", pages_processed AS "pagesProcessed" FROM runs WHERE status = 'completed'""")
def api_projection(t: Tables):
    return t.runs.filter("status = 'completed'").select(
        C("run_id").alias("crawlRunId"), "status", C("pages_discovered").alias("pagesDiscovered"), C("pages_processed").alias("pagesProcessed")
    )


@query("slow_requests", "B19", ctes("runs") + "SELECT status, count(*) AS slow FROM runs WHERE duration_ms > 1000 GROUP BY status")
def slow_requests(t: Tables):
    return t.runs.filter(L.slower_than()).groupBy("status").agg(F.count("*").alias("slow"))


# --- validation -------------------------------------------------------------------------------------
@query("run_validation", "B10", ctes("runs") + """SELECT error, count(*) AS n FROM (SELECT 'pages_processed cannot exceed pages_discovered' AS error FROM runs WHERE pages_processed > pages_discovered AND pages_processed <> 0 AND pages_discovered <> 0) GROUP BY error""")
def run_validation(t: Tables):
    return quality.error_report(t.runs.withColumn("errors", quality.run_errors(C("status"), C("pages_processed"), C("pages_discovered"))))


@query("config_validation", "B10", """SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_linenumber NOT BETWEEN 1 AND 10 THEN 'depth_limit must be between 1 and 10' END,
 CASE WHEN l_quantity - 10 <= 0 THEN 'sample_size must be greater than 0' END, CASE WHEN l_tax <= 0 THEN 'token_limit must be greater than 0' END], lambda x: x IS NOT NULL)) AS error FROM lineitem) GROUP BY error""")
def config_validation(t: Tables):
    return quality.error_report(t.raw("lineitem").withColumn("errors", quality.config_errors(C("l_linenumber"), C("l_quantity") - 10, C("l_tax"))))


@query("email_validation", "B10", ctes("users") + r"""SELECT user_id, regexp_matches(email, '(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}$') AS valid FROM users""")
def email_validation(t: Tables):
    return t.users.select("user_id", quality.is_email(C("email")).alias("valid"))


@query("criteria_validation", "B10 A8", """SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_type NOT IN ('view', 'click') THEN 'Invalid criterion: ' || event_type END,
 CASE WHEN event_type IN ('view', 'click') AND FALSE THEN '' END, CASE WHEN floor(value) > 100 THEN event_type || ' must be between 0 and 100' END], lambda x: x IS NOT NULL)) AS error
 FROM (SELECT CASE event_type WHEN 'purchase' THEN 'purchase' ELSE event_type END AS event_type, value FROM events)) GROUP BY error""".replace("('view', 'click')", "('readability', 'performance')").replace(
    "CASE event_type WHEN 'purchase' THEN 'purchase' ELSE event_type END", "CASE event_type WHEN 'view' THEN 'readability' WHEN 'click' THEN 'performance' ELSE event_type END"))
def criteria_validation(t: Tables):
    name = F.when(C("event_type") == "view", "readability").when(C("event_type") == "click", "performance").otherwise(C("event_type"))
    one = F.create_map(name, F.floor("value").cast("int"))
    return quality.error_report(t.raw("events").withColumn("errors", quality.criteria_errors(one)))


@query("score_warnings", "B10", """SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN floor(value) > 100 THEN 'Overall score out of range' END, CASE WHEN floor(value) > 100 THEN 'Criterion readability score out of range' END,
 CASE WHEN length(props) < 20 THEN 'Recommendation 0 too short' END, CASE WHEN event_type = 'error' THEN 'Recommendation 0 missing references' END], lambda x: x IS NOT NULL)) AS error FROM events) GROUP BY error""")
def score_warnings(t: Tables):
    refs = F.when(C("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    recs = F.array(F.struct(F.lit("readability").alias("category"), C("props").alias("text"), refs.alias("references")))
    score = F.floor("value").cast("int")
    return quality.error_report(t.raw("events").withColumn("errors", quality.score_warnings(score, F.create_map(F.lit("readability"), score), recs)))


@query("extraction_validation", "B10", """SELECT error, count(*) AS n FROM (SELECT 'extraction.headings must be an array' AS error FROM events WHERE event_type = 'error' UNION ALL SELECT 'extraction must be an object' FROM events WHERE event_type = 'view') GROUP BY error""")
def extraction_validation(t: Tables):
    wrong = F.replace("props", F.lit('"k"'), F.lit('"headings"'))
    text = F.when(C("event_type") == "error", wrong).when(C("event_type") == "view", F.lit("[1]")).otherwise(F.lit('{"headings": [], "faq": [1]}'))
    return quality.error_report(t.raw("events").withColumn("errors", quality.extraction_errors(F.try_parse_json(text))))


# --- joins and tenants ----------------------------------------------------------------------------------
@query("scores_of_project", "C1 B3", ctes("site_pages", "scores") + "SELECT score_id, s.page_id, p.url, overall_score FROM scores s JOIN site_pages p ON p.page_id = s.page_id WHERE p.project_id = 7")
def scores_of_project(t: Tables):
    return t.scores.join(t.pages.filter("project_id = 7").select("page_id", "url"), "page_id").select("score_id", "page_id", "url", "overall_score")


@query("pages_with_score", "C2 F1", ctes("site_pages", "scores") + """, cur AS (SELECT page_id, arg_max(score_id, (scored_at, score_id)) AS current_score_id FROM scores GROUP BY page_id)
 SELECT p.page_id, p.url, s.overall_score, s.scored_at FROM site_pages p LEFT JOIN cur c ON c.page_id = p.page_id LEFT JOIN scores s ON s.score_id = c.current_score_id""")
def pages_with_score(t: Tables):
    pages = t.pages.join(history.latest_score(t.scores, [F.col("score_id").alias("current_score_id")]), "page_id", "left")
    return reports.pages_with_score(pages, t.scores).select("page_id", "url", "overall_score", "scored_at")


@query("tenant_scores", "C5", ctes("site_pages", "projects", "members", "scores") + """SELECT score_id FROM scores WHERE page_id IN (SELECT page_id FROM site_pages WHERE project_id IN (SELECT project_id FROM projects p JOIN members m ON m.organization_id = p.organization_id WHERE m.user_id = 4))""")
def tenant_scores(t: Tables):
    return tenancy.tenant_view(t.scores, "page", t.members, 4, t.projects, t.pages).select("score_id")


@query("tenant_writable_projects", "C5 H47", ctes("projects", "members") + "SELECT user_id, project_id FROM projects p JOIN members m ON m.organization_id = p.organization_id WHERE role IN ('admin', 'editor')")
def tenant_writable_projects(t: Tables):
    return t.projects.join(tenancy.visible_orgs(t.members, min_role="editor"), "organization_id").select("user_id", "project_id")


@query("projects_with_org", "C6", ctes("projects") + "SELECT project_id, p.name, COALESCE(o.r_name, 'Unknown') AS organization_name FROM projects p LEFT JOIN region o ON o.r_regionkey = p.organization_id + 1")
def projects_with_org(t: Tables):
    # The organisation numbers are shifted by one, so that some projects have none.
    shifted = t.projects.withColumn("organization_id", C("organization_id") + 1)
    return tenancy.with_organization(shifted, t.organizations).select("project_id", "name", "organization_name")


@query("member_users", "C7", ctes("members", "users") + "SELECT m.organization_id, m.role, u.user_id, u.email FROM members m JOIN users u ON u.user_id = m.user_id")
def member_users(t: Tables):
    return tenancy.members_with_users(t.members, t.users).select("organization_id", "role", C("user.user_id").alias("user_id"), C("user.email").alias("email"))


@query("orgs_of_users", "C7", ctes("members", "organizations") + "SELECT user_id, m.organization_id, name, role FROM members m JOIN organizations o ON o.organization_id = m.organization_id")
def orgs_of_users(t: Tables):
    return tenancy.orgs_of_users(t.members, t.organizations)


@query("removable_admins", "E9", ctes("members") + "SELECT user_id, organization_id, role <> 'admin' OR sum((role = 'admin')::INT) OVER (PARTITION BY organization_id) > 1 AS can_remove FROM members")
def removable_admins(t: Tables):
    return tenancy.removable(t.members).select("user_id", "organization_id", "can_remove")


@query("score_details", "C12 C5", ctes("site_pages", "scores", "projects", "members") + """SELECT s.score_id, p.url, s.overall_score, s.scored_at FROM scores s JOIN site_pages p ON p.page_id = s.page_id WHERE p.project_id IN
 (SELECT project_id FROM projects WHERE organization_id IN (SELECT organization_id FROM members WHERE user_id = 11)) AND s.page_type = 'purchase'""")
def score_details(t: Tables):
    allowed = tenancy.tenant_view(t.pages, "project", t.members, 11, t.projects)
    return t.scores.filter("page_type = 'purchase'").join(allowed.select("page_id", "url"), "page_id").select("score_id", "url", "overall_score", "scored_at")


@query("criteria_deltas", "C13", ctes("criteria") + """, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, criterion ORDER BY scored_at, score_id) AS a, row_number() OVER (PARTITION BY page_id, criterion ORDER BY scored_at DESC, score_id DESC) AS b FROM criteria),
 d AS (SELECT x.page_id, x.criterion, y.score - x.score AS delta FROM r x JOIN r y ON y.page_id = x.page_id AND y.criterion = x.criterion AND y.b = 1 WHERE x.a = 1)
 SELECT page_id, COALESCE(string_agg(CASE WHEN delta > 0 THEN criterion || '+' || delta END, ',' ORDER BY -delta, criterion), '') AS improved,
 COALESCE(string_agg(CASE WHEN delta < 0 THEN criterion || delta END, ',' ORDER BY delta, criterion), '') AS declined FROM d GROUP BY page_id""")
def criteria_deltas(t: Tables):
    order = F.struct("scored_at", "score_id")
    ends = t.criteria_scores.groupBy("page_id").agg(F.min_by("criteria_scores", order).alias("before"), F.max_by("criteria_scores", order).alias("after"))
    moved = history.criteria_deltas(ends, "before", "after")
    up = F.transform("improved", lambda x: F.concat(x["criterion"], F.lit("+"), x["delta"].cast("string")))
    down = F.transform("declined", lambda x: F.concat(x["criterion"], x["delta"].cast("string")))
    return moved.select("page_id", F.array_join(up, ",").alias("improved"), F.array_join(down, ",").alias("declined"))


@query("cached_scores", "C8 D9", ctes("snapshots", "scores") + """, cache AS (SELECT content_hash || CASE WHEN s.page_type IN ('view', 'click') THEN '_1.1' ELSE '_1.0' END AS cache_key, arg_max(overall_score, (scored_at, score_id)) AS cached FROM scores s JOIN snapshots n ON n.snapshot_id = s.score_id GROUP BY 1)
 SELECT snapshot_id, cached IS NOT NULL AS hit, cached AS overall_score FROM snapshots s LEFT JOIN cache c ON c.cache_key = s.content_hash || '_1.1'""")
def cached_scores(t: Tables):
    keyed = t.snapshots.withColumn("cache_key", history.cache_key(C("content_hash"), "1.1"))
    # Scores of other types are of an older rubric version, which no longer hits.
    version = F.when(C("page_type").isin("view", "click"), "1.1").otherwise("1.0")
    old = t.scores.withColumn("cache_key", history.cache_key(F.sha2("page_type", 256), version))
    return history.with_cache(keyed, old, ["overall_score"]).select("snapshot_id", "hit", "overall_score")


# --- aggregates --------------------------------------------------------------------------------------------
@query("overall_scores", "D1 A8", ctes("criteria") + "SELECT score_id, CAST(floor(avg(score) + 0.5) AS INT) AS overall_score FROM criteria GROUP BY score_id")
def overall_scores(t: Tables):
    return tables.score_rows(t.criteria_scores).select("score_id", "overall_score")


@query("default_criteria", "A8 D1", """SELECT event_id AS score_id, CAST(floor(CAST(floor(value) AS INT) % 101 / 16 + 0.5) AS INT) AS overall_score, 16 AS criteria FROM events""")
def default_criteria(t: Tables):
    one = F.create_map(F.lit("readability"), (F.floor("value") % 101).cast("int"))
    rows = tables.score_rows(t.raw("events").select(C("event_id").alias("score_id"), one.alias("criteria_scores")))
    return rows.select("score_id", "overall_score", F.size("criteria_scores").alias("criteria"))


_PROJECT_SCORES = ctes("site_pages", "scores") + ", ps AS (SELECT p.project_id, s.* FROM scores s JOIN site_pages p ON p.page_id = s.page_id) "


def _project_scores(t: Tables):
    return t.scores.join(t.pages.select("page_id", "project_id"), "page_id")


@query("project_score_stats", "D2", _PROJECT_SCORES + """SELECT n_nationkey AS project_id, count(score_id) AS total, CAST(COALESCE(floor(avg(overall_score) + 0.5), 0) AS INT) AS average, COALESCE(min(overall_score), 100) AS min_score, COALESCE(max(overall_score), 0) AS max_score
 FROM nation LEFT JOIN ps ON ps.project_id = n_nationkey GROUP BY 1""")
def project_score_stats(t: Tables):
    return reports.score_stats_for_all(t.projects, _project_scores(t))


@query("page_type_stats", "D3", _PROJECT_SCORES + "SELECT project_id, page_type, count(*) AS total, CAST(floor(avg(overall_score) + 0.5) AS INT) AS average FROM ps GROUP BY 1, 2")
def page_type_stats(t: Tables):
    return reports.stats_by_page_type(_project_scores(t))


@query("run_snapshot_stats", "D4", ctes("snapshots") + "SELECT run_id, count(*) AS total, count(*) FILTER (status_code BETWEEN 200 AND 299) AS successful, count(*) FILTER (status_code >= 400) AS failed FROM snapshots GROUP BY run_id")
def run_snapshot_stats(t: Tables):
    return reports.snapshot_stats(t.snapshots)


@query("status_code_counts", "D4", ctes("snapshots") + "SELECT run_id, status_code, count(*) AS n FROM snapshots GROUP BY 1, 2")
def status_code_counts(t: Tables):
    return t.snapshots.groupBy("run_id", "status_code").agg(F.count("*").alias("n"))


@query("project_counts", "D6 D7", ctes("projects", "site_pages", "runs") + """, rp AS (SELECT p.project_id, count(*) AS runs FROM runs r JOIN site_pages p ON p.page_id = r.page_id GROUP BY 1), pp AS (SELECT project_id, count(*) AS pages FROM site_pages GROUP BY 1)
 SELECT p.project_id, name, COALESCE(runs, 0) AS runs, COALESCE(pages, 0) AS pages FROM projects p LEFT JOIN rp ON rp.project_id = p.project_id LEFT JOIN pp ON pp.project_id = p.project_id""")
def project_counts(t: Tables):
    runs = t.runs.select("page_id").join(t.pages.select("page_id", "project_id"), "page_id")
    return reports.counts_per(t.projects, "project_id", {"runs": runs, "pages": t.pages}).select("project_id", "name", "runs", "pages")


@query("org_counts", "D6 D7", ctes("organizations", "projects", "members") + """SELECT organization_id, name, (SELECT count(*) FROM members m WHERE m.organization_id = o.organization_id) AS members, (SELECT count(*) FROM projects p WHERE p.organization_id = o.organization_id) AS projects,
 (SELECT count(*) FROM members m WHERE m.organization_id = o.organization_id AND role = 'admin') AS admins FROM organizations o""")
def org_counts(t: Tables):
    return reports.counts_per(t.organizations, "organization_id", {"members": t.members, "projects": t.projects, "admins": t.members.filter("role = 'admin'")})


@query("category_averages", "D8 H46", ctes("criteria") + """, c AS (SELECT score_id, CASE WHEN criterion IN ('direct_answer', 'question_coverage', 'readability') THEN 'Content Quality' WHEN criterion IN ('eeat_signals', 'outbound_links') THEN 'E-A-T Signals'
 WHEN criterion IN ('performance', 'indexing', 'internal_linking', 'accessibility') THEN 'Technical SEO' WHEN criterion = 'schema_markup' THEN 'Structured Data' ELSE 'General' END AS category, score FROM criteria)
 SELECT score_id, category, CAST(floor(avg(score) + 0.5) AS INT) AS average, count(*) AS criteria FROM c GROUP BY 1, 2""")
def category_averages(t: Tables):
    return reports.category_averages(t.criteria_scores, rubric.view_category(C("criterion")))


@query("criterion_labels", "H46 D8", ctes("criteria") + """SELECT array_to_string(list_transform(string_split(criterion, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label, CAST(floor(avg(score) + 0.5) AS INT) AS average FROM criteria GROUP BY criterion""")
def criterion_labels(t: Tables):
    from ..functions.numbers import round_half_up

    return t.criteria_scores.select(F.explode("criteria_scores").alias("criterion", "score")).groupBy("criterion").agg(
        round_half_up(F.avg("score")).alias("average")
    ).select(initials_label(C("criterion")).alias("label"), "average")


@query("scoring_run_summary", "D9 D21", ctes("items") + """SELECT run_id, count(*) FILTER (state = 'O') AS scores_created, count(*) FILTER (flag = 'A' AND state = 'O') AS cache_hits, CAST(sum(CASE WHEN flag = 'A' OR state <> 'O' THEN 0 ELSE tokens END) AS BIGINT) AS tokens_used,
 count(*) FILTER (state <> 'O') AS errors, count(*) FILTER (flag = 'A' AND state = 'O') / count(*) * 100 AS hit_rate FROM items GROUP BY run_id""")
def scoring_run_summary(t: Tables):
    rows = t.items.select("run_id", "tokens", (C("flag") == "A").alias("hit"), (C("state") != "O").alias("failed"))
    return reports.scoring_summary(rows, ["run_id"])


@query("token_stats", "D11 D12 H34", ctes("items") + """, u AS (SELECT run_id, sum(tokens) AS total, CASE WHEN run_id % 3 = 0 THEN NULL ELSE 100 END AS token_limit FROM items GROUP BY run_id)
 SELECT run_id, CAST(total AS BIGINT) AS total_tokens, round(total * 0.03 / 1000, 6) AS cost_usd, token_limit IS NOT NULL AS limited_mode, CAST(floor(total / token_limit * 100 + 0.5) AS INT) AS percent_used, CAST(greatest(0, token_limit - total) AS DOUBLE) AS remaining_tokens, total > token_limit AS exceeded
 FROM (SELECT run_id, total, token_limit FROM u)""".replace("CAST(greatest(0, token_limit - total) AS DOUBLE)", "CASE WHEN token_limit IS NOT NULL THEN CAST(greatest(0, token_limit - total) AS DOUBLE) END"))
def token_stats(t: Tables):
    used = t.items.groupBy("run_id").agg(F.sum("tokens").alias("total_tokens")).withColumn("token_limit", F.when(C("run_id") % 3 != 0, F.lit(100)))
    return tokens.token_stats(used).withColumn("cost_usd", F.round("cost_usd", 6)).drop("token_limit")


@query("budget_checks", "H34", ctes("items") + """SELECT run_id, pos, part, amount, tokens + 10 <= 40 AS within, CAST(greatest(0, 40 - tokens) AS DOUBLE) AS remaining FROM items""")
def budget_checks(t: Tables):
    return t.items.select("run_id", "pos", "part", "amount", tokens.within_budget(C("tokens"), F.lit(10), F.lit(40)).alias("within"), tokens.remaining(C("tokens"), F.lit(40)).alias("remaining"))


@query("project_tokens", "D12", _PROJECT_SCORES + "SELECT project_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM ps GROUP BY 1")
def project_tokens(t: Tables):
    return _project_scores(t).groupBy("project_id").agg(F.sum("tokens").alias("tokens"))


@query("daily_scores", "D13", ctes("scores") + "SELECT CAST(scored_at AS DATE) AS day, count(*) AS scores, CAST(floor(avg(overall_score) + 0.5) AS INT) AS average FROM scores GROUP BY 1")
def daily_scores(t: Tables):
    return reports.daily_scores(t.scores)


@query("queue_health", "D16", ctes("runs") + """, q AS (SELECT page_id % 5 AS queue, CASE status WHEN 'failed' THEN 'failed' WHEN 'running' THEN 'active' WHEN 'queued' THEN 'waiting' ELSE 'done' END AS state FROM runs),
 s AS (SELECT queue, count(*) AS total, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'waiting') AS waiting FROM q GROUP BY 1)
 SELECT queue, total, failed, active, waiting, round(failed / total * 100, 6) AS failure_rate, CASE WHEN queue = 4 THEN 'paused' WHEN failed / total * 100 > 50 THEN 'critical' WHEN failed / total * 100 > 20 OR waiting > 1000 THEN 'degraded' ELSE 'healthy' END AS health FROM s""")
def queue_health(t: Tables):
    return _queues(t).select("queue", "total", "failed", "active", "waiting", F.round("failure_rate", 6).alias("failure_rate"), "health")


def _queues(t: Tables):
    state = F.when(C("status") == "failed", "failed").when(C("status") == "running", "active").when(C("status") == "queued", "waiting").otherwise("done")
    return reports.queue_health(t.runs.select((C("page_id") % 5).alias("queue"), state.alias("state")), C("queue") == 4)


@query("system_health", "D16", ctes("runs") + """, s AS (SELECT page_id % 5 AS queue, count(*) FILTER (status = 'failed') / count(*) * 100 AS f, count(*) FILTER (status = 'queued') AS w FROM runs GROUP BY 1)
 SELECT CASE WHEN bool_or(queue <> 4 AND f > 50) THEN 'critical' WHEN bool_or(queue <> 4 AND (f > 20 OR w > 1000)) THEN 'degraded' ELSE 'healthy' END AS overall_health, count(*) AS queues FROM s""")
def system_health(t: Tables):
    return reports.system_health(_queues(t))


@query("usage_counters", "D17", ctes("snapshots") + "SELECT run_id AS endpoint, page_id % 2 AS method, count(*) AS total, count(*) FILTER (status_code < 400) AS success, count(*) FILTER (status_code >= 400) AS errors FROM snapshots GROUP BY 1, 2")
def usage_counters(t: Tables):
    return reports.usage_counters(t.snapshots.select(C("run_id").alias("endpoint"), (C("page_id") % 2).alias("method"), "status_code"))


@query("rubric_weighting", "D18 A4 D8", ctes("criteria") + """, c AS (SELECT CASE WHEN i < 6 THEN 'Content Quality & AI Optimization' WHEN i < 9 THEN 'E-A-T Signals' WHEN i < 14 THEN 'Technical SEO' ELSE 'Structured Data' END AS category, k.criterion, score
 FROM criteria k JOIN (SELECT unnest(['direct_answer','question_coverage','readability','content_freshness','conversational_tone','snippet_optimization','eeat_signals','outbound_links','original_research','performance','indexing','internal_linking','accessibility','multimedia_richness','schema_markup','entity_clarity']) AS criterion, unnest(range(16)) AS i) r ON r.criterion = k.criterion)
 SELECT category, count(DISTINCT criterion) AS criteria, 0.25 AS weight, CAST(floor(avg(score) + 0.5) AS INT) AS average FROM c GROUP BY category""")
def rubric_weighting(t: Tables):
    from ..functions.numbers import round_half_up

    rules = rubric.load_rubric(t.spark)
    stats = rubric.rubric_stats(rules)
    per = t.criteria_scores.select(F.explode("criteria_scores").alias("criterion", "score")).groupBy("criterion").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    by_category = per.join(F.broadcast(rubric.criteria(rules).select("criterion", "category")), "criterion").groupBy("category").agg(round_half_up(F.sum("s") / F.sum("n")).alias("average"))
    return stats.join(by_category, "category")


@query("batch_outcomes", "D21", ctes("runs") + "SELECT status <> 'failed' AS success, CASE WHEN status = 'failed' THEN 'run failed' ELSE '' END AS error, count(*) AS n FROM runs GROUP BY 1, 2")
def batch_outcomes(t: Tables):
    return reports.outcomes(t.runs.select(F.when(C("status") == "failed", F.lit("run failed")).alias("error")))


@query("merged_rubrics", "G5 B10", """SELECT p_type AS category, p_brand AS criterion, min(p_partkey) AS pos FROM part GROUP BY 1, 2""")
def merged_rubrics(t: Tables):
    sets = t.raw("part").select((C("p_partkey") / 100).cast("int").alias("set_pos"), C("p_type").alias("category"), C("p_brand").alias("criterion"), C("p_partkey").alias("pos"))
    return rubric.merge_rubrics(sets).select("category", "criterion", "pos")


@query("page_type_list", "G6 G3", """SELECT DISTINCT COALESCE(NULLIF(lower(c_mktsegment), 'building'), 'unknown') AS page_type FROM customer UNION ALL SELECT 'all'""")
def page_type_list(t: Tables):
    types = t.pages.select(F.coalesce(F.when(C("page_type") != "building", C("page_type")), F.lit("unknown")).alias("page_type")).distinct()
    return t.spark.createDataFrame([("all",)], "page_type string").unionByName(types)


# --- sort, paging, top-k -------------------------------------------------------------------------------------
@query("page_list_sorted", "F1 F2 B3", ctes("site_pages", "scores") + """, cur AS (SELECT page_id, arg_max(overall_score, (scored_at, score_id)) AS overall_score FROM scores GROUP BY page_id)
 SELECT p.page_id, overall_score FROM site_pages p LEFT JOIN cur c ON c.page_id = p.page_id ORDER BY COALESCE(overall_score, 0) DESC, p.page_id LIMIT 20 OFFSET 20""")
def page_list_sorted(t: Tables):
    joined = t.pages.select("page_id").join(history.latest_score(t.scores, ["overall_score"]), "page_id", "left")
    return reports.page_of(reports.order_pages(joined, "overall_score", True), 2, 20)


@query("keyset_page", "F2", ctes("scores") + "SELECT score_id, overall_score FROM scores WHERE overall_score < 50 OR (overall_score = 50 AND score_id > 300) ORDER BY overall_score DESC, score_id LIMIT 25")
def keyset_page(t: Tables):
    return reports.after_key(t.scores.select("score_id", "overall_score"), "overall_score", "score_id", 50, 300, 25)


@query("deep_page", "F2", ctes("scores") + """SELECT score_id, page_id, overall_score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY overall_score DESC, scored_at, score_id) AS rank FROM scores) WHERE rank > 725 AND rank <= 750""")
def deep_page(t: Tables):
    listed = paging.sorted_list(t.scores, [C("overall_score").desc(), C("scored_at").asc(), C("score_id").asc()])
    return listed.page(30, 25).select("score_id", "page_id", "overall_score", "rank")


@query("recent_projects", "F3", ctes("site_pages", "runs") + "SELECT project_id, max(created_at) AS updated_at FROM runs r JOIN site_pages p ON p.page_id = r.page_id GROUP BY 1 ORDER BY updated_at DESC, project_id LIMIT 5")
def recent_projects(t: Tables):
    touched = t.runs.groupBy("page_id").agg(F.max("created_at").alias("at")).join(t.pages.select("page_id", "project_id"), "page_id")
    return touched.groupBy("project_id").agg(F.max("at").alias("updated_at")).orderBy(C("updated_at").desc(), "project_id").limit(5)


@query("lowest_pages", "F5", ctes("scores") + ", cur AS (SELECT page_id, arg_max(overall_score, (scored_at, score_id)) AS overall_score FROM scores GROUP BY page_id) SELECT page_id, overall_score FROM cur ORDER BY overall_score, page_id LIMIT 10")
def lowest_pages(t: Tables):
    return reports.lowest_pages(history.latest_score(t.scores, ["overall_score"]), 10)


# --- history --------------------------------------------------------------------------------------------------
@query("latest_snapshots", "E1", ctes("snapshots") + "SELECT page_id, arg_max(snapshot_id, (snapshot_at, snapshot_id)) AS snapshot_id, arg_max(content_hash, (snapshot_at, snapshot_id)) AS content_hash FROM snapshots GROUP BY page_id")
def latest_snapshots(t: Tables):
    return history.latest_snapshot(t.snapshots, ["snapshot_id", "content_hash"])


_CHANGED = ctes("snapshots") + ", c AS (SELECT *, lag(content_hash) OVER (PARTITION BY page_id ORDER BY snapshot_at, snapshot_id) IS DISTINCT FROM content_hash AS changed FROM snapshots) "


@query("changed_snapshots", "E2", _CHANGED + "SELECT snapshot_id, changed FROM c")
def changed_snapshots(t: Tables):
    return history.with_change(t.snapshots).select("snapshot_id", "changed")


@query("snapshot_gate", "E3 L4", _CHANGED + "SELECT snapshot_id FROM c WHERE changed OR run_id % 7 = 0")
def snapshot_gate(t: Tables):
    return history.snapshot_gate(t.snapshots, F.when(C("run_id") % 7 == 0, "full").otherwise("delta")).select("snapshot_id")


@query("score_history", "E4", ctes("scores") + "SELECT score_id, page_id, overall_score, overall_score - lag(overall_score) OVER (PARTITION BY page_id ORDER BY scored_at, score_id) AS delta FROM scores")
def score_history(t: Tables):
    return history.score_history(t.scores).select("score_id", "page_id", "overall_score", "delta")


_BUDGET = "SELECT *, sum(tokens) OVER (PARTITION BY run_id ORDER BY pos, part, supp, amount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM items"


@query("budget_cut", "E5 J4", ctes("items") + f", b AS ({_BUDGET}) SELECT run_id, pos, part, amount, CAST(COALESCE(before, 0) AS BIGINT) AS tokens_before FROM b WHERE run_id % 4 = 0 OR COALESCE(before, 0) < 60")
def budget_cut(t: Tables):
    order = [C("pos"), C("part"), C("supp"), C("amount")]
    cut = tokens.budget_cut(t.items, "run_id", F.floor(C("pos") / 1000), order, "tokens", F.when(C("run_id") % 4 != 0, F.lit(60)))
    return cut.select("run_id", "pos", "part", "amount", "tokens_before")


@query("run_sample", "E6 E7", ctes("items") + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos, part, supp, amount) AS visit FROM items) SELECT run_id, visit, part, amount FROM r WHERE visit <= 3""")
def run_sample(t: Tables):
    return links.sample(t.items, 3, [C("pos"), C("part"), C("supp"), C("amount")], "part").select("run_id", "visit", "part", "amount")


@query("rescore_batch", "E10", ctes("snapshots") + """, cur AS (SELECT page_id, arg_max(snapshot_id, (snapshot_at, snapshot_id)) AS current_snapshot_id, arg_max(run_id, (snapshot_at, snapshot_id)) AS run_id FROM snapshots GROUP BY page_id)
 SELECT page_id, current_snapshot_id, (SELECT run_id FROM cur ORDER BY page_id LIMIT 1) AS booked_run_id FROM cur""")
def rescore_batch(t: Tables):
    cur = history.latest_snapshot(t.snapshots, [C("snapshot_id").alias("current_snapshot_id"), C("run_id").alias("last_crawl_run_id")])
    return history.rescore_batch(t.pages.select("page_id").join(cur, "page_id", "left"))


_OLD, _NEW = "run_id BETWEEN 1 AND 15", "run_id BETWEEN 16 AND 31"


def _sides():
    return C("run_id").between(1, 15), C("run_id").between(16, 31)


@query("run_comparison", "C3", ctes("scores") + f""", s AS (SELECT page_id, arg_max(overall_score, (scored_at, score_id)) FILTER ({_OLD}) AS old_score, arg_max(overall_score, (scored_at, score_id)) FILTER ({_NEW}) AS new_score FROM scores GROUP BY page_id)
 SELECT page_id, old_score, new_score, new_score - old_score AS change FROM s""")
def run_comparison(t: Tables):
    return history.compare_runs(t.scores, *_sides())


@query("run_comparison_summary", "D14", ctes("scores") + f""", s AS (SELECT page_id, arg_max(overall_score, (scored_at, score_id)) FILTER ({_NEW}) - arg_max(overall_score, (scored_at, score_id)) FILTER ({_OLD}) AS change FROM scores GROUP BY page_id)
 SELECT count(*) FILTER (change > 0) AS improved, count(*) FILTER (change < 0) AS declined, count(*) FILTER (change = 0) AS stable, CAST(COALESCE(sum(change), 0) AS BIGINT) AS total_change FROM s""")
def run_comparison_summary(t: Tables):
    return history.comparison_summary(history.compare_runs(t.scores, *_sides()))


@query("unchanged_pages", "C4", ctes("snapshots") + f"SELECT page_id, content_hash, count(*) FILTER ({_OLD}) AS in_old, count(*) FILTER ({_NEW}) AS in_new FROM snapshots GROUP BY 1, 2 HAVING count(*) FILTER ({_OLD}) > 0 AND count(*) FILTER ({_NEW}) > 0")
def unchanged_pages(t: Tables):
    return history.unchanged_between(t.snapshots, *_sides())


@query("removed_pages", "C10", ctes("snapshots") + "SELECT DISTINCT page_id FROM snapshots WHERE run_id = 3 AND page_id NOT IN (SELECT page_id FROM snapshots WHERE run_id = 4)")
def removed_pages(t: Tables):
    return history.removed_pages(t.snapshots, C("run_id") == 3, C("run_id") == 4)


# --- tables -----------------------------------------------------------------------------------------------------
@query("snapshot_append", "A5", """SELECT doc_id, sha256(text) AS content_hash, 200 AS status_code, 'static' AS render_method, source FROM documents""")
def snapshot_append(t: Tables):
    import uuid

    from ..session import shared_dir

    path = f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}"
    rows = tables.snapshot_rows(t.raw("documents").select("doc_id", "text", "source"), "text").drop("text")
    tables.append(rows, path, ["source"])
    return t.spark.read.schema("doc_id long, status_code int, render_method string, content_hash string, source string").parquet(path)


@query("page_upsert", "A7", """WITH target AS (SELECT c_custkey AS page_id, lower(c_mktsegment) AS page_type FROM customer), batch AS (SELECT user_id * 20 AS page_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS page_type, max(dayofyear(ts)) AS run, arg_max(dayofyear(ts), event_id) AS last_run FROM events GROUP BY user_id)
 SELECT COALESCE(t.page_id, b.page_id) AS page_id, COALESCE(b.page_type, t.page_type) AS page_type, b.last_run AS last_crawl_run_id, CASE WHEN t.page_id IS NULL THEN '2024-02-01' ELSE '2020-01-01' END AS first_discovered, b.page_id IS NOT NULL AS crawled_now FROM target t FULL OUTER JOIN batch b ON b.page_id = t.page_id""")
def page_upsert(t: Tables):
    key = U.url_hash(C("page_id").cast("string"))
    target = t.pages.select(
        F.lit(1).alias("project_id"), key.alias("url_hash"), C("page_id").cast("string").alias("url"), "page_type", F.lit(None).cast("int").alias("last_crawl_run_id"),
        F.lit("2020-01-01").cast("timestamp").alias("first_discovered_at"), F.lit(None).cast("timestamp").alias("last_crawled_at"),
    )
    batch = t.raw("events").select(
        F.lit(1).alias("project_id"), U.url_hash((C("user_id") * 20).cast("string")).alias("url_hash"), (C("user_id") * 20).cast("string").alias("url"),
        F.when(C("event_type") != "error", C("event_type")).alias("page_type"), F.dayofyear("ts").alias("last_crawl_run_id"), C("event_id").alias("pos"),
    )
    now = F.lit("2024-02-01").cast("timestamp")
    table = store.create(target, ["project_id", "url_hash"], BUCKETS, name="pages")
    for _ in range(2):  # the second time it is a replay, which changes nothing
        store.upsert_pages(table, batch, 1, now, ["page_type", "last_crawl_run_id"])
    return table.read().select(
        C("url").cast("long").alias("page_id"), "page_type", "last_crawl_run_id", F.date_format("first_discovered_at", "yyyy-MM-dd").alias("first_discovered"),
        (C("last_crawled_at") == now).eqNullSafe(True).alias("crawled_now"),
    )


@query("run_updates", "A9", ctes("runs") + """, u AS (SELECT l_orderkey AS run_id, CASE WHEN sum(l_quantity) > 100 THEN 'completed' END AS status FROM lineitem GROUP BY 1)
 SELECT r.run_id, COALESCE(u.status, r.status) AS status, CASE WHEN COALESCE(u.status, r.status) IN ('completed', 'failed') THEN '2024-02-01' END AS completed_on FROM runs r LEFT JOIN u ON u.run_id = r.run_id""")
def run_updates(t: Tables):
    updates = t.items.groupBy("run_id").agg(F.when(F.sum("tokens") > 100, F.lit("completed")).alias("status"))
    runs = t.runs.withColumn("completed_at", F.lit(None).cast("timestamp"))
    updates = t.runs.select("run_id").join(updates, "run_id", "left")  # runs without items, too
    table = store.create(runs, ["run_id"], BUCKETS, name="runs")
    store.update_runs(table, updates, 1, F.lit("2024-02-01").cast("timestamp"), ["status"])
    return table.read().select("run_id", "status", F.date_format("completed_at", "yyyy-MM-dd").alias("completed_on"))


@query("run_counters", "A10", ctes("runs", "items") + ", d AS (SELECT run_id, sum(tokens) AS t, count(*) AS n FROM items GROUP BY 1) SELECT r.run_id, CAST(pages_processed + COALESCE(n, 0) AS BIGINT) AS pages_processed, CAST(COALESCE(t, 0) AS BIGINT) AS token_usage FROM runs r LEFT JOIN d ON d.run_id = r.run_id")
def run_counters(t: Tables):
    deltas = t.items.select("run_id", C("tokens").alias("token_usage"), F.lit(1).alias("pages_processed"))
    runs = t.runs.withColumn("token_usage", F.lit(0))
    table = store.create(runs.withColumn("pages_processed", C("pages_processed").cast("long")).withColumn("token_usage", C("token_usage").cast("long")), ["run_id"], BUCKETS, name="counters")
    for _ in range(2):  # a replayed batch adds nothing
        store.add_counts(table, deltas, 1, ["pages_processed", "token_usage"])
    return table.read().select("run_id", "pages_processed", "token_usage")


@query("cascade_delete", "A11", ctes("site_pages", "scores") + "SELECT score_id FROM scores WHERE page_id NOT IN (SELECT page_id FROM site_pages WHERE project_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")
def cascade_delete(t: Tables):
    gone = t.pages.join(t.projects.filter("organization_id = 2").select("project_id"), "project_id", "left_semi")
    table = store.create(t.scores.select("page_id", "score_id"), ["page_id"], BUCKETS, name="scores")
    store.delete_children(table, gone)
    return table.read().select("score_id")


@query("resume_pending", "L8", ctes("items") + "SELECT run_id, part FROM (SELECT DISTINCT run_id, part FROM items WHERE state = 'O') x WHERE NOT EXISTS (SELECT 1 FROM items y WHERE y.run_id = x.run_id AND y.part = x.part AND y.state = 'F')")
def resume_pending(t: Tables):
    found = t.items.filter("state = 'O'").select("run_id", "part").distinct()
    done = t.items.filter("state = 'F'").select("run_id", "part")
    return links.pending(found, done, ["run_id", "part"])
