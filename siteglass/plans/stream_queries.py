"""Registered streaming jobs: each runs a Structured Streaming query over the event table to the
end of the available input and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from ..streaming.sources import append_to_table, fold_to_table, read_events, update_to_table
from .bindings import Tables
from .registry import query

C = F.col


def _events(t: Tables):
    return read_events(t.spark, t.folder)


def _ntz(df):
    return df.withColumn("window_start", C("window_start").cast("timestamp_ntz"))


@query("stream_rate_limit", "J1", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01') AS window_start, user_id % 10 AS client, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def stream_rate_limit(t: Tables):
    requests = _events(t).withColumn("client", C("user_id") % 10)
    return _ntz(update_to_table(jobs.over_rate(requests, 1), "rate", ["window_start", "client"]))


@query("stream_usage", "J5", "SELECT time_bucket(INTERVAL 60 SECOND, ts, TIMESTAMP '2000-01-01') AS window_start, event_type AS endpoint, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def stream_usage(t: Tables):
    requests = _events(t).select("event_time", C("event_type").alias("endpoint"), F.when(C("event_type") == "error", 500).otherwise(200).alias("status_code"))
    return _ntz(update_to_table(jobs.usage(requests), "usage", ["window_start", "endpoint"]))


@query("stream_run_progress", "J3", "SELECT user_id AS run_id, count(*) AS events, count(*) FILTER (event_type IN ('view', 'click')) AS pages_discovered, count(*) FILTER (event_type = 'purchase') AS pages_processed FROM events GROUP BY 1")
def stream_run_progress(t: Tables):
    step = jobs.run_progress("user_id", C("event_type").isin("view", "click"), C("event_type") == "purchase")
    return fold_to_table(_events(t), "progress", step, newest_by=["key"]).withColumnRenamed("key", "run_id")


@query("stream_content_changes", "J2", "SELECT key, event_id FROM (SELECT user_id AS key, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS changed FROM events) WHERE changed")
def stream_content_changes(t: Tables):
    return fold_to_table(_events(t), "changes", jobs.content_changes("user_id", F.sha2("event_type", 256)))


@query("stream_token_budget", "J4", "SELECT key, event_id FROM (SELECT user_id AS key, event_id, COALESCE(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events) WHERE used < 500")
def stream_token_budget(t: Tables):
    return fold_to_table(_events(t), "budget", jobs.within_token_budget("user_id", F.floor("value"), 500))


def _cool_down_sql(seconds: int) -> str:
    return f"""WITH RECURSIVE o AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w(key, event_id, n, allowed, since) AS (SELECT key, event_id, n, true, t FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.event_id, o.n, o.t - w.since >= {seconds * 1000000}, CASE WHEN o.t - w.since >= {seconds * 1000000} THEN o.t ELSE w.since END FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)
 SELECT key, event_id, allowed FROM w"""


@query("stream_cool_down", "J6", _cool_down_sql(36000))
def stream_cool_down(t: Tables):
    # The given events of a key lie hours apart, so the interval is ten hours here; the default is a minute.
    return append_to_table(jobs.cool_down(_events(t), "user_id", 36000), "cool")


@query("stream_robots_cache", "J7", _cool_down_sql(3600))
def stream_robots_cache(t: Tables):
    return append_to_table(jobs.cool_down(_events(t), "user_id", jobs.ROBOTS_TTL_SECONDS), "robots")


_ACTION = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'purchase' THEN 'resume' WHEN 'signup' THEN 'complete' ELSE 'fail' END"


@query("stream_life_cycle", "J8", f"""WITH RECURSIVE o AS (SELECT user_id AS key, event_id, {_ACTION} AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w(key, event_id, n, status, accepted) AS (SELECT key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'queued', true FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.event_id, o.n, CASE WHEN a = 'complete' THEN 'completed' WHEN a = 'fail' THEN 'failed' WHEN a = 'start' AND status = 'queued' THEN 'running' WHEN a = 'pause' AND status IN ('running', 'queued') THEN 'paused'
   WHEN a = 'resume' AND status = 'paused' THEN 'running' ELSE status END, a IN ('complete', 'fail') OR (a = 'start' AND status = 'queued') OR (a = 'pause' AND status IN ('running', 'queued')) OR (a = 'resume' AND status = 'paused')
  FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1) SELECT key, event_id, status, accepted FROM w WHERE n > 0""")
def stream_life_cycle(t: Tables):
    action = (
        F.when(C("event_type") == "click", "start").when(C("event_type") == "view", "pause").when(C("event_type") == "purchase", "resume")
        .when(C("event_type") == "signup", "complete").otherwise("fail")
    )
    return fold_to_table(_events(t), "life", jobs.life_cycle("user_id", action))


@query("stream_first_submissions", "J9", "SELECT DISTINCT user_id || '-' || event_type AS job_id FROM events")
def stream_first_submissions(t: Tables):
    return append_to_table(jobs.first_submissions(_events(t).withColumn("job_id", F.concat_ws("-", "user_id", "event_type"))), "jobs")


@query("stream_attempts", "J9", "SELECT user_id || '-' || event_type AS job_id, count(*) AS attempts, count(*) < 3 AS may_retry FROM events GROUP BY 1")
def stream_attempts(t: Tables):
    jobs_of = _events(t).withColumn("job_id", F.concat_ws("-", "user_id", "event_type"))
    return jobs.may_retry(fold_to_table(jobs_of, "attempts", jobs.attempts("job_id"), newest_by=["key"])).withColumnRenamed("key", "job_id")
