"""Which given table plays which role, as DataFrames and as matching SQL for the checks.

organisation = region, project = nation, page = customer, user = supplier, run = orders,
item of a run = lineitem, score and snapshot = events (page user_id), stored page = pages,
text = documents, chat = conversations, vector = embeddings, label = labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import CRITERIA
from ..sources.pages import read_pages


class Tables:
    """Given tables of one folder, read on demand with only the columns a plan uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def stored_pages(self) -> DataFrame:
        """Markup is split over all cores: a page table is few bytes on disk and much work per byte."""
        return spread(read_pages(self.spark, f"{self.folder}/pages.parquet"), "page_id")

    @property
    def texts(self) -> DataFrame:
        return spread(self.raw("documents").select("doc_id", "text"), "doc_id")

    @property
    def organizations(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("organization_id"), F.col("r_name").alias("name"))

    @property
    def projects(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").alias("organization_id"), F.col("n_name").alias("name")
        )

    @property
    def pages(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("title"),
            F.concat(F.lit("https://site"), F.col("c_nationkey"), F.lit(".example.com/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey")).alias("url"),
            F.lower("c_mktsegment").alias("page_type"),
        )

    @property
    def users(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"),
            F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.when(F.col("s_suppkey") % 7 == 0, F.lit("@")).otherwise(F.lit("@example.com"))).alias("email"),
            F.when(F.col("s_acctbal") > 1000, F.lit(True)).otherwise(F.lit(False)).alias("approved"),
        )

    @property
    def members(self) -> DataFrame:
        role = F.element_at(F.array(F.lit("admin"), F.lit("editor"), F.lit("viewer")), (F.col("s_suppkey") % 3 + 1).cast("int"))
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("user_id"), (F.col("s_nationkey") % 5).alias("organization_id"), role.alias("role")
        )

    @property
    def runs(self) -> DataFrame:
        status = (
            F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "queued").when(F.col("o_orderstatus") == "O", "running")
            .when(F.col("o_orderstatus") == "P", "paused").when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("completed")
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("page_id"), status.alias("status"),
            F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("duration_ms"),
            (F.col("o_orderkey") % 40).cast("int").alias("pages_discovered"), (F.col("o_custkey") % 40).cast("int").alias("pages_processed"),
        )

    @property
    def items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("int").alias("tokens"),
            F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
            F.col("l_extendedprice").alias("amount"),
        )

    @property
    def scores(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("score_id"), F.col("user_id").alias("page_id"), F.col("event_type").alias("page_type"),
            F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("value") + 0.5))).cast("int").alias("overall_score"),
            F.col("ts").alias("scored_at"), F.dayofyear("ts").alias("run_id"), F.floor("value").cast("int").alias("tokens"),
        )

    @property
    def snapshots(self) -> DataFrame:
        code = (
            F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "click", 301).otherwise(200)
        )
        return self.raw("events").select(
            F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("page_id"), F.dayofyear("ts").alias("run_id"),
            F.sha2("event_type", 256).alias("content_hash"), F.col("ts").alias("snapshot_at"), code.alias("status_code"),
        )

    @property
    def criteria_scores(self) -> DataFrame:
        """Scores with a full criteria map derived from the event."""
        made = F.map_from_arrays(
            F.array(*[F.lit(c) for c in CRITERIA]),
            F.array(*[((F.col("event_id") * (7 * i + 3) + F.floor("value") * (i + 1)) % 101).cast("int") for i in range(len(CRITERIA))]),
        )
        return self.raw("events").select(
            F.col("event_id").alias("score_id"), F.col("user_id").alias("page_id"), F.col("ts").alias("scored_at"), made.alias("criteria_scores")
        )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Texts dealt out by key over ``spark.sql.shuffle.partitions`` tasks: markup is few bytes on disk and much work per byte,
    and neither the size of the files nor that of the table changes the plan."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- the same roles in SQL --------------------------------------------------------------
SQL = {
    "organizations": "organizations AS (SELECT r_regionkey AS organization_id, r_name AS name FROM region)",
    "projects": "projects AS (SELECT n_nationkey AS project_id, n_regionkey AS organization_id, n_name AS name FROM nation)",
    "site_pages": (
        "site_pages AS (SELECT c_custkey AS page_id, c_nationkey AS project_id, c_name AS title, "
        "'https://site' || c_nationkey || '.example.com/' || lower(c_mktsegment) || '/' || c_custkey AS url, "
        "lower(c_mktsegment) AS page_type FROM customer)"
    ),
    "users": (
        "users AS (SELECT s_suppkey AS user_id, s_name AS name, lower(replace(s_name, '#', '.')) || "
        "CASE WHEN s_suppkey % 7 = 0 THEN '@' ELSE '@example.com' END AS email, s_acctbal > 1000 AS approved FROM supplier)"
    ),
    "members": (
        "members AS (SELECT s_suppkey AS user_id, s_nationkey % 5 AS organization_id, "
        "CASE s_suppkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'viewer' END AS role FROM supplier)"
    ),
    "runs": (
        "runs AS (SELECT o_orderkey AS run_id, o_custkey AS page_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'queued' "
        "WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'P' THEN 'paused' WHEN o_orderkey % 5 = 0 THEN 'failed' "
        "ELSE 'completed' END AS status, o_orderdate AS created_at, o_totalprice AS duration_ms, "
        "CAST(o_orderkey % 40 AS INT) AS pages_discovered, CAST(o_custkey % 40 AS INT) AS pages_processed FROM orders)"
    ),
    "items": (
        "items AS (SELECT l_orderkey AS run_id, l_linenumber AS pos, CAST(l_quantity AS INT) AS tokens, l_partkey AS part, l_suppkey AS supp, "
        "l_returnflag AS flag, l_linestatus AS state, l_extendedprice AS amount FROM lineitem)"
    ),
    "scores": (
        "scores AS (SELECT event_id AS score_id, user_id AS page_id, event_type AS page_type, "
        "CAST(least(100, greatest(0, floor(value + 0.5))) AS INT) AS overall_score, ts AS scored_at, dayofyear(ts) AS run_id, "
        "CAST(floor(value) AS INT) AS tokens FROM events)"
    ),
    "snapshots": (
        "snapshots AS (SELECT event_id AS snapshot_id, user_id AS page_id, dayofyear(ts) AS run_id, sha256(event_type) AS content_hash, "
        "ts AS snapshot_at, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 301 ELSE 200 END AS status_code FROM events)"
    ),
    "criteria": (
        "names AS (SELECT unnest([" + ",".join(f"'{c}'" for c in CRITERIA) + f"]) AS criterion, unnest(range({len(CRITERIA)})) AS i), "
        "criteria AS (SELECT event_id AS score_id, user_id AS page_id, ts AS scored_at, criterion, "
        "CAST((event_id * (7 * i + 3) + CAST(floor(value) AS BIGINT) * (i + 1)) % 101 AS INT) AS score FROM events CROSS JOIN names)"
    ),
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
