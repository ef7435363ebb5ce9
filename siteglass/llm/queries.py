"""Registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, gam, mixing, passages, recipes, rules, runs, simhash, tokens, toxicity, warc, whitening
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]):
    QUERIES[plan.__name__] = plan
    return plan


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(read(spark, folder, "documents"), tokenizer_path())


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))[0]


@query
def op3_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return gam.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"), fold("doc_id", 3) == 1)


@query
def op4_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"), fold("doc_id", 5) == 0)


@query
def op1_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(read(spark, folder, "documents"))


#: Shares of the languages in the mixture.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def labelled_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the labels table covers, with their language as domain.

    Labels grow with the documents, so they are never broadcast: a small table takes the same plan as a large one.
    """
    labelled = read(spark, folder, "labels").select("doc_id").distinct().hint("merge")
    return docs.join(labelled, "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


@query
def op7_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return mixing.mixed(docs, labelled_languages(spark, docs, folder), LANGUAGE_WEIGHTS, ["doc_id"])


@query
def op8_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages"))


@query
def op9_chat_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return chat.recover(read(spark, folder, "conversations"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: of each tenth document by hash, the words from one on are replaced by repeats of the first of them. A null id replaces none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    placed = listed.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_periods(read(spark, folder, "documents")))
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(longest, F.lit(0)).alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return best.select(
        "doc_id", "n_runs", "best.start", (-F.col("best.size")).alias("length"), "best.period",
        F.floor(-1000 * F.col("best.size") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return recipes.exact_duplicates(read(spark, folder, "documents"))


ORACLE_SQL["op13_chunk_recipes"] = """WITH t AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256 FROM t WINDOW w AS (PARTITION BY low)"""
