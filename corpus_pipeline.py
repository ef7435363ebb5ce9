"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from siteglass.llm import decontamination, mixing, passages, rules, simhash
from siteglass.llm.common import kept, made_since, made_so_far, read, remove
from siteglass.llm.queries import LANGUAGE_WEIGHTS, labelled_languages


_scratch: list[str] = []


def stage(run_stage):
    """A stage's working tables go when the next stage begins: by then its result has been written."""

    @functools.wraps(run_stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _scratch)
        mark = made_so_far()
        out = run_stage(spark, docs, sf_dir)
        _scratch[:] = made_since(mark)
        return out

    return wrapped


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions and the learned decision list keep (operator 5)."""
    judged, _ = rules.judge(docs, read(spark, sf_dir, "labels"), carry=True)
    return judged.where("kept").select("row.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (operator 2); of its repeated rows one."""
    return simhash.without_near_duplicates(docs)


@stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages whose first occurrence is elsewhere (operator 6)."""
    return passages.without_repeats(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised (operator 1)."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rates at which their languages' tokens meet the target weights (operator 7)."""
    return mixing.mixed(docs, labelled_languages(spark, docs, sf_dir), LANGUAGE_WEIGHTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Learned rules, fingerprints and posteriors have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
