"""Stored pages as a batch or a stream; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_pages(spark: SparkSession, folder: str, schema: str = PAGE_SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    """Pages that arrive in a folder. Parsing, features and scores are stateless, so they run on it as they are."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
