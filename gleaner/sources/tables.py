"""Readers for the input tables. Column lists are passed so the Parquet scan only reads what a plan needs
(``ReadSchema`` in the plan); filters applied afterwards are pushed into the scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Fetched documents (O4), ``schemas.CRAWL``: missing columns are NULL, others are not read."""
    return spark.read.schema(S.CRAWL).parquet(path)


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """A page store, ``schemas.FETCHED_PAGES``."""
    return spark.read.schema(S.FETCHED_PAGES).parquet(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """A provenance log, ``schemas.PROVENANCE``."""
    return spark.read.schema(S.PROVENANCE).parquet(path)
