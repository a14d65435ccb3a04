"""All query modules of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.plans import general, ingest, linking, records, retrieval

MODULES = (general, records, linking, retrieval, ingest)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return general.QUERIES["p6_found"](spark, sf_dir)
