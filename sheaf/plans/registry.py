"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.operators import index, retrieve
from sheaf.plans import document_queries, index_queries, run_queries, state_queries
from sheaf.plans.corpus import files

MODULES = (index_queries, document_queries, state_queries, run_queries)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the search index over all documents and search it."""
    return retrieve.search_index(index.build_index(files(spark, sf_dir)), "about (en|fr)")
