"""The document model over the driver's tables.

Documents become markdown files: their text, with headings, frontmatter, fenced code and control sequences that depend on the id, so that every
rule of the engine meets cases. The expressions are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.trigram import BATCH_BYTES, BATCH_SETTING

FRONTMATTER = """CASE
 WHEN doc_id % 40 = 10 THEN concat('---', chr(10), 'title: Never closed ', CAST(doc_id AS STRING), chr(10))
 WHEN doc_id % 40 = 25 THEN concat('---', chr(10), 'title: Cut ', CAST(doc_id AS STRING), chr(10), '## Early ', lang, chr(10))
 WHEN doc_id % 10 = 0 THEN concat('---', chr(10), 'title: "Doc ', CAST(doc_id AS STRING), '"', chr(10), 'description: >', chr(10), '  Folded note ', CAST(doc_id AS STRING), chr(10), '---', chr(10))
 WHEN doc_id % 10 = 5 THEN concat('---', chr(10), 'title: Doc ', CAST(doc_id AS STRING), chr(10), 'description: About ', source, ' in ', lang, chr(10), '--- ', chr(10))
 ELSE '' END"""
HEADING = "CASE WHEN doc_id % 3 = 0 THEN concat('# Topic ', CAST(doc_id AS STRING), ' about ', lang, chr(10), chr(10)) ELSE '' END"
FENCE = "CASE WHEN doc_id % 7 = 0 THEN concat('```sh', chr(10), '# not a heading', chr(10), 'echo ', CAST(doc_id AS STRING), chr(10), '```', chr(10)) ELSE '' END"
DETAILS = "CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), '## Details ', CAST(doc_id AS STRING), chr(10), 'More on ', source, '.', chr(10)) ELSE '' END"
ESCAPES = "CASE WHEN doc_id % 11 = 0 THEN concat(chr(10), chr(27), '[31mred', chr(27), '[0m', chr(9), 'end', chr(7), chr(10)) ELSE '' END"
CONTENT = f"concat({FRONTMATTER}, {HEADING}, {FENCE}, text, {DETAILS}, {ESCAPES})"
PATH = "concat(source, '/', lang, '/doc-', CAST(doc_id AS STRING), CASE WHEN doc_id % 13 = 0 THEN '.html' ELSE '.md' END)"
FILES = f"SELECT source, {PATH} AS path, {CONTENT} AS content, doc_id AS ord FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of BATCH_BYTES, where the session has Spark's own default of 64 MB. The setting stays, as the plans that queries return run later."""
    if spark.conf.get(BATCH_SETTING).rstrip("bB") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"), F.col("doc_id").alias("ord"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are, one file each."""
    return table(spark, sf_dir, "documents").select("source", F.expr(PATH).alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTML files; the host is the source."""
    from sheaf.functions.text import url_to_path

    host = F.regexp_extract("url", "://([^/]*)", 1)
    base = F.regexp_extract("url", r"\A(https?://[^/]*)", 1)
    return table(spark, sf_dir, "pages").select(host.alias("source"), url_to_path("url", base).alias("path"), F.col("html").alias("content"), F.lit("html").alias("format"), F.col("page_id").alias("ord"))
