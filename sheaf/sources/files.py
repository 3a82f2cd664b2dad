"""File sources: directory trees, tarballs, saved responses and snapshots as files(source, path, content, ord)."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import basename, extension, replace

EXTENSIONS = ("md", "mdx")
#: File names that hold no documentation.
SKIPPED_NAMES = ("config.json", "_category_.json", "sidebars.js", "sidebars.json", "docusaurus.config.js", "docusaurus.config.ts", "mkdocs.yml", "book.toml", ".gitignore", ".editorconfig", "LICENSE", "LICENSE.md")


def wanted(files: DataFrame, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """Without metadata files, and only of the given types (None: any)."""
    files = files.where(~basename("path").isin(*SKIPPED_NAMES))
    return files if extensions is None else files.where(extension(basename("path")).isin(*extensions))


def strip_root(files: DataFrame, root: str) -> DataFrame:
    """Paths without the given first directories, where they have them."""
    root = root.strip("/") + "/"
    return files.withColumn("path", F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")))


def scan_directory(spark: SparkSession, directory: str, source: str, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """Every file below a directory, paths relative to it."""
    rows = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(directory)
    root = "/" + directory.split("://")[-1].split(":")[-1].strip("/") + "/"
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), F.lit(r"\A[a-z]+:/*"), F.lit("/")))
    rows = rows.select(F.lit(source).alias("source"), F.substring(path, len(root) + 1, 1 << 30).alias("path"), F.col("value").alias("content"))
    return wanted(rows, extensions)


def untar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["content"]:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                for member in tar:
                    if member.isfile():
                        yield pd.DataFrame({"path": [member.name], "content": [tar.extractfile(member).read().decode("utf-8", "replace")]})


def scan_tarballs(spark: SparkSession, path: str, source: str, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """The files in tar archives, without their first directory; an archive is read by one task."""
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(untar, "path string, content string")
    rows = rows.withColumn("path", replace("path", r"\A(?:\./)?[^/]+/"))
    return wanted(rows.select(F.lit(source).alias("source"), "path", "content"), extensions)


def from_responses(responses: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """responses(source, url, status, body, ord) -> (files, failures(source, url, status)): pages that were delivered, and the others."""
    from sheaf.functions.text import url_to_path

    good = F.col("status").between(200, 299) & F.col("body").isNotNull()
    files = responses.where(good).select("source", url_to_path("url", base_url).alias("path"), F.col("body").alias("content"), "ord")
    return files.groupBy("source", "path").agg(F.max_by("content", "ord").alias("content"), F.max("ord").alias("ord")), responses.where(~F.coalesce(good, F.lit(False))).select("source", "url", "status")


def should_retry(attempt: int, retries: int = 2):
    """Column: whether a response's status asks for another attempt (server errors, 413, 429 or no answer)."""
    status = F.col("status")
    return F.lit(attempt < retries) & (status.isNull() | (status >= 500) | status.isin(413, 429))


def retry_delay(attempt: int, retry_after=None, base_s: float = 1.0, most_s: float = 30.0, cap_s: float = 300.0):
    """Column: seconds to wait, doubling with each attempt; a Retry-After in seconds, or a date, takes its place (0 to cap_s)."""
    backoff = F.lit(min(base_s * 2**attempt, most_s))
    if retry_after is None:
        return backoff
    text = F.col(retry_after)
    date = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(text.try_cast("double"), (F.unix_seconds(date) - F.unix_seconds(F.current_timestamp())).cast("double"))
    return F.when(wait.isNull(), backoff).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap_s), wait)))
