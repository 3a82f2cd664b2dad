"""The catalogue: groups by tag, source lists, health and coverage of the corpus, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def groups(source_tags: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """source_tags(source, tag), labels(tag, label), sources(source) -> (tag, label, sources): labelled tags, known sources, no empty group."""
    known = source_tags.join(sources.select("source").distinct(), "source", "left_semi").join(labels, "tag")
    return known.groupBy("tag", "label").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def groups_json(grouped: DataFrame) -> DataFrame:
    """One JSON text per tag."""
    return grouped.select("tag", F.to_json(F.struct("label", "sources")).alias("json"))


def untagged(sources: DataFrame, source_tags: DataFrame) -> DataFrame:
    return sources.select("source").distinct().join(source_tags.select("source"), "source", "left_anti")


def sources_json(files: DataFrame) -> DataFrame:
    """One row: the sources and their files, those whose name ends in -api apart, hidden ones (_) left out, as JSON."""
    counts = files.where(~F.col("source").startswith("_")).groupBy("source").agg(F.count("*").alias("count"))
    entry = F.struct(F.col("source").alias("name"), F.col("count"))
    api = F.col("source").endswith("-api")
    both = counts.agg(F.array_sort(F.collect_list(F.when(~api, entry))).alias("docs"), F.array_sort(F.collect_list(F.when(api, entry))).alias("api"))
    return both.select(F.to_json(F.struct("docs", "api")).alias("json"))


def health(files: DataFrame, index: DataFrame) -> DataFrame:
    """One row of totals: markdown and HTML files, sources, sources without markdown, index rows with and without a title."""
    md, html = F.col("path").endswith(".md"), F.col("path").endswith(".html")
    per = files.where(~F.col("source").startswith("_")).groupBy("source").agg(F.count_if(md).alias("md"), F.count_if(html).alias("html"))
    totals = per.agg(F.sum("md").alias("n_md"), F.sum("html").alias("n_html"), F.count("*").alias("n_sources"), F.count_if(F.col("md") == 0).alias("n_empty"))
    indexed = index.agg(F.count("*").alias("n_indexed"), F.count_if(F.col("title") != "").alias("n_titled"), F.count_if(F.col("title") == "").alias("n_untitled"))
    return totals.join(indexed, how="cross")


def coverage(files: DataFrame, index: DataFrame) -> DataFrame:
    """(source, n_md, n_indexed) of each source."""
    md = files.where(F.col("path").endswith(".md")).groupBy("source").agg(F.count("*").alias("n_md"))
    indexed = index.groupBy(F.substring_index("path", "/", 1).alias("source")).agg(F.count("*").alias("n_indexed"))
    return md.join(indexed, "source", "left").select("source", "n_md", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))


def latest_versions(specs: DataFrame) -> DataFrame:
    """specs(service, version, path), version null for files right below the service -> the spec of each service's last version."""
    # of each version the first path, then of each service the last version: both are aggregates that tasks begin
    row = F.struct(*specs.columns)
    per = specs.groupBy("service", "version").agg(F.min_by(row, "path").alias("row"))
    last = per.groupBy("service").agg(F.max_by("row", F.struct(F.col("version").isNotNull(), "version")).alias("row"))
    return last.select("row.*")


def of_roots(roots: dict[str, DataFrame]) -> DataFrame:
    """The files (source, path, content, root) of several roots; of a path that several have, the last root's file counts."""
    frames = [df.select("source", "path", "content", F.lit(name).alias("root"), F.lit(k).alias("__k")) for k, (name, df) in enumerate(roots.items())]
    rows = frames[0]
    for df in frames[1:]:
        rows = rows.unionByName(df)
    if len(frames) == 1:
        return rows.drop("__k")
    # texts are shuffled only for paths that are in several roots
    shared = rows.groupBy("source", "path").agg(F.max("__k").alias("__last"), F.count_distinct("__k").alias("__n")).where("__n > 1")
    met = rows.join(shared.drop("__n"), ["source", "path"], "left")
    return met.where(F.col("__last").isNull() | (F.col("__k") == F.col("__last"))).drop("__k", "__last")


#: Least bytes of a usable page, and the part of the rendered page that a plain fetch has to give.
USABLE, PLAIN_SHARE = 500, 0.7


def audit_class(plain_bytes: Column, js_bytes: Column, refused: Column, skipped: Column | None = None, error: Column | None = None) -> Column:
    """What to do with a scraped source, by what a plain and a rendered fetch yield. Sources that aren't scraped are skipped; an error is its own class."""
    plain_ok, js_ok = ~refused & (plain_bytes >= USABLE), js_bytes >= USABLE
    advice = F.when(plain_ok & (plain_bytes >= js_bytes * PLAIN_SHARE), "KEEP").when(plain_ok | js_ok, "JS").otherwise("DROP")
    advice = advice if error is None else F.when(error.isNotNull(), "ERROR").otherwise(advice)
    return advice if skipped is None else F.when(F.coalesce(skipped, F.lit(False)), "SKIP").otherwise(advice)


def probe_advice(kind: Column, discovery: Column, llms_full: Column, archive: Column, repo: Column, llms_txt: Column) -> Column:
    """The best way to get a source, in order of preference; nulls are what isn't offered."""
    keep = F.when(kind == "git", "GIT").when(discovery.isin("tarball", "llms-full"), F.upper(discovery))
    return F.coalesce(keep, F.when(llms_full.isNotNull(), "LLMS-FULL"), F.when(archive.isNotNull(), "ARCHIVE"), F.when(repo.isNotNull(), "GIT"), F.when(llms_txt.isNotNull(), "LLMS-TXT"), F.lit("KEEP-AS-IS"))


def shards(source: str, names: DataFrame, url: str) -> DataFrame:
    """names(name, part) -> catalogue rows of a source that is divided by service."""
    return names.select(F.concat(F.lit(source + "-"), "name").alias("name"), F.lit("http").alias("type"), F.lit("llms-txt").alias("discovery"), F.concat(F.lit(url.rstrip("/") + "/"), "part").alias("url"))


def invalid_sources(sources: DataFrame) -> DataFrame:
    """Catalogue rows that break its rules, with the reasons."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    taken = sources.groupBy("name").count().where("count > 1").select(F.col("name").alias("__name"), F.lit(True).alias("__taken"))
    sources = sources.join(taken, F.col("name").eqNullSafe(F.col("__name")), "left")
    again = F.coalesce("__taken", F.lit(False))
    found = F.array_compact(F.array(F.when(blank("name"), "blank name"), F.when(blank("url"), "blank url"), F.when(again, "name is taken"), F.when(~F.col("type").isin("git", "http"), "unknown type")))
    return sources.select("name", found.alias("problems")).where(F.size("problems") > 0)


#: The catalogue: how each source is found, what is taken of it, and its tags.
CATALOGUE = "name string, type string, format string, url string, paths array<string>, urls array<string>, root_path string, discovery string, discovery_url string, url_pattern string, url_exclude string, url_suffix string, tags array<string>, description string"


def load_sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue written as JSON (a list, or an object on each line) -> (its valid sources, those with problems: name, problems).

    Missing lists are empty, a missing type is `http`, one of discovery `none` where there are no URLs of its own. Entries that are no objects have no name and are told as such.
    """
    raw = spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    none = F.array().cast("array<string>")
    rows = raw.withColumns({c: F.coalesce(c, none) for c in ("paths", "urls", "tags")} | {"type": F.coalesce("type", F.lit("http"))})
    rows = rows.withColumn("discovery", F.coalesce("discovery", F.when(F.size("urls") == 0, "none")))
    problems = invalid_sources(rows)
    return rows.join(problems.select(F.col("name").alias("__bad")).distinct(), F.col("name").eqNullSafe(F.col("__bad")), "left_anti"), problems


def invalid_files(files: DataFrame) -> DataFrame:
    """Files whose path is blank or begins with a slash."""
    return files.where((F.trim(F.coalesce("path", F.lit(""))) == "") | F.col("path").startswith("/"))
