"""Queries of snapshots, state, the catalogue and diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import catalog, index, snapshot
from sheaf.plans.corpus import FILES, files, plain_files, table
from sheaf.plans.index_queries import INDEX, PLAIN

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The snapshot before: without every tenth document; every tenth has another text; the present one lacks some.
BEFORE = f"SELECT source, path, CASE WHEN ord % 10 = 1 THEN content || '!' ELSE content END AS content FROM ({PLAIN}) WHERE ord % 10 <> 0"
NOW = f"SELECT source, path, content FROM ({PLAIN}) WHERE ord % 10 <> 2"
COMPARE = f"""SELECT coalesce(n.source, b.source) AS source, coalesce(n.path, b.path) AS path,
 CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.content = b.content THEN 'unchanged' ELSE 'modified' END AS change
 FROM ({NOW}) n FULL JOIN ({BEFORE}) b ON n.source = b.source AND n.path = b.path"""
DIFF = f"SELECT source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM ({COMPARE}) GROUP BY source"


def now(spark, sf_dir):
    return plain_files(spark, sf_dir).where("ord % 10 <> 2")


def before(spark, sf_dir):
    rows = plain_files(spark, sf_dir).where("ord % 10 <> 0")
    return rows.withColumn("content", F.when(F.col("ord") % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))


@query(COMPARE)
def snapshot_compare(spark, sf_dir):
    return snapshot.compare(now(spark, sf_dir), before(spark, sf_dir))


@query(DIFF)
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(now(spark, sf_dir), before(spark, sf_dir))


@query(f"SELECT source, path FROM ({BEFORE}) WHERE (source, path) NOT IN (SELECT (source, path) FROM ({NOW}))")
def orphans(spark, sf_dir):
    return snapshot.orphans(now(spark, sf_dir), before(spark, sf_dir))


# A state row per source, of which the attributes depend on the number of documents and the name.
STATE = "SELECT source, count(*) AS n, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS k FROM documents GROUP BY source"


def state(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("k", F.regexp_extract("source", "[0-9]+", 0).cast("int"))


@query(f"SELECT source, n AS n_files, CASE WHEN k % 3 <> 2 THEN n * (1 + k % 3 * 2) END AS previous, NOT coalesce(k % 3 <> 2 AND 1.0 / (1 + k % 3 * 2) < 0.5, false) AS ok FROM ({STATE})")
def regression_guard(spark, sf_dir):
    stamps = state(spark, sf_dir).where("k % 3 <> 2").select("source", (F.col("n") * (1 + F.col("k") % 3 * 2)).alias("file_count"))
    return snapshot.regressions(plain_files(spark, sf_dir), stamps)


FRESH = """CASE WHEN k % 7 = 6 THEN 'fetch' WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 OR k % 3 = 1 AND k % 5 <> 0 THEN 'skipped' ELSE 'fetch' END
 ELSE CASE WHEN k % 5 = 0 THEN 'fetch' WHEN k % 3 = 0 THEN 'skipped' WHEN k % 3 = 1 THEN CASE WHEN k % 4 = 1 THEN 'skipped' ELSE 'fetch' END ELSE 'fetch' END END"""


@query(f"SELECT source, {FRESH} AS status FROM ({STATE})")
def freshness(spark, sf_dir):
    rows, k = state(spark, sf_dir), F.col("k")
    sha = F.sha1(F.col("source").cast("binary"))
    git, clock = k % 2 == 0, F.timestamp_seconds(F.lit(1_700_000_000))
    # by k: the full commit, a short one that fits or (k % 5 = 0) doesn't, another one
    own = F.when(k % 3 == 0, sha).when(k % 3 == 1, F.when(k % 5 != 0, F.substring(sha, 1, 9)).otherwise(F.lit("zzzzzzzzz"))).otherwise(F.reverse(sha))
    age = F.when(k % 7 == 6, 90_000).otherwise(60)
    stamps = rows.select("source", F.when(git, "git").otherwise("http").alias("type"), (F.unix_seconds(clock) - age).cast("timestamp").alias("fetched_at"), F.when(k % 3 == 0, "e1").alias("etag"), F.lit("Mon").alias("last_modified"), F.when(git, own).alias("git_sha"))
    remote = rows.select("source", (k % 5 != 0).alias("ok"), F.when(k % 3 == 0, "e1").alias("etag"), F.when(k % 3 == 1, F.when(k % 4 == 1, "Mon").otherwise("Tue")).when(k % 3 == 0, "Tue").alias("last_modified"), sha.alias("head_sha"))
    return snapshot.freshness(stamps, remote, clock)


REPORT = f"""SELECT s.source, CASE WHEN k % 6 = 5 THEN 'error' WHEN {FRESH} = 'skipped' THEN 'skipped' ELSE 'ok' END AS status, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(removed, 0) AS removed,
 coalesce(unchanged, 0) AS unchanged, CAST(k AS VARCHAR) AS version, CASE WHEN k % 6 = 5 THEN 'timed out' END AS error FROM ({STATE}) s LEFT JOIN ({DIFF}) d ON s.source = d.source AND k % 6 <> 5"""


def report(spark, sf_dir):
    states = freshness(spark, sf_dir).join(state(spark, sf_dir), "source")
    failed = F.col("k") % 6 == 5
    states = states.select("source", F.when(failed, "error").when(F.col("status") == "skipped", "skipped").otherwise("ok").alias("status"), F.col("k").cast("string").alias("version"), F.when(failed, "timed out").alias("error"))
    changes = snapshot.diff(now(spark, sf_dir), before(spark, sf_dir)).join(states.where("status <> 'error'").select("source"), "source", "left_semi")
    return snapshot.run_report(states, changes)


@query(REPORT)
def run_report(spark, sf_dir):
    return report(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({REPORT}) GROUP BY status")
def run_summary(spark, sf_dir):
    return snapshot.summary(report(spark, sf_dir))


# --- catalogue ----------------------------------------------------------------------------------------------------------------
TAGS = "SELECT DISTINCT source, CASE WHEN doc_id % 3 = 0 THEN lang WHEN n_chars > 3000 THEN 'long' ELSE 'other' END AS tag FROM documents WHERE source <> 'src13'"


def tags(spark, sf_dir):
    tag = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("n_chars") > 3000, "long").otherwise("other")
    return table(spark, sf_dir, "documents").where("source <> 'src13'").select("source", tag.alias("tag")).distinct()


def labels(spark):
    return spark.createDataFrame([("en", "English"), ("fr", "French"), ("long", "Long texts"), ("none", "Unused")], "tag string, label string")


GROUPS = f"SELECT tag, label, list(source ORDER BY source) AS sources FROM ({TAGS}) JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('long', 'Long texts'), ('none', 'Unused')) l(tag, label) USING (tag) WHERE source <> 'src0' GROUP BY tag, label"


def grouped(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").where("source <> 'src0'").select("source")
    return catalog.groups(tags(spark, sf_dir), labels(spark), sources)


@query(f"SELECT tag, label, array_to_string(sources, ',') AS sources FROM ({GROUPS})")
def source_groups(spark, sf_dir):
    return grouped(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


@query(f"""SELECT tag, '{{"label":"' || label || '","sources":["' || array_to_string(sources, '","') || '"]}}' AS json FROM ({GROUPS})""")
def source_groups_json(spark, sf_dir):
    return catalog.groups_json(grouped(spark, sf_dir))


@query(f"SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM ({TAGS}))")
def untagged(spark, sf_dir):
    return catalog.untagged(table(spark, sf_dir, "documents"), tags(spark, sf_dir))


NAMED = "SELECT CASE WHEN source = 'src1' THEN '_hidden' WHEN source IN ('src4', 'src5') THEN source || '-api' ELSE source END AS source, path, content FROM "


def named(rows):
    name = F.when(F.col("source") == "src1", "_hidden").when(F.col("source").isin("src4", "src5"), F.concat("source", F.lit("-api"))).otherwise(F.col("source"))
    return rows.withColumn("source", name)


@query(f"""WITH c AS (SELECT source, count(*) AS n, ends_with(source, '-api') AS api FROM ({NAMED} ({PLAIN})) WHERE NOT starts_with(source, '_') GROUP BY source),
j AS (SELECT api, string_agg('{{"name":"' || source || '","count":' || n || '}}', ',' ORDER BY source) AS l FROM c GROUP BY api)
SELECT '{{"docs":[' || coalesce((SELECT l FROM j WHERE NOT api), '') || '],"api":[' || coalesce((SELECT l FROM j WHERE api), '') || ']}}' AS json""")
def sources_json(spark, sf_dir):
    return catalog.sources_json(named(plain_files(spark, sf_dir)))


@query(f"""WITH {INDEX}, n AS ({NAMED} f), per AS (SELECT source, count(*) FILTER (path LIKE '%.md') AS md, count(*) FILTER (path LIKE '%.html') AS html FROM n WHERE NOT starts_with(source, '_') GROUP BY source)
SELECT (SELECT CAST(sum(md) AS BIGINT) FROM per) AS n_md, (SELECT CAST(sum(html) AS BIGINT) FROM per) AS n_html, (SELECT count(*) FROM per) AS n_sources, (SELECT count(*) FROM per WHERE md = 0) AS n_empty, count(*) AS n_indexed,
 count(*) FILTER (title <> '') AS n_titled, count(*) FILTER (title = '') AS n_untitled FROM i""")
def health(spark, sf_dir):
    rows = files(spark, sf_dir)
    return catalog.health(named(rows), index.build_index(rows))


@query(f"WITH {INDEX}, m AS (SELECT source, count(*) AS n_md FROM f WHERE path LIKE '%.md' GROUP BY source), x AS (SELECT split_part(path, '/', 1) AS source, count(*) AS n FROM i GROUP BY 1) SELECT source, n_md, coalesce(n, 0) AS n_indexed FROM m LEFT JOIN x USING (source)")
def index_coverage(spark, sf_dir):
    rows = files(spark, sf_dir)
    return catalog.coverage(rows, index.build_index(rows))


@query("""WITH s AS (SELECT source AS service, CASE WHEN doc_id % 5 <> 0 THEN '2024-0' || (doc_id % 7 + 1) END AS version, source || '/' || doc_id || '.json' AS path FROM documents)
SELECT service, version, path FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY version DESC NULLS LAST, path) AS k FROM s) WHERE k = 1""")
def latest_version(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    version = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("2024-0"), (F.col("doc_id") % 7 + 1).cast("string")))
    return catalog.latest_versions(table(spark, sf_dir, "documents").select(F.col("source").alias("service"), version.alias("version"), F.concat("source", F.lit("/"), i, F.lit(".json")).alias("path")))


@query("""SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'SKIP' WHEN page_id % 7 = 0 THEN 'ERROR' WHEN page_id % 9 <> 0 AND plain >= 500 AND plain >= js * 0.7 THEN 'KEEP' WHEN page_id % 9 <> 0 AND plain >= 500 OR js >= 500 THEN 'JS' ELSE 'DROP' END AS advice
FROM (SELECT page_id, length(html) // (1 + page_id % 13) AS plain, length(html) // (1 + page_id % 11) AS js FROM pages)""")
def source_audit(spark, sf_dir):
    n, k = F.length("html"), F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", catalog.audit_class(F.floor(n / (1 + k % 13)), F.floor(n / (1 + k % 11)), k % 9 == 0, k % 8 == 0, F.when(k % 7 == 0, "timed out")).alias("advice"))


@query("""SELECT source, CASE WHEN k % 5 = 0 THEN 'GIT' WHEN k % 5 = 1 THEN 'TARBALL' WHEN k % 4 = 0 THEN 'LLMS-FULL' WHEN k % 4 = 1 THEN 'ARCHIVE' WHEN k % 3 = 0 THEN 'GIT' WHEN k % 2 = 0 THEN 'LLMS-TXT' ELSE 'KEEP-AS-IS' END AS advice FROM (""" + STATE + ")")
def source_probe(spark, sf_dir):
    k = F.col("k")
    some = lambda ok: F.when(ok, 1)
    advice = catalog.probe_advice(F.when(k % 5 == 0, "git").otherwise("http"), F.when(k % 5 == 1, "tarball").otherwise("toc"), some(k % 4 == 0), some(k % 4 == 1), some(k % 3 == 0), some(k % 2 == 0))
    return state(spark, sf_dir).select("source", advice.alias("advice"))


@query(f"SELECT 'cloud-' || lang AS name, 'http' AS type, 'llms-txt' AS discovery, 'https://h.example/' || lang || '/docs' AS url FROM (SELECT DISTINCT lang FROM documents)")
def shard_expansion(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.concat("lang", F.lit("/docs")).alias("part")).distinct()
    return catalog.shards("cloud", names, "https://h.example/")


@query("""WITH s AS (SELECT CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE 'n' || (doc_id - doc_id % 7 % 2) END AS name, CASE WHEN doc_id % 30 = 0 THEN '' ELSE 'https://h' END AS url, CASE WHEN doc_id % 20 = 0 THEN 'ftp' ELSE 'http' END AS type FROM documents),
p AS (SELECT name, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'blank name' END, CASE WHEN trim(url) = '' THEN 'blank url' END, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'name is taken' END, CASE WHEN type NOT IN ('git', 'http') THEN 'unknown type' END], lambda x: x IS NOT NULL), ';') AS problems FROM s)
SELECT name, problems FROM p WHERE problems <> ''""")
def catalogue_check(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(i % 50 == 0, " ").otherwise(F.concat(F.lit("n"), (i - i % 7 % 2).cast("string"))).alias("name"), F.when(i % 30 == 0, "").otherwise("https://h").alias("url"), F.when(i % 20 == 0, "ftp").otherwise("http").alias("type"))
    return catalog.invalid_sources(rows).withColumn("problems", F.array_join("problems", ";"))


@query("""SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS n_clients, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type""")
def audit_summary(spark, sf_dir):
    from sheaf.streaming.audit import summarise

    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("client"))
    return summarise(rows)


# --- services and stamps
VERSIONED = "SELECT source AS service, CASE WHEN doc_id % 5 <> 0 THEN '2024-0' || (doc_id % 7 + 1) END AS version FROM documents"


def versioned(spark, sf_dir):
    """Specifications of two roots, put together."""
    version = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("2024-0"), (F.col("doc_id") % 7 + 1).cast("string")))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("service"), version.alias("version"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "no spec").otherwise('{"paths": {}}').alias("raw"), "doc_id")
    return rows.where("doc_id % 2 = 0").unionByName(rows.where("doc_id % 2 = 1")).drop("doc_id")


@query(f"SELECT count(DISTINCT service) AS n_services, count(*) AS n_specs FROM ({VERSIONED}) WHERE regexp_matches(service, '[1-5]$')")
def services_filtered(spark, sf_dir):
    from sheaf.operators import openapi

    return openapi.services(openapi.of_services(versioned(spark, sf_dir), "[1-5]$"))


@query("""WITH s AS (SELECT source AS service, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 5 <> 0 THEN '2024-0' || (doc_id % 7 + 1) END DESC NULLS LAST, source || '/' || doc_id) AS k FROM documents WHERE regexp_matches(source, '[1-5]$'))
SELECT service, doc_id % 3 <> 0 AS ok, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN (SELECT max(doc_id % 3 <> 0) FROM s WHERE k = 1) THEN 'unreadable specification' ELSE 'all failed' END END AS error FROM s WHERE k = 1""")
def services_report(spark, sf_dir):
    from sheaf.operators import openapi

    return openapi.converted(versioned(spark, sf_dir), "[1-5]$")[1]


@query(f"""SELECT source, CASE WHEN k % 6 <> 5 AND {FRESH} = 'fetch' THEN n ELSE 1 END AS file_count FROM ({STATE}) WHERE k % 4 <> 3 OR k % 6 <> 5 AND {FRESH} = 'fetch'""")
def stamps_merged(spark, sf_dir):
    """Stamps after a run: new ones for what was fetched well, the ones before for what was skipped or failed."""
    clock = F.timestamp_seconds(F.lit(1_700_000_000))
    rows = state(spark, sf_dir)
    none = F.lit(None).cast("string")
    before = rows.where("k % 4 <> 3").select("source", clock.alias("fetched_at"), none.alias("etag"), none.alias("last_modified"), none.alias("git_sha"), F.lit(1).cast("long").alias("file_count"))
    remote = rows.select("source", none.alias("etag"), none.alias("last_modified"), none.alias("head_sha"))
    found = snapshot.merged_stamps(before, snapshot.stamp(plain_files(spark, sf_dir), remote, clock), report(spark, sf_dir))
    return found.select("source", "file_count")
