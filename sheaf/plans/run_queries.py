"""Queries of runs: acquisition, published snapshots, the incremental index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import chains, publish, snapshot
from sheaf.plans.corpus import CONTENT, FILES, PATH, files, plain_files, table
from sheaf.plans.index_queries import INDEX, PLAIN
from sheaf.sources.workspace import shared_path
from sheaf.streaming import acquire

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- acquisition: four responses to each page, of which status and Retry-After depend on the id
RESPONSES = """SELECT regexp_extract(url, '://([^/]*)', 1) AS source, url || '#' || page_id AS url, html AS body, k, 1700000000 + page_id % 1000 + 40 * k AS seen,
 CASE (page_id * 7 + k * 5) % 9 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 204 WHEN 7 THEN 301 WHEN 8 THEN 413 END AS status,
 CASE (page_id + k) % 5 WHEN 1 THEN '7' WHEN 2 THEN '9999' WHEN 3 THEN 'Tue, 14 Nov 2023 22:20:00 GMT' WHEN 4 THEN 'soon' END AS retry_after FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)"""
OUTCOMES = f"""SELECT source, url, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN again THEN 'retry' ELSE 'failed' END AS event, CAST(k + 1 AS INTEGER) AS attempts, status, CASE WHEN status BETWEEN 200 AND 299 THEN length(body) END AS n_body,
 CASE WHEN again THEN CASE WHEN retry_after = '7' THEN 7000 WHEN retry_after = '9999' THEN 300000 WHEN retry_after LIKE '%GMT' THEN greatest(0, least(300000, (1700000400 - seen) * 1000)) ELSE 1000 * 2 ** k END + seen * 1000 END AS due_ms
 FROM (SELECT *, min(CASE WHEN NOT again THEN k END) OVER (PARTITION BY source, url) AS done FROM (SELECT *, (status IS NULL OR status >= 500 OR status IN (413, 429)) AND k < 2 AS again FROM ({RESPONSES}))) WHERE k = done"""
POLICY = acquire.Policy(jitter=0.0)


def outcomes(spark, sf_dir):
    i, k = F.col("page_id"), F.col("k")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    status = F.get(F.array(*[F.lit(x) for x in (200, 503, 404, 429, None, 500, 204, 301, 413)]), ((i * 7 + k * 5) % 9).cast("int"))
    after = F.get(F.array(*[F.lit(x) for x in (None, "7", "9999", "Tue, 14 Nov 2023 22:20:00 GMT", "soon")]), ((i + k) % 5).cast("int"))
    rows = pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("source"), F.concat("url", F.lit("#"), i.cast("string")).alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + i % 1000 + k * 40).alias("at"), status.alias("status"), after.alias("retry_after"), F.col("html").alias("body"))
    return acquire.outcomes(rows, POLICY)


@query(OUTCOMES.replace("1000 * 2 ** k", "CAST(1000 * 2 ** k AS BIGINT)"))
def acquisition(spark, sf_dir):
    return outcomes(spark, sf_dir).select("source", "url", "event", "attempts", "status", F.length("body").alias("n_body"), F.unix_millis("due").alias("due_ms"))


@query(f"""SELECT source, count(*) FILTER (event = 'delivered') AS delivered, count(*) FILTER (event = 'failed') AS failed, count(*) FILTER (event = 'retry') AS open,
 CASE WHEN count(*) FILTER (event = 'delivered') = 0 AND count(*) FILTER (event = 'retry') = 0 AND count(*) FILTER (event = 'failed') > 0 THEN 'all fetches failed. First error: ' || coalesce('HTTP ' || nullif(arg_min(coalesce(CAST(status AS VARCHAR), ''), url) FILTER (event = 'failed'), ''), 'no answer') || ' for ' || (min(url) FILTER (event = 'failed')) END AS error
 FROM (SELECT source || CASE WHEN ends_with(url, '7') THEN '/7' ELSE '' END AS source, url, event, status FROM ({OUTCOMES}) WHERE NOT ends_with(url, '7') OR event = 'failed') GROUP BY source""")
def acquisition_sources(spark, sf_dir):
    """Sources whose pages have all failed are those of the URLs that end in 7, by name."""
    seven = F.col("url").endswith("7")
    rows = outcomes(spark, sf_dir).where(~seven | (F.col("event") == "failed"))
    return acquire.by_source(rows.withColumn("source", F.concat("source", F.when(seven, "/7").otherwise(""))))


# --- published snapshots: a run after another one, with sources that lose too much
RUN = f"SELECT source, path, CASE WHEN ord % 10 = 1 THEN content || '!' ELSE content END AS content FROM ({PLAIN}) WHERE ord % 10 <> 2 AND (NOT source LIKE '%3' OR ord % 3 = 0) AND NOT source LIKE '%4'"


def published(spark, sf_dir):
    """(store, report of the second run): sources named ...3 lose two thirds of their files, those named ...4 aren't in the run."""
    store = publish.Snapshots(spark, shared_path(spark, "snapshots"))
    rows, o = plain_files(spark, sf_dir), F.col("ord")
    remote = rows.select("source", F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("head_sha")).distinct()
    clock = F.timestamp_seconds(F.lit(1_700_000_000))
    store.update(rows, remote, clock)
    run = rows.where((o % 10 != 2) & (~F.col("source").endswith("3") | (o % 3 == 0)) & ~F.col("source").endswith("4"))
    run = run.withColumn("content", F.when(o % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return store, store.update(run, remote, clock)


@query(f"""WITH b AS (SELECT source, path, content FROM ({PLAIN})), r AS ({RUN}), c AS (SELECT coalesce(r.source, b.source) AS source, CASE WHEN b.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' WHEN r.content = b.content THEN 'unchanged' ELSE 'modified' END AS change
 FROM r FULL JOIN b ON r.source = b.source AND r.path = b.path), d AS (SELECT source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM c GROUP BY source),
 n AS (SELECT source, count(*) AS n, (SELECT count(*) FROM r WHERE r.source = b.source) AS now FROM b GROUP BY source)
 SELECT n.source, CASE WHEN now * 2 < n THEN 'error' ELSE 'ok' END AS status, CASE WHEN now * 2 < n THEN 0 ELSE added END AS added, CASE WHEN now * 2 < n THEN 0 ELSE modified END AS modified, CASE WHEN now * 2 < n THEN 0 ELSE removed END AS removed,
 CASE WHEN now * 2 < n THEN 0 ELSE unchanged END AS unchanged, '2' AS version, CASE WHEN now * 2 < n THEN 'regression: ' || now || ' files after ' || n END AS error FROM n JOIN d ON n.source = d.source WHERE now > 0""")
def publish_report(spark, sf_dir):
    return published(spark, sf_dir)[1]


@query(f"""WITH b AS (SELECT source, path, content FROM ({PLAIN})), r AS ({RUN}), n AS (SELECT source, count(*) AS n, (SELECT count(*) FROM r WHERE r.source = b.source) AS now FROM b GROUP BY source), t AS (SELECT source FROM n WHERE now > 0 AND now * 2 >= n),
 s AS (SELECT * FROM r WHERE source IN (FROM t) UNION ALL SELECT * FROM b WHERE source NOT IN (FROM t)) SELECT source, path, md5(content) AS digest FROM s""")
def published_files(spark, sf_dir):
    store, _ = published(spark, sf_dir)
    return store.files().select("source", "path", F.md5(F.col("content").cast("binary")).alias("digest"))


# --- the index after changes: of every tenth file the heading is new, every tenth other one is gone
CHANGED = FILES.replace("FROM documents", "FROM documents WHERE doc_id % 10 <> 2").replace(", text, ", ", CASE WHEN doc_id % 10 = 1 THEN 'Entirely new words' || chr(10) ELSE '' END, text, ")


@query(f"WITH {INDEX.replace(FILES, CHANGED)} SELECT path, title, summary FROM i")
def index_incremental(spark, sf_dir):
    store = publish.IndexStore(spark, shared_path(spark, "index"))
    before = files(spark, sf_dir)
    store.build(before)
    # the same expression as for all files, with words put before the text
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 <> 2").withColumn("text", F.concat(F.when(F.col("doc_id") % 10 == 1, "Entirely new words\n").otherwise(""), "text"))
    now = docs.select("source", F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"), F.col("doc_id").alias("ord"))
    store.apply(snapshot.compare(now.drop("ord"), before.drop("ord")).select("path", "change"), now)
    return store.rows()


# --- a tree of sitemaps: an index of indexes of sitemaps with the pages of 500 ids each; every index names the first one again, every seventh sitemap failed
@query("""SELECT DISTINCT 's' AS source, url || '#' || page_id AS url FROM pages WHERE page_id // 500 % 7 <> 3""")
def sitemap_tree(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    leaf = F.floor(F.col("page_id") / 500)
    name = lambda kind, n: F.concat(F.lit(f"https://h.example/{kind}-"), n.cast("string"), F.lit(".xml"))
    loc = lambda url: F.concat(F.lit("<loc>"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    joined = lambda c: F.array_join(F.collect_list(c), "")
    leaves = pages.groupBy(leaf.alias("leaf")).agg(joined(loc(F.col("url"))).alias("body")).withColumn("body", F.when(F.col("leaf") % 7 != 3, F.col("body")))
    mids = leaves.groupBy(F.floor(F.col("leaf") / 100).alias("mid")).agg(joined(loc(name("leaf", F.col("leaf")))).alias("body"))
    root = mids.agg(joined(loc(name("mid", F.col("mid")))).alias("body")).withColumn("root", F.lit(0))
    index = lambda df: df.withColumn("body", F.concat(F.lit("<sitemapindex>"), "body", loc(name("root", F.lit(0))), F.lit("</sitemapindex>")))
    levels = [index(root).select(name("root", F.col("root")).alias("url"), "body"), index(mids).select(name("mid", F.col("mid")).alias("url"), "body"), leaves.select(name("leaf", F.col("leaf")).alias("url"), "body")]
    responses = levels[0].unionByName(levels[1]).unionByName(levels[2]).select(F.lit("s").alias("source"), "url", "body")
    return chains.sitemap_tree(responses, levels[0].select(F.lit("s").alias("source"), "url"))
