"""Site-relative line deduplication, in DataFrame functions alone.

Lines are what block tags of a page's HTML delimit. For each host, the pages that contain a line are divided by the host's
pages; lines above RATIO that are on LEAST_PAGES pages at least are boilerplate of that site and dropped from its pages.

Scale: the lines are extracted once and written; only (host, 16-byte line digest) goes through the counting shuffle, once per page and line. Boilerplate
lines are few: a host has at most (mean distinct lines of its pages) / RATIO of them, whatever its size. The lists of all hosts meet the pages by
broadcast where their measured size is at most MOST_MARKED digests; then no line is shuffled. Beyond that, only pages of hosts with
boilerplate are shuffled, those of one host dealt over as many parts as its pages call for (PAGES for each).

Defined cases: null html has no lines; pages whose url has no host (null urls too) keep all their lines; a line that repeats within a
page counts once there; repeated page rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import cut, read, stored

RATIO, LEAST_PAGES = 0.3, 3
#: Digests that are broadcast (16 bytes each); pages of a host that meet its list in one part, where lists are shuffled.
MOST_MARKED, PAGES = 1 << 20, 2000
#: Elements that stand on lines of their own.
BLOCKS = "address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
TAG = r"<[^>]*>"
EDGE = r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+\z"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def lines_of(html: Column) -> Column:
    """The trimmed lines of an HTML text that aren't empty."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n"), BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def digest_of(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """pages(host, lines) -> (host, marks, pages): the digests of each host's boilerplate lines, and its number of pages."""
    known = pages.where("host IS NOT NULL")
    totals = known.groupBy("host").agg(F.count("*").alias("pages"))
    seen = known.select("host", F.explode(F.array_distinct(F.transform("lines", digest_of))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    marked = counts.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return marked.groupBy("host").agg(F.collect_list("line").alias("marks"), F.first("pages").alias("pages"))


def line_dedup(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, most_marked: int = MOST_MARKED) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, n_lines, n_dropped, kept (array of lines)."""
    rows = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    marks = cut(boilerplate(rows, ratio, least))
    n_marks, largest = marks.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0)), F.coalesce(F.max("pages"), F.lit(0))).first()
    marks = marks.select("host", "marks")
    if n_marks <= most_marked:
        met = rows.join(F.broadcast(marks), "host", "left")
    else:
        salts = 1 + largest // PAGES
        some = rows.join(marks.select("host"), "host", "left_semi").withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(salts)).cast("int"))
        dealt = some.join(marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"]).drop("salt")
        others = rows.join(marks.select("host"), "host", "left_anti").withColumn("marks", F.lit(None).cast("array<binary>"))
        met = dealt.unionByName(others)
    # a page's own boilerplate lines, then a look into these few for each line
    met = met.withColumn("found", F.array_intersect(F.transform("lines", digest_of), "marks"))
    kept = F.when(F.size("found") > 0, F.filter("lines", lambda x: ~F.array_contains("found", digest_of(x)))).otherwise(F.col("lines"))
    met = met.select("page_id", "host", "lines", kept.alias("kept"))
    return met.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), "kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, row_number() OVER () AS r,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', '{{nl}}', 'g'), '{BLOCK}', '{{nl}}', 'g'), '{TAG}', '', 'g'), '{{nl}}'),
      lambda x: regexp_replace(x, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT c.host, line FROM (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line) c
      JOIN t ON c.host = t.host WHERE n >= {LEAST_PAGES} AND n / pages > {RATIO}),
k AS (SELECT host, list(line) AS marks FROM m GROUP BY host)
SELECT page_id, p.host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_filter(lines, lambda x: NOT coalesce(list_contains(marks, x), false))) AS BIGINT) AS n_dropped,
    sha256(array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(marks, x), false)), '{{nl}}')) AS kept_sha256
FROM p LEFT JOIN k ON p.host = k.host
""".replace("{nl}", "\n")
