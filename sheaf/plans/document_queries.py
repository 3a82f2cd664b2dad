"""Queries of the document transforms, of discovery and of the splitters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.functions import text as X
from sheaf.operators import discover, split
from sheaf.plans.corpus import FILES, bounded_batches, files, page_files, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def g(text: str, pattern: str, by: str = "''") -> str:
    """A global replacement in DuckDB."""
    return f"regexp_replace({text}, '{pattern}', {by}, 'g')"


def chain(text: str, *patterns: str) -> str:
    for p in patterns:
        text = g(text, p)
    return text


TRIM = (r"\A[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+\z",)
# --- HTML ---------------------------------------------------------------------------------------------------------------------
TITLE = chain(r"regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)", r"\s*(?:\||–|—)\s.*\z", r"\s+-\s+.*\z", *TRIM)
STRIPPED = chain("html", *(rf"(?i)<{t}(?:.|\n)*?</{t}>" for t in ("head", "nav", "header", "footer", "script", "style")))
FOCUS = r"(?i)<(?:main|article)[^>]*>((?:.|\n)*?)</(?:main|article)>"


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.html_title("html").alias("title"))


@query(f"SELECT page_id, md5({STRIPPED}) AS digest, length({STRIPPED}) AS n_chars FROM pages")
def html_strip(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", N.html_strip("html").alias("t"))
    return rows.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(f"SELECT page_id, md5(CASE WHEN regexp_matches(t, '{FOCUS}') THEN regexp_extract(t, '{FOCUS}', 1) ELSE t END) AS digest FROM (SELECT page_id, {STRIPPED} AS t FROM pages)")
def html_main(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(N.html_focus(N.html_strip("html")).cast("binary")).alias("digest"))


@query()
def html_to_markdown(spark, sf_dir):
    bounded_batches(spark)
    return table(spark, sf_dir, "pages").select("page_id", N.convert_html("html").alias("content"))


@query(f"""SELECT page_id, length(html) > 1000 AND length(t) < length(html) * 0.01 AS refused FROM (SELECT page_id, html, {TITLE} AS t FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html || repeat('<!-- -->', 600) ELSE html END AS html FROM pages))""")
def safety_guard(spark, sf_dir):
    """What would be left if a page were reduced to its title, every third page being padded."""
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.repeat(F.lit("<!-- -->"), 600))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", N.guard_refuses(F.length(html), F.length(N.html_title(html))).alias("refused"))


@query()
def normalise_pages(spark, sf_dir):
    bounded_batches(spark)
    return N.normalise(page_files(spark, sf_dir))


# --- paths and URLs -----------------------------------------------------------------------------------------------------------
BASE = r"regexp_extract(url, '^(https?://[^/]*)', 1)"
REST = chain(f"substr(url, length({BASE}) + 1)", r"\A/+", r"\?(?:.|\n)*\z")
URL_PATH = f"CASE WHEN {REST} = '' OR ends_with({REST}, '/') THEN {REST} || 'index.html' WHEN ends_with({REST}, '.md') OR ends_with({REST}, '.html') THEN {REST} ELSE {REST} || '.md' END"


@query(f"SELECT page_id, {URL_PATH} AS path FROM pages")
def url_to_path(spark, sf_dir):
    base = F.regexp_extract("url", r"\A(https?://[^/]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.url_to_path("url", base).alias("path"))


@query(f"WITH p AS (SELECT {URL_PATH} AS path, page_id, html FROM pages) SELECT path, max(page_id) AS ord, md5(arg_max(html, page_id)) AS digest FROM p GROUP BY path")
def last_write_wins(spark, sf_dir):
    from sheaf.operators.snapshot import last_write_wins as last

    rows = page_files(spark, sf_dir).withColumn("source", F.lit("all"))
    return last(rows).select("path", "ord", F.md5(F.col("content").cast("binary")).alias("digest"))


URLS = "SELECT regexp_extract(url, '://([^/]*)', 1) AS source, url, page_id AS ord FROM pages"


def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("source"), "url", F.col("page_id").alias("ord"))


@query(f"SELECT source, url, min(ord) AS ord FROM ({URLS}) WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '[?#]') GROUP BY source, url")
def url_filters(spark, sf_dir):
    return discover.plan_urls(urls(spark, sf_dir), include="/(en|fr)/", exclude="[?#]")


@query(f"SELECT source, url, min(ord) AS ord FROM (SELECT source, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || '.md' AS url, ord FROM ({URLS})) GROUP BY source, url")
def url_suffix_dedup(spark, sf_dir):
    cut = urls(spark, sf_dir).withColumn("url", F.regexp_replace("url", "[?#].*$", ""))
    return discover.plan_urls(cut, suffix=".md")


@query(r"""WITH s AS (SELECT source, url, ord, regexp_replace(url, '^https?://[^/]+', '') AS path FROM (""" + URLS + r""")),
c AS (SELECT source, url, ord, path, 2 * len(list_filter(string_split(path, '/'), lambda x: x <> '')) - CASE WHEN regexp_matches(url, '(?i)\b(404|sitemap|robots|favicon|search|login|signup|home|index)\b') THEN 20 ELSE 0 END
  - CASE WHEN path IN ('', '/') THEN 50 ELSE 0 END - CASE WHEN ends_with(url, '/') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)/(docs?|guide|reference|api|tutorial|how-?to|concept|manual)\b') THEN 10 ELSE 0 END
  + CASE WHEN ends_with(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), 'example.org') THEN 2 ELSE 0 END AS score FROM s),
p AS (SELECT source, url, score, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM c),
w AS (SELECT * FROM p WHERE place >= least(5, n // 4) AND place < least(5, n // 4) + 50)
SELECT source, arg_max(url, score * 1000 - place) AS url, CAST(max(score) AS INTEGER) AS score FROM w GROUP BY source""")
def url_score_argmax(spark, sf_dir):
    return discover.best_url(urls(spark, sf_dir), "example.org")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'docs/etc/x' || doc_id WHEN doc_id % 4 = 1 THEN 'a/b/' || source || '.md' WHEN doc_id % 4 = 2 THEN 'n/f/' || lang ELSE 'do...while/' || doc_id END AS path FROM documents")
def sanitise_path(spark, sf_dir):
    i, s, lang = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("docs/../../..//etc/....//x"), i)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("//a/..\\b//"), s, F.lit(".md")))
    raw = raw.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("n\x01/./../f/"), lang)).otherwise(F.concat(F.lit("/do...while/"), i))
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitise_path(F.replace(raw, F.lit("/./"), F.lit("/"))).alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/docs/' || source || '/a.md' WHEN doc_id % 3 = 1 THEN '/docs/etc/' || doc_id ELSE '/docs/x..y/' || lang END AS path FROM documents")
def safe_path(spark, sf_dir):
    i, s, lang = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/docs//"), s, F.lit("/..././a.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("../../etc/"), i)).otherwise(F.concat(F.lit("x..y/"), lang))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(X.safe_path(raw), F.lit("/./"), F.lit("/")).alias("path"))


@query(f"WITH f AS ({FILES}) SELECT path, md5({chain('content', r'\x1b\[[0-9;?]*[A-Za-z]|\x1b\][^\x07]*\x07|\x1b[^\[\]].?|\x1b', r'[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]')}) AS digest FROM f")
def sanitise_content(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.md5(X.sanitise_content("content").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {chain(g('lower(text)', '[^a-z0-9]+', chr(39) + '-' + chr(39)), r'\A-|-\z')} AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slugify("text").alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 2000) || chr(10) || chr(10) || '[truncated ' || (length(text) - 2000) || ' chars; narrow the query or ask for fewer lines]' END AS out FROM documents")
def output_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cap_output("text", most=2000).alias("out"))


# --- markdown -----------------------------------------------------------------------------------------------------------------
MDX = "concat('---', chr(10), 'title: \"Part ', CAST(doc_id AS STRING), '\"', chr(10), '---', chr(10), 'import { A,', chr(10), ' B } from ', chr(39), 'x', chr(39), chr(10), 'import C from ', chr(39), 'y', chr(39), chr(10), 'export const z = 1', chr(10), '<Tabs><TabItem label=\"', lang, '\">', text, '</TabItem></Tabs><Img src=\"a\" />', chr(10), chr(10), chr(10), chr(10), 'end')"
MDX_BODY = chain("m", r"\A---(?:.|\n)*?---\n?")
MDX_OUT = chain(
    g(chain(f"'# Part ' || doc_id || chr(10) || chr(10) || {MDX_BODY}", r"(?m)^import\s+\{[^}]*\}\s+from\s+[^\n]+(?:\n|$)", r"(?m)^import\s+.*?(?:\n|$)", r"(?m)^export\s+.*?(?:\n|$)", r"<[A-Z][A-Za-z0-9]*[^>]*/>"),
      r'<[A-Z][A-Za-z0-9]*\b[^>]*?\b(?:label|title)\s*=\s*"([^"]+)"[^>]*>', r"chr(10) || chr(10) || '### \1' || chr(10) || chr(10)"),
    r"</?[A-Z][A-Za-z0-9]*[^>]*>",
)


@query(f"SELECT doc_id, md5({chain(g(MDX_OUT, chr(92) + 'n{3,}', 'chr(10) || chr(10)'), *TRIM)}) AS digest FROM (SELECT doc_id, {MDX} AS m FROM documents)")
def mdx_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.mdx_to_markdown(F.expr(MDX)).cast("binary")).alias("digest"))


BOILED = "concat('[Skip to content](#m)', chr(10), chr(10), text, chr(10), 'Was this helpful?', chr(10), 'YesNo', chr(10), 'a [Edit page](https://h/e)', chr(10), 'Copy page', chr(10), 'Toolbox', chr(10), chr(10), chr(10), chr(10), 'Guide | Docker Docs', chr(10), 'Submit correction', chr(10))"
CLEANED = chain("m", r"\[Skip to content\]\([^)]*\)\s*", r"Was this helpful\?\s*\n*YesNo\s*", r"\[\s*(?:Edit page|Report issue|Copy page)\s*\]\s*\([^)]*\)\s*", r"(?m)^Copy page\s*$", r"(?m)\| Docker Docs\s*$", r"(?m)^Submit correction\s*$", r"(?m)^(?:Navigation menu|Page actions?|Personal tools|Jump to navigation|Jump to search|Toolbox|In other languages)\s*$")


@query(f"SELECT doc_id, md5({chain(g(CLEANED, chr(92) + 'n{3,}', 'chr(10) || chr(10)'), *TRIM)}) AS digest FROM (SELECT doc_id, {BOILED} AS m FROM documents)")
def md_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.clean_markdown(F.expr(BOILED)).cast("binary")).alias("digest"))


CSS = "concat('.a { b: c; }', chr(10), text, chr(10), '```', chr(10), '.kept { d: e; }', chr(10), '```', chr(10), '.open x {', chr(10), '  gone: 1', chr(10), '}', chr(10), '# Heading ', CAST(doc_id AS STRING))"


@query("SELECT doc_id, text || chr(10) || '```' || chr(10) || '.kept { d: e; }' || chr(10) || '```' || chr(10) || '# Heading ' || doc_id AS content FROM documents")
def css_outside_fences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.strip_css(F.expr(CSS)).alias("content"))


#: Documents of consecutive ids that make one dump, or one list, of a source.
RUN = 200
DUMP = f"concat(source, '.', CAST(CAST(floor(doc_id / {RUN}) AS BIGINT) AS STRING))"


# --- discovery ----------------------------------------------------------------------------------------------------------------
LISTED = "SELECT concat(regexp_extract(url, '://([^/]*)', 1), '.', CAST(CAST(floor(page_id / 200) AS BIGINT) AS STRING)) AS source, url, page_id AS ord FROM pages"


def listed(spark, sf_dir):
    """(source, url, ord): the pages, of each host those of 200 consecutive ids together."""
    return table(spark, sf_dir, "pages").select(F.expr(LISTED[7 : LISTED.index(" AS source")]).alias("source"), "url", F.col("page_id").alias("ord"))


def responses(spark, sf_dir, item, head="", tail="", url="https://h.example/list"):
    """Responses that list pages of a host in order of page_id."""
    rows = listed(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("u"))
    body = F.concat(F.lit(head), F.array_join(F.transform("u", item), "\n"), F.lit(tail))
    return rows.select("source", F.lit(url).alias("url"), body.alias("body"))


FIRST = f"SELECT source, url, CAST(row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS INTEGER) AS ord FROM ({LISTED})"


@query(f"SELECT source, url, min(ord) AS ord FROM ({FIRST}) GROUP BY source, url")
def sitemap_locs(spark, sf_dir):
    odd = lambda x: F.when(x["ord"] % 2 == 0, F.concat(F.lit("<url><loc>"), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))).otherwise(F.concat(F.lit("<url><loc> <![CDATA["), x["url"], F.lit("]]> </loc></url>")))
    return discover.discover("sitemap", responses(spark, sf_dir, odd, "<urlset>", "</urlset>"))


@query(f"SELECT source, url, min(ord) AS ord FROM ({FIRST}) WHERE regexp_matches(url, '(?i)/en/') OR source NOT IN (SELECT source FROM ({FIRST}) WHERE contains(lower(url), '/en/')) GROUP BY source, url")
def sitemap_index_children(spark, sf_dir):
    return discover.child_sitemaps(responses(spark, sf_dir, lambda x: F.concat(F.lit("<loc>"), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc>")), "<sitemapindex>"), "(/en/|/EN/)")


@query(f"SELECT source, url, CAST(min(ord) AS INTEGER) AS ord FROM ({FIRST}) GROUP BY source, url")
def sitemap_index_pages(spark, sf_dir):
    """An index per source with one child sitemap per 40 pages: the index hands over to its children."""
    rows = listed(spark, sf_dir).withColumn("child", F.floor(F.col("ord") % 200 / 40).cast("int"))
    loc = lambda u: F.concat(F.lit("<loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    name = F.concat(F.lit("https://h.example/"), "source", F.lit("/"), "child")
    children = rows.groupBy("source", "child").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("u")).select("source", "child", name.alias("url"), F.array_join(F.transform("u", lambda x: loc(x["url"])), "\n").alias("body"))
    index = children.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("child", "url"))).alias("c"))
    index = index.select("source", F.lit("https://h.example/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("c", lambda x: loc(x["url"])), "\n")).alias("body"))
    return discover.discover("sitemap-index", index, children=children.select("url", "body"))


@query(f"SELECT source, u AS url, min(ord) AS ord FROM (SELECT source, regexp_replace(url, '#.*$', '') AS u, ord FROM ({FIRST})) GROUP BY source, u")
def toc_links(spark, sf_dir):
    item = lambda x: F.concat(F.lit('<li><A HREF="'), x["url"], F.lit('">t</A><link rel=x href="/style.css"></li>'))
    found = discover.discover("toc", responses(spark, sf_dir, item), base_url="http")
    # each page is followed by an asset that isn't one
    return found.withColumn("ord", (F.col("ord") / 2).cast("int"))


@query(f"SELECT source, url, min(ord) AS ord FROM ({FIRST}) GROUP BY source, url")
def rss_links(spark, sf_dir):
    item = lambda x: F.concat(F.lit("<item><title>t</title><link><![CDATA["), x["url"], F.lit("]]></link></item>"))
    return discover.discover("rss", responses(spark, sf_dir, item, "<link>https://channel.example/</link>"))


@query(f"WITH f AS ({FIRST}) SELECT source, url, CAST(min(ord) AS INTEGER) AS ord FROM (SELECT source, url, ord FROM f UNION ALL SELECT source, 'https://h.example/rel/' || ord || '.md', ord + count(*) OVER (PARTITION BY source) FROM f) GROUP BY source, url")
def llms_links(spark, sf_dir):
    rows = listed(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("u"))
    line = lambda x, i: F.concat(F.lit("- [t]("), x["url"], F.lit("): about\n- [r](/rel/"), i.cast("string"), F.lit(".md)"))
    body = F.concat(F.array_join(F.transform("u", line), "\n"), F.lit("\n[full](https://h.example/llms-full.txt) [self](https://h.example/llms.txt)"))
    return discover.discover("llms-txt", rows.select("source", F.lit("https://h.example/llms.txt").alias("url"), body.alias("body")))


@query(f"SELECT source, 'https://' || regexp_extract(url, '://([^/]*)', 1) || '/' || lower(regexp_extract(url, '/([a-z]+)/', 1)) || '/llms.txt' AS url, CAST(min(ord) AS INTEGER) AS ord FROM ({FIRST}) WHERE regexp_matches(url, '/(en|de)/') GROUP BY ALL")
def llms_index_children(spark, sf_dir):
    child = lambda x: F.concat(F.lit("- https://"), F.regexp_extract(x["url"], "://([^/]*)", 1), F.lit("/"), F.regexp_extract(x["url"], "/([a-z]+)/", 1), F.lit("/llms.txt"))
    found = discover.discover("llms-index", responses(spark, sf_dir, child, url="https://h.example/llms.txt"), url_pattern="(/en/|/de/)")
    first = listed(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1)
    first = first.groupBy("source", F.regexp_extract("url", "/([a-z]+)/", 1).alias("lang")).agg(F.min("k").alias("ord"))
    return found.drop("ord").withColumn("lang", F.regexp_extract("url", "/([a-z]+)/llms", 1)).join(first, ["source", "lang"]).select("source", "url", "ord")


@query("SELECT source, 'https://w.example/wiki/' || replace(title, ' ', '_') AS url, CAST(min(ord) AS INTEGER) AS ord FROM (SELECT source, 'Page ' || (doc_id % 7) AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM (SELECT " + DUMP + " AS source, doc_id FROM documents)) GROUP BY ALL")
def mediawiki_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("source", F.expr(DUMP)).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    pages = F.transform("ids", lambda i: F.struct(F.concat(F.lit("Page "), (i % 7).cast("string")).alias("title")))
    body = F.to_json(F.struct(F.struct(pages.alias("allpages")).alias("query")))
    return discover.discover("mediawiki", rows.select("source", F.lit("https://w.example/api").alias("url"), body.alias("body")), base_url="https://w.example/wiki/")


# --- splitters ----------------------------------------------------------------------------------------------------------------
def bundles(spark, sf_dir, page, sep):
    """The dumps of each source: the texts of RUN ids each."""
    rows = table(spark, sf_dir, "documents").select(F.expr(DUMP).alias("source"), F.col("doc_id").alias("i"), page.alias("page"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "page"))), lambda x: x["page"]), sep)
    return rows.groupBy("source").agg(text.alias("content")).select("source", F.lit("https://h.example/docs").alias("base_url"), "content")


PAGES = f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, row_number() OVER (PARTITION BY source, title ORDER BY doc_id) AS again
 FROM (SELECT {DUMP} AS source, doc_id, 'Topic ' || (doc_id % 90) AS title, text FROM documents))
SELECT source, 'topic-' || regexp_extract(title, '[0-9]+') || CASE WHEN again > 1 THEN '-' || n ELSE '' END || '.md' AS path, """


@query(PAGES + "'# ' || title || chr(10) || chr(10) || text AS content FROM d")
def heading_split(spark, sf_dir):
    page = F.concat(F.lit("# Topic "), (F.col("doc_id") % 90).cast("string"), F.lit("\n"), "text")
    return split.heading_split(bundles(spark, sf_dir, page, "\n"))


def front_page():
    return F.concat(F.lit('---\ntitle: "Topic '), (F.col("doc_id") % 90).cast("string"), F.lit('"\nkind: x\n---\n'), "text", F.lit("\n---\nafter a rule"))


FRONT_SQL = PAGES + "text || chr(10) || '---' || chr(10) || 'after a rule' AS content FROM d"


@query(FRONT_SQL)
def frontmatter_split(spark, sf_dir):
    return split.frontmatter_split(bundles(spark, sf_dir, front_page(), "\n"))


def meta_page():
    number = F.col("doc_id").cast("string")
    return F.concat(
        F.lit("-" * 20 + '\ntitle: "T '), number, F.lit('"\nsource: "https://h.example/docs/p/'), number, F.lit('/"\n' + "-" * 20 + "\n"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# T "), number, F.lit("\n\n"), "text")).otherwise(F.col("text")),
    )


META_SQL = f"SELECT {DUMP} AS source, 'p/' || doc_id || '.md' AS path, '# T ' || doc_id || chr(10) || chr(10) || text AS content FROM documents"


@query(META_SQL)
def meta_split(spark, sf_dir):
    return split.meta_split(bundles(spark, sf_dir, meta_page(), "\n"))


@query(f"SELECT * FROM ({META_SQL}) WHERE source LIKE 'src1%' UNION ALL SELECT * FROM ({FRONT_SQL}) WHERE source NOT LIKE 'src1%'")
def split_detected(spark, sf_dir):
    """Dumps of different layouts: each is split by its own."""
    page = F.when(F.col("source").startswith("src1"), meta_page()).otherwise(front_page())
    return split.split(bundles(spark, sf_dir, page, "\n"))


@query(f"SELECT source, path, content FROM ({META_SQL}) WHERE regexp_matches(path, '[02468]') AND NOT regexp_matches(path, '7')")
def llms_full_pages(spark, sf_dir):
    """Fetched dumps, split and filtered by path."""
    found = bundles(spark, sf_dir, meta_page(), "\n").select("source", F.col("base_url").alias("url"), F.col("content").alias("body"))
    return split.llms_full(found, include="[02468]", exclude="7")


# --- API specifications -------------------------------------------------------------------------------------------------------
def specs(spark, sf_dir):
    """A specification per source and run of ids, with an operation per document: its language is the tag."""
    item = F.struct(F.struct(
        F.concat(F.lit("Get "), F.col("doc_id").cast("string")).alias("summary"), F.array("lang").alias("tags"),
        F.array(F.struct(F.lit("q").alias("name"), F.lit("query").alias("in"), F.struct(F.lit("string").alias("type")).alias("schema"))).alias("parameters"),
        F.create_map(F.lit("200"), F.struct(F.lit("ok").alias("description"))).alias("responses"),
    ).alias("get"))
    entry = F.struct(F.concat(F.lit("/d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"), item.alias("value"))
    rows = table(spark, sf_dir, "documents").withColumn("source", F.expr(DUMP)).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("paths"))
    return rows.select("source", F.to_json(F.struct(F.struct("source", F.col("source").alias("title"), F.lit("1").alias("version")).alias("info"), "paths")).alias("raw"))


@query(f"""WITH d AS (SELECT {DUMP} AS source, lang, doc_id, '## GET /d/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(10) || chr(10) || 'Get ' || doc_id || chr(10) || chr(10) || 'Parameters:' || chr(10) || '- `q` (query, string)' || chr(10) || chr(10)
  || 'Responses:' || chr(10) || '- `200`: ok' AS block FROM documents),
t AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first, string_agg(block, chr(10) || chr(10) ORDER BY doc_id) AS blocks FROM d GROUP BY ALL)
SELECT source, lang || '.md' AS path, '# ' || lang || chr(10) || chr(10) || blocks || chr(10) AS content FROM t
UNION ALL SELECT source, 'overview.md', '# ' || source || chr(10) || chr(10) || 'Version: 1' || chr(10) || chr(10) || string_agg('- ' || lang || ': ' || n || ' operations', chr(10) ORDER BY first) FROM t GROUP BY source""")
def openapi_files(spark, sf_dir):
    from sheaf.operators import openapi

    return openapi.to_files(specs(spark, sf_dir))


# --- API pages: references, lists, choices, and unions; a tenth of the specifications is read as YAML
KINDS = {
    0: ({"$ref": "#/components/schemas/User"}, "{ id: integer, name?: string, friend?: object }"),
    1: ({"type": "array", "items": {"$ref": "#/components/schemas/Kind"}}, '"a" | "é" | {"a":1} | 1 | null[]'),
    2: ({"oneOf": [{"$ref": "#/components/schemas/User"}, {"type": "string"}, {"type": "number"}, {"type": "null"}]}, "{ id: integer, name?: string, friend?: object } | string | number"),
    3: ({"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object"}]}, "{ " + ", ".join(f"f{i}?: any" for i in range(10)) + ", ... } & object"),
    4: ({"$ref": "#/components/schemas/Absent"}, "any"),
}
SCHEMAS = {
    "User": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "name": {"type": "string"}, "friend": {"$ref": "#/components/schemas/User"}}},
    "Kind": {"enum": ["a", "é", {"a": 1}, 1, None, "left out"]}, "Base": {"properties": {f"f{i}": {} for i in range(12)}},
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def api_specs(spark, sf_dir):
    """An operation for each document: by the remainder of its id its response and body have different schemas."""
    import json

    i = F.col("doc_id")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    schema = F.get(F.array(*[F.lit(json.dumps(KINDS[k][0])) for k in range(5)]), (i % 5).cast("int"))
    shown = F.concat(
        F.lit('{"summary": "Get '), i.cast("string"), F.lit('", "tags": ["'), "lang", F.when(i % 4 == 0, '", "More Of It').otherwise(""), F.lit('"], "deprecated": '), (i % 7 == 0).cast("string"),
        F.when(i % 6 == 0, ', "description": "Long text", "security": [{"key": [], "token": []}, {"basic": []}]').otherwise(""),
        F.lit(', "parameters": [{"name": "q", "in": "query", "schema": {"type": "string"}, "description": "what"}, {"name": "id", "in": "path", "required": true, "schema": '), schema, F.lit('}, {"name": "x", "in": "cookie"}]'),
        F.when(i % 2 == 0, F.concat(F.lit(', "requestBody": {"content": {"application/json": {"schema": '), schema, F.lit("}}}"))).otherwise(""),
        F.lit(', "responses": {"default": {"description": "else"}, "404": {"description": "none"}, "200": {"description": "ok", "content": {"application/json": {"schema": '), schema, F.lit("}}}}}"),
    )
    entry = F.struct(F.lpad(i.cast("string"), 9, "0").alias("at"), F.concat(F.lit('"/d/'), F.lpad(i.cast("string"), 9, "0"), F.when(i % 3 == 0, '": {"summary": "x", "post": ').otherwise('": {"get": '), shown, F.lit("}")).alias("text"))
    rows = table(spark, sf_dir, "documents").withColumn("source", F.expr(DUMP)).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ", ").alias("paths"))
    tail = f', "components": {{"schemas": {json.dumps(SCHEMAS)}}}}}'
    # what doesn't begin with a brace is read as YAML
    raw = F.concat(F.when(F.col("source").rlike("5$"), "# as YAML\n").otherwise(""), F.lit('{"info": {"title": '), quoted("source"), F.lit(', "description": "About it"}, "security": [{"all": []}], "paths": {'), "paths", F.lit("}"), F.lit(tail))
    return rows.select("source", raw.alias("raw"))


_KIND = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {_literal(v[1])}" for k, v in KINDS.items()) + " END"
_NL = "chr(10)"
API_SQL = f"""WITH d AS (SELECT {DUMP} AS source, lang, doc_id, {_KIND} AS kind, '## ' || CASE WHEN doc_id % 3 = 0 THEN 'POST' ELSE 'GET' END || ' /d/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || CASE WHEN doc_id % 7 = 0 THEN ' ~~DEPRECATED~~' ELSE '' END || {_NL} || 'Get ' || doc_id || {_NL}
 || CASE WHEN doc_id % 6 = 0 THEN {_NL} || 'Long text' || {_NL} || {_NL} || 'Auth: key, token | basic' ELSE {_NL} || 'Auth: all' END || {_NL} || {_NL} || '### Path params' || {_NL} || '- `id` (' || kind || ', required): ' || {_NL} || {_NL} || '### Query params' || {_NL} || '- `q` (string): what' || {_NL}
 || CASE WHEN doc_id % 2 = 0 THEN {_NL} || '### Body: `' || kind || '`' || {_NL} ELSE '' END || {_NL} || '### Responses' || {_NL} || '- **200**: ok → `' || kind || '`' || {_NL} || '- **404**: none' || {_NL} || '- **default**: else' || {_NL} AS block FROM documents),
t AS (SELECT source, doc_id, block, lang AS tag, 0 AS k FROM d UNION ALL SELECT source, doc_id, block, 'more-of-it', 1 FROM d WHERE doc_id % 4 = 0),
g AS (SELECT source, tag, count(*) AS n, min({{'d': doc_id, 'k': k}}) AS first, string_agg(block, {_NL} ORDER BY doc_id) AS blocks FROM t GROUP BY source, tag)
SELECT source, 'api/' || tag || '.md' AS path, '# ' || tag || {_NL} || {_NL} || blocks AS content FROM g
UNION ALL SELECT source, 'api/overview.md', '# ' || source || {_NL} || {_NL} || 'About it' || {_NL} || {_NL} || 'Version: unknown (OpenAPI 3.x)' || {_NL} || {_NL} || '## Endpoint Groups' || {_NL} || {_NL} || string_agg('- **' || tag || '** — ' || n || ' endpoints', {_NL} ORDER BY first) FROM g GROUP BY source"""


@query(API_SQL)
def api_pages(spark, sf_dir):
    from sheaf.operators import openapi

    return openapi.api_pages(api_specs(spark, sf_dir))


# --- routing: the source's format, else the extension
@query(f"""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'mdx' WHEN 2 THEN 'text' END AS format, {URL_PATH} || CASE WHEN page_id % 3 = 0 THEN '.mdx' WHEN page_id % 3 = 1 THEN '.html' ELSE '' END AS path FROM pages)
SELECT page_id, CASE WHEN format IN ('html', 'mdx') THEN format WHEN ends_with(path, '.mdx') THEN 'mdx' WHEN ends_with(path, '.html') THEN 'html' ELSE '' END AS route FROM f""")
def routed(spark, sf_dir):
    i = F.col("page_id")
    base = F.regexp_extract("url", r"\A(https?://[^/]*)", 1)
    path = F.concat(X.url_to_path("url", base), F.when(i % 3 == 0, ".mdx").when(i % 3 == 1, ".html").otherwise(""))
    kind = F.when(i % 4 == 0, "html").when(i % 4 == 1, "mdx").when(i % 4 == 2, "text")
    return table(spark, sf_dir, "pages").select("page_id", N.route(kind, path).alias("route"))


# --- several roots of one source: a path that both have is the second one's
@query("""WITH a AS (SELECT source, 'd/' || doc_id AS path, text AS content, 'one' AS root FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source, 'd/' || doc_id AS path, upper(lang) AS content, 'two' AS root FROM documents WHERE doc_id % 2 = 0)
SELECT source, path, md5(content) AS digest, root FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE (source, path) NOT IN (SELECT (source, path) FROM b))""")
def files_of_roots(spark, sf_dir):
    from sheaf.operators.catalog import of_roots

    docs, path = table(spark, sf_dir, "documents"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    one = docs.where("doc_id % 3 <> 0").select("source", path, F.col("text").alias("content"))
    two = docs.where("doc_id % 2 = 0").select("source", path, F.upper("lang").alias("content"))
    return of_roots({"one": one, "two": two}).select("source", "path", F.md5(F.col("content").cast("binary")).alias("digest"), "root")
