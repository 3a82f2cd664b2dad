"""Discovery: the URLs that a saved response (sitemap, feed, table of contents, link list) leads to.

All functions take responses(source, url, body) and give (source, url, ord): each URL once per source, ord its first place.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import add_suffix, encode_component, replace, xml_unescape

LOC = r"<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"
HREF = r'(?i)href="([^"\s]+)"'
ABSOLUTE = r"(https?://[^\s)>\]]+)"
MARKDOWN_LINK = r"\]\(([^)]+)\)"
ITEM = r"<item>([\s\S]*?)</item>"
ITEM_LINK = r"<link>\s*(?:<!\[CDATA\[)?\s*(https?://[^\s<\]]+?)\s*(?:\]\]>)?\s*</link>"
#: File types that are no pages.
ASSETS = r"(?i)\.(css|js|json|xml|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|zip|tar|gz|pdf)\z"
LLMS_FILE = r"/llms(?:-full)?\.txt\z"
#: What tells a page of content by its URL, the weights of the signs, and the pool of URLs that are compared.
NO_CONTENT = r"(?i)\b(404|sitemap|robots|favicon|search|login|signup|home|index)\b"
DOCS_LIKE = r"(?i)/(docs?|guide|reference|api|tutorial|how-?to|concept|manual)\b"
SCORES = {"part": 2, "no content": -20, "root": -50, "slash": -3, "docs": 10, "host": 2}
POOL, POOL_START = 50, 5


def every(pattern: str, body: Column | str = "body") -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))


@F.pandas_udf(T.StringType())
def resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    """Relative to absolute URL: there is no built-in function for it."""

    def one(u, b):
        try:
            return urljoin(b, u)
        except ValueError:
            return None

    return pd.Series([None if u is None or b is None else one(u, b) for u, b in zip(url, base, strict=True)], dtype="object")


def absolute(url: Column, base: Column) -> Column:
    return F.when(url.rlike(r"\A(?i)https?://"), url).otherwise(resolve(url, base))


def ordered_distinct(rows: DataFrame) -> DataFrame:
    """rows(source, url, ord) -> each URL once per source, at its first place."""
    return rows.groupBy("source", "url").agg(F.min("ord").alias("ord"))


def exploded(responses: DataFrame, urls: Column) -> DataFrame:
    return responses.select("source", F.col("url").alias("base"), F.posexplode(urls).alias("ord", "url"))


def explicit(sources: DataFrame) -> DataFrame:
    """sources(source, url, urls): the listed URLs, or the source's own."""
    urls = F.when(F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 0, F.col("urls")).otherwise(F.array("url"))
    return ordered_distinct(sources.select("source", F.posexplode(urls).alias("ord", "url")))


def sitemap(responses: DataFrame) -> DataFrame:
    found = exploded(responses, F.transform(every(LOC), xml_unescape))
    return ordered_distinct(found.select("source", "url", "ord"))


def keywords_of(url_pattern: str) -> list[str]:
    """The alternatives of a pattern's first group."""
    inside = url_pattern.partition("(")[2].partition(")")[0].removeprefix("?:")
    return [w.lower() for w in inside.split("|") if w]


def has_keyword(url: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(url), F.lit(w))
    return hit


def child_sitemaps(responses: DataFrame, url_pattern: str = "") -> DataFrame:
    """Child sitemaps; those with a keyword of the pattern if any has one, else all."""
    found = sitemap(responses).withColumn("__hit", has_keyword(F.col("url"), keywords_of(url_pattern)))
    some = found.groupBy("source").agg(F.max("__hit").alias("__some"))
    return found.join(some, "source").where("__hit OR NOT __some").select("source", "url", "ord")


def sitemap_index(children: DataFrame) -> DataFrame:
    """Pages of the children's responses; failed ones (null body) give none. Not made distinct."""
    return exploded(children.where("body IS NOT NULL"), F.transform(every(LOC), xml_unescape)).select("source", "url", "ord")


def toc(responses: DataFrame, base_url: str) -> DataFrame:
    found = exploded(responses, F.transform(every(HREF), lambda u: F.substring_index(u, "#", 1)))
    found = found.where((F.col("url") != "") & ~F.col("url").rlike(ASSETS)).withColumn("url", absolute(F.col("url"), F.col("base")))
    return ordered_distinct(found.where(F.col("url").startswith(base_url)).select("source", "url", "ord"))


TITLES = T.StructType([T.StructField("query", T.StructType([T.StructField("allpages", T.ArrayType(T.StructType([T.StructField("title", T.StringType())])))]))])


def mediawiki(responses: DataFrame, base_url: str) -> DataFrame:
    """Pages of allpages answers. Several answers of one source, numbered by a column `page`, come one after the other."""
    page = F.col("page") if "page" in responses.columns else F.lit(0)
    rows = responses.select("source", page.cast("long").alias("page"), F.from_json("body", TITLES)["query"]["allpages"]["title"].alias("titles"))
    # titles before an answer's own: one row per answer goes through the window
    before = F.coalesce(F.sum(F.greatest(F.size("titles"), F.lit(0))).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumn("before", before).select("source", "before", F.posexplode("titles").alias("at", "title"))
    url = F.concat(F.lit(base_url), encode_component(F.replace(F.col("title"), F.lit(" "), F.lit("_"))))
    return ordered_distinct(found.select("source", url.alias("url"), (F.col("before") + F.col("at")).cast("int").alias("ord")))


def llms_txt(responses: DataFrame) -> DataFrame:
    """Absolute URLs, then markdown links made absolute; not the list itself nor other lists, which take no place where their URLs are absolute."""
    full = F.filter(every(ABSOLUTE), lambda u: ~u.rlike(LLMS_FILE) & (u != F.col("url")))
    relative = F.filter(every(MARKDOWN_LINK), lambda u: ~u.rlike(r"\A(?i)(?:https?:|mailto:|#)"))
    found = exploded(responses, F.concat(full, relative))
    found = found.withColumn("url", absolute(F.col("url"), F.col("base"))).where("url IS NOT NULL")
    return ordered_distinct(found.where(~F.col("url").rlike(LLMS_FILE) & (F.col("url") != F.col("base"))).select("source", "url", "ord"))


def llms_index(responses: DataFrame, url_pattern: str = "") -> DataFrame:
    """Child lists of a list of lists, those with a keyword of the pattern if it has keywords (there is no falling back to all)."""
    found = exploded(responses, every(ABSOLUTE))
    found = found.where(F.col("url").endswith("/llms.txt") & (F.col("url") != F.col("base")))
    words = keywords_of(url_pattern)
    return ordered_distinct((found.where(has_keyword(F.col("url"), words)) if words else found).select("source", "url", "ord"))


def rss(responses: DataFrame) -> DataFrame:
    """The first link of each item."""
    links = F.transform(every(ITEM), lambda item: F.regexp_extract(item, ITEM_LINK, 1))
    return ordered_distinct(exploded(responses, F.filter(links, lambda u: u != "")).select("source", "url", "ord"))


def is_index(body: Column | str = "body") -> Column:
    """Whether a sitemap's body lists other sitemaps."""
    return F.contains(F.col(body) if isinstance(body, str) else body, F.lit("<sitemapindex"))


def sitemap_pages(responses: DataFrame, children: DataFrame | None = None, url_pattern: str = "") -> DataFrame:
    """Pages of sitemaps; a body that is an index hands over to its children: (source, url, ord).

    children(url, body) are the fetched child sitemaps, of which only those that child_sitemaps() names count. Their pages follow the children's order.
    """
    own = sitemap(responses.where(~is_index()))
    if children is None:
        return own
    wanted = child_sitemaps(responses.where(is_index()), url_pattern)
    met = children.where("body IS NOT NULL").join(wanted.select("source", "url", F.col("ord").alias("child")), "url")
    pages = met.select("source", "child", F.posexplode(F.transform(every(LOC), xml_unescape)).alias("at", "url"))
    # pages of a source in order of child and place: what comes before a child is a sum over one row for each child
    sizes = pages.groupBy("source", "child").agg((F.max("at") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "child", before.alias("before"))
    return own.unionByName(ordered_distinct(pages.join(sizes, ["source", "child"]).select("source", "url", (F.col("before") + F.col("at")).cast("int").alias("ord"))))


DISCOVERY = {"sitemap": sitemap_pages, "sitemap-index": sitemap_pages, "toc": toc, "mediawiki": mediawiki, "llms-txt": llms_txt, "llms-index": llms_index, "rss": rss}


def discover(method: str, responses: DataFrame, **options) -> DataFrame:
    """The URLs by the named method; an unknown one gives none."""
    if method not in DISCOVERY:
        return responses.select("source", "url", F.lit(0).alias("ord")).where(F.lit(False))
    return DISCOVERY[method](responses, **options)


def plan_urls(urls: DataFrame, include: str | None = None, exclude: str | None = None, suffix: str | None = None) -> DataFrame:
    """(source, url, ord) with the filters, the suffix and then the removal of repeats applied."""
    if include:
        urls = urls.where(F.col("url").rlike(include))
    if exclude:
        urls = urls.where(~F.col("url").rlike(exclude))
    if suffix:
        urls = urls.withColumn("url", add_suffix("url", suffix))
    return ordered_distinct(urls)


def require_some(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """sources(source) that discovered nothing, with the error."""
    return sources.select("source").distinct().join(urls.select("source").distinct(), "source", "left_anti").withColumn("error", F.lit("discovery found no URLs"))


def best_url(urls: DataFrame, base_host: str) -> DataFrame:
    """urls(source, url, ord) -> the URL of each source that most looks like a page of content, with its score.

    50 URLs from a little behind the start are compared; the first of equals wins.
    """
    path = replace("url", r"\Ahttps?://[^/]+")
    parts = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    weight = lambda ok, name: F.when(ok, SCORES[name]).otherwise(0)
    score = parts * SCORES["part"] + weight(F.col("url").rlike(NO_CONTENT), "no content") + weight(path.isin("", "/"), "root") + weight(F.col("url").endswith("/"), "slash")
    score = score + weight(F.col("url").rlike(DOCS_LIKE), "docs") + weight(F.lower(F.regexp_extract("url", r"\Ahttps?://([^/:?#]+)", 1)).endswith(base_host), "host")
    # the pool lies within the first places of a source, which each task cuts to before anything is shuffled; counts are one row for each source
    place = F.row_number().over(Window.partitionBy("source").orderBy("ord"))
    first = urls.select("source", "url", "ord").withColumn("place", place).where(F.col("place") <= POOL + POOL_START).withColumn("place", F.col("place") - 1)
    counts = urls.groupBy("source").agg(F.least(F.lit(POOL_START), F.floor(F.count("*") / 4)).alias("start"))
    pool = first.join(counts, "source").where(F.col("place").between(F.col("start"), F.col("start") + POOL - 1)).withColumn("score", score.cast("int"))
    return pool.groupBy("source").agg(F.max_by("url", F.struct("score", -F.col("place"))).alias("url"), F.max("score").alias("score"))
