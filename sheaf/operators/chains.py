"""Chains of responses: indexes of indexes, and answers that name the next one, followed to their end.

Each step takes the responses to what the step before has found and asks them for more; what was seen before, of the same source, isn't asked again,
so cycles end. A step is a join on the URL; its result is written, and only whether it is empty comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import encode_component
from sheaf.operators import discover
from sheaf.sources.workspace import shared_dir

#: Most answers of a wiki, and the parameters that ask for one.
MOST_ANSWERS = 20
ALL_PAGES = "?action=query&list=allpages&apnamespace=0&aplimit=500&apfilterredir=nonredirects&format=json"


def reach(responses: DataFrame, seeds: DataFrame, more: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """responses(source, url, body), seeds(source, url), more: responses -> (source, url) -> what is reached: source, url, step (0 for seeds), of `most` steps at most.

    URLs without a response, or with a failed one (null body), are reached but lead nowhere. Of several responses to a URL each counts.
    """
    shared_dir(responses.sparkSession)
    key = ["source", "url"]
    front = seeds.select(*key).where("url IS NOT NULL").distinct().withColumn("step", F.lit(0)).checkpoint()
    seen = front
    for step in range(1, most + 1):
        met = responses.where("body IS NOT NULL").join(front.select(*key), key, "left_semi")
        front = more(met).select(*key).where("url IS NOT NULL").distinct().join(seen.select(*key), key, "left_anti").withColumn("step", F.lit(step)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def sitemap_tree(responses: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """The pages (source, url) of the sitemaps that seeds lead to, through indexes of any depth up to `most`; failed sitemaps give none."""
    indexes = lambda met: discover.sitemap(met.where(discover.is_index()))
    found = reach(responses, seeds, indexes, most)
    leaves = responses.where(F.col("body").isNotNull() & ~discover.is_index()).join(found.select("source", "url"), ["source", "url"], "left_semi")
    return discover.sitemap(leaves).select("source", "url")


def next_answer(url: Column, body: Column) -> Column:
    """The URL of a wiki's next answer; null after the last."""
    token = F.get_json_object(body, "$.continue.apcontinue")
    base = F.substring_index(F.substring_index(url, "&apcontinue=", 1), "?", 1)
    return F.when(token != "", F.concat(base, F.lit(ALL_PAGES + "&apcontinue="), encode_component(token)))


def wiki_pages(responses: DataFrame, apis: DataFrame, base_url: str, most: int = MOST_ANSWERS) -> DataFrame:
    """Pages (source, url, ord) of the wikis apis(source, url): of the first answer and those that it leads to, `most` at most."""
    first = apis.select("source", F.concat("url", F.lit(ALL_PAGES)).alias("url"))
    found = reach(responses, first, lambda met: met.select("source", next_answer(F.col("url"), F.col("body")).alias("url")), most - 1)
    return discover.mediawiki(responses.where("body IS NOT NULL").join(found.withColumnRenamed("step", "page"), ["source", "url"]), base_url)


def llms_tree(responses: DataFrame, seeds: DataFrame, url_pattern: str = "", most: int = 10) -> DataFrame:
    """Pages (source, url) named by the lists that seeds lead to through lists of lists: those that end in .md or .html."""
    found = reach(responses, seeds, lambda met: discover.llms_index(met, url_pattern), most)
    lists = responses.where("body IS NOT NULL").join(found.select("source", "url"), ["source", "url"], "left_semi")
    return discover.llms_txt(lists).where(F.col("url").rlike(r"\.(md|html)\z")).select("source", "url").distinct()

