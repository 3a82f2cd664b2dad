"""Chains of responses: cycles, depth, failed and missing answers, continuation tokens."""

import json

from sheaf.operators import chains

SHAPE = "source string, url string, body string"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"


def pages(*urls):
    return "<urlset>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</urlset>"


def test_sitemaps_with_cycles_and_failures(spark):
    rows = [
        ("a", "r", index("r", "x", "y", "gone", "failed")), ("a", "x", index("r", "y", "z")), ("a", "y", pages("p1", "p2")), ("a", "z", pages("p2", "p3")), ("a", "failed", None), ("a", "aside", pages("p9")),
        ("b", "r", pages("q1")), ("b", "y", pages("no")), (None, "r", pages("n1")),
    ]
    responses = spark.createDataFrame(rows, SHAPE)
    seeds = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", "r"), ("c", "r"), ("a", None)], "source string, url string")
    assert sorted(map(tuple, chains.sitemap_tree(responses, seeds).collect())) == [("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "q1")]
    steps = {(r.source, r.url): r.step for r in chains.reach(responses, seeds, lambda met: chains.discover.sitemap(met.where(chains.discover.is_index())), 10).collect()}
    assert steps == {("a", "r"): 0, ("b", "r"): 0, ("c", "r"): 0, ("a", "x"): 1, ("a", "y"): 1, ("a", "gone"): 1, ("a", "failed"): 1, ("a", "z"): 2}
    # not deeper than asked
    assert sorted(map(tuple, chains.sitemap_tree(responses, seeds, most=1).collect())) == [("a", "p1"), ("a", "p2"), ("b", "q1")]
    assert chains.sitemap_tree(responses.where("false"), seeds).count() == 0 == chains.sitemap_tree(responses, seeds.where("false")).count()


def test_answers_of_a_wiki(spark):
    api = "https://w/api.php"
    answer = lambda titles, token=None: json.dumps({"query": {"allpages": [{"title": t} for t in titles]}} | ({"continue": {"apcontinue": token}} if token else {}))
    ask = lambda token=None: api + chains.ALL_PAGES + (f"&apcontinue={token}" if token else "")
    rows = [("w", ask(), answer(["A b", "C/d"], "E f")), ("w", ask("E%20f"), answer(["E f", "A b"], "Z")), ("w", ask("Z"), answer(["Z"], "E f")), ("w", ask("never"), answer(["no"]))]
    apis = spark.createDataFrame([("w", api), ("v", api)], "source string, url string")
    found = chains.wiki_pages(spark.createDataFrame(rows, SHAPE), apis, "https://w/wiki/").orderBy("ord").collect()
    assert [(r.source, r.url.removeprefix("https://w/wiki/"), r.ord) for r in found] == [("w", "A_b", 0), ("w", "C%2Fd", 1), ("w", "E_f", 2), ("w", "Z", 4)]
    assert [r.url[-3:] for r in chains.wiki_pages(spark.createDataFrame(rows, SHAPE), apis, "https://w/wiki/", most=1).orderBy("ord").collect()] == ["A_b", "2Fd"]


def test_lists_of_lists(spark):
    rows = [
        ("l", "https://h/llms.txt", "see https://h/a/llms.txt and https://h/b/llms.txt and https://h/top.md"), ("l", "https://h/a/llms.txt", "[x](one.md) https://h/a/deep/llms.txt https://h/llms.txt https://h/a/pic.png"),
        ("l", "https://h/a/deep/llms.txt", "https://h/two.html"), ("l", "https://h/b/llms.txt", None),
    ]
    seeds = spark.createDataFrame([("l", "https://h/llms.txt")], "source string, url string")
    assert {r.url for r in chains.llms_tree(spark.createDataFrame(rows, SHAPE), seeds).collect()} == {"https://h/top.md", "https://h/a/one.md", "https://h/two.html"}
    assert {r.url for r in chains.llms_tree(spark.createDataFrame(rows, SHAPE), seeds, "(/b/)").collect()} == {"https://h/top.md"}
