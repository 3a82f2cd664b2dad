import pytest
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.functions import text as X
from sheaf.functions.html_md import markdown
from sheaf.operators import discover, index, openapi, split
from sheaf.sources import files as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, expected", [("docs/../../../etc/passwd", "docs/etc/passwd"), ("a/../b/../c/../etc/passwd", "a/b/c/etc/passwd"), ("docs//nested//file.md", "docs/nested/file.md"), ("....//x", "x"), ("a\\..\\b", "a\\b"), ("//x", "x"), ("", "")])
def test_sanitise_path(spark, given, expected):
    assert one(spark, X.sanitise_path("t"), t=given) == expected


@pytest.mark.parametrize("given, expected", [("do...while/index.md", "/docs/do...while/index.md"), ("../../etc", "/docs/etc"), ("/docs//a//b", "/docs/a/b"), ("....//x", "/docs/x")])
def test_safe_path(spark, given, expected):
    assert one(spark, X.safe_path("t"), t=given) == expected


def test_sanitise_content(spark):
    assert one(spark, X.sanitise_content("t"), t="A\x1b[31m\x00B\x01C\x1b]0;title\x07D\n\te") == "ABCD\n\te"
    assert one(spark, X.sanitise_content("t"), t="a\x1b[?25lb") == "ab"


@pytest.mark.parametrize("url, path", [("https://h/a/b?x=1", "a/b.md"), ("https://h/", "index.html"), ("https://h/a/", "a/index.html"), ("https://h/a.html#top", "a.html#top.md"), ("https://h/a.md", "a.md")])
def test_url_to_path(spark, url, path):
    assert one(spark, X.url_to_path("t", "https://h"), t=url) == path


def test_small_text_functions(spark):
    assert one(spark, X.slugify("t"), t=" Argo: Smart  Routing! ") == "argo-smart-routing"
    assert one(spark, X.trim("t"), t="  a b﻿\n") == "a b"
    assert one(spark, X.xml_unescape("t"), t="&amp;lt;&quot;") == '<"'
    assert one(spark, X.encode_component("t"), t="a b(c)!") == "a%20b(c)!"
    assert one(spark, X.add_suffix("t", ".md"), t="h/a/") == "h/a.md"
    assert one(spark, X.cap_output("t", most=3), t="abcde").startswith("abc\n\n[truncated 2 chars")
    assert one(spark, F.array_join(X.lines_of("t"), "|"), t="a\n\nb\n") == "a||b"


def test_mdx(spark):
    text = '---\ntitle: "T"\n---\nimport {\n A\n} from \'x\'\nimport B from \'y\'\nexport const c = 1\n<Tabs><Tab label="JS">code</Tab></Tabs><Img src="x" />\n\n\n\nend'
    assert one(spark, N.mdx_to_markdown("t"), t=text) == "# T\n\n### JS\n\ncode\n\nend"
    assert one(spark, N.mdx_to_markdown("t"), t="---\ntitle: A\n---\n# Own\nB") == "# Own\nB"


def test_html(spark):
    page = "<html><head><title>Guide | Site</title></head><body><nav>no</nav><main id=m><h2>A</h2><p>x <b>y</b> &amp; z<ul><li>i</ul><pre><code>p  q</code></pre></main><footer>no</footer></body></html>"
    assert one(spark, N.convert_html("t"), t=page) == "# Guide\n\n## A\n\nx **y** & z\n\n-   i\n\n```\np  q\n```"
    assert one(spark, N.html_title("t"), t="<title>Self-hosted - Site</title>") == "Self-hosted"
    assert one(spark, N.convert_html("t"), t="<script>" + "x" * 2000 + "</script>") is None
    assert markdown("<ol><li>a<ul><li>b</ul><li>c</ol>") == "1.  a\n    -   b\n2.  c"


def test_cleaner(spark):
    text = "[Skip to content](#m)\n\n# T\nWas this helpful?\nYesNo\n[Edit page](https://h/e)\nCopy page\n.leak { a: b }\n```\n.keep { a: b }\n```\n.x y {\n a\n}\nToolbox\n\n\n\nend"
    assert one(spark, N.clean_markdown("t"), t=text) == "# T\n\n```\n.keep { a: b }\n```\n\nend"


def test_router(spark):
    rows = spark.createDataFrame([("s", "markdown", "a.mdx", "<Note>m</Note>", 1), ("s", "markdown", "a.md", "later", 2), ("s", "html", "b.md", "<p>h</p>", 3), ("s", "html", "c.html", "<p>" + "<span></span>" * 300, 4), ("s", "markdown", "d.txt", "\x01t", 5)], "source string, format string, path string, content string, ord long")
    found = {r.path: r.content for r in N.normalise(rows).collect()}
    assert found["a.md"] == "later" and found["b.md"] == "h" and found["d.txt"] == "t" and found["c.html"].startswith("<p>")


INDEX = {
    "a/h1.md": ("# Auth\nSome prose here.\n## More\n", "Auth", " Auth More Some prose here."),
    "a/fm.md": ('---\ntitle: "T"\ndescription: D\n--- \n# H\n## I\n', "T", "D  H I"),
    "a/folded.md": ("---\ntitle: T\ndescription: >\n  next line\n---\n", "T", "next line"),
    "a/one.md": ("---\ntitle: `T`\noneline: O\n---\n", "T", "O"),
    "a/open.md": ("---\ntitle: T\n# H\n", "", " "),
    "a/cut.md": ("---\ntitle: T\n## H\nx\n", "T", " H "),
    "a/fence.md": ("```\n# no\n```\n#tag\n", "tag", " tag "),
    "a/prose.md": ("- item\nabc\tdef\x1b[31m\n", "abc def", " abc def"),
    "a/none.md": ("1\n\n2\n", "", " "),
    "a/many.md": ("".join(f"# h{i}\n" for i in range(8)), "h0", " h0 h1 h2 h3 h4 "),
}


def test_index(spark):
    rows = [(p, c) for p, (c, _, _) in INDEX.items()] + [("a/empty.md", ""), ("a/page.html", "# H")]
    found = {r.path: (r.title, r.summary) for r in index.build_index(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert found == {p: (t, s) for p, (_, t, s) in INDEX.items()}


def responses(spark, body, url="https://h.example/x/toc.html"):
    return spark.createDataFrame([("s", url, body)], "source string, url string, body string")


def urls(df):
    return [r.url for r in df.orderBy("ord").collect()]


def test_discovery(spark):
    assert urls(discover.sitemap(responses(spark, "<loc>https://a/1</loc><loc> <![CDATA[https://a/2]]> </loc><loc>https://a/1</loc>"))) == ["https://a/1", "https://a/2"]
    assert urls(discover.toc(responses(spark, '<A HREF="p.html#x"><a href="/y.css"><a href="#z"><a href="q.html">'), "https://h.example/x/")) == ["https://h.example/x/p.html", "https://h.example/x/q.html"]
    assert urls(discover.llms_txt(responses(spark, "[a](https://h/a.md) [b](/b.md) [c](https://h/llms.txt)", "https://h.example/llms.txt"))) == ["https://h/a.md", "https://h.example/b.md"]
    assert urls(discover.rss(responses(spark, "<link>https://c/</link><item><link>https://c/1</link></item><item><link><![CDATA[https://c/2]]></link></item>"))) == ["https://c/1", "https://c/2"]
    kids = responses(spark, "<sitemapindex><loc>https://a/docs.xml</loc><loc>https://a/blog.xml</loc>")
    assert urls(discover.child_sitemaps(kids, "/(docs|api)/")) == ["https://a/docs.xml"]
    assert len(urls(discover.child_sitemaps(kids, "/(q1|q2)/"))) == 2
    lists = responses(spark, "https://a/docs/llms.txt https://a/blog/llms.txt", "https://a/llms.txt")
    assert urls(discover.llms_index(lists, "/(docs|api)/")) == ["https://a/docs/llms.txt"] and not urls(discover.llms_index(lists, "/(q1|q2)/"))
    assert urls(discover.mediawiki(responses(spark, '{"query":{"allpages":[{"title":"A b"},{"title":"C"}]}}'), "https://w/")) == ["https://w/A_b", "https://w/C"]
    assert urls(discover.discover("unknown", kids)) == []


def test_repeated_links_keep_their_first_places(spark):
    body = "https://h/a.md https://h/llms.txt https://h/a.md https://h/b.md [r](/r.md) [r](/r.md) [s](/s.md)"
    found = {r.url: r.ord for r in discover.llms_txt(responses(spark, body, "https://h/llms.txt")).collect()}
    assert found == {"https://h/a.md": 0, "https://h/b.md": 2, "https://h/r.md": 3, "https://h/s.md": 5}
    lists = responses(spark, "https://a/x/llms.txt https://a/x/llms.txt https://a/y/llms.txt", "https://a/llms.txt")
    assert {r.url: r.ord for r in discover.llms_index(lists).collect()} == {"https://a/x/llms.txt": 0, "https://a/y/llms.txt": 2}


def test_llms_links_with_repeated_urls_are_as_in_sql(spark, tmp_path):
    import duckdb

    from sheaf.plans.document_queries import QUERIES, SQL

    rows = [(i, f"https://h{i % 2}.example/en/{i // 2 % 7}") for i in range(230)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, QUERIES["llms_links"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert found == sorted(con.execute(SQL["llms_links"]).fetchall())


@pytest.mark.parametrize("name", ["html_to_markdown", "normalise_pages"])
def test_pages_reach_the_converter_a_few_mb_at_a_time(spark, tmp_path, name):
    from sheaf.plans.document_queries import QUERIES

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.createDataFrame([(1, "https://h/en/1", "<p>a</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    try:
        for given, used in ((64 << 20, 2 << 20), (1 << 20, 1 << 20)):
            spark.conf.set(setting, str(given))
            rows = QUERIES[name](spark, str(tmp_path))
            assert [r.content for r in rows.collect()] == ["a"] and int(spark.conf.get(setting).rstrip("bB")) == used
    finally:
        spark.conf.set(setting, before)


def test_plan_urls(spark):
    rows = spark.createDataFrame([("s", u, i) for i, u in enumerate(["https://h/a/", "https://h/a", "https://h/blog/b", "https://o/c"])], "source string, url string, ord int")
    assert urls(discover.plan_urls(rows, "https://h/", "blog", ".md")) == ["https://h/a.md"]
    sources = spark.createDataFrame([("s",), ("t",)], "source string")
    assert [r.source for r in discover.require_some(rows, sources).collect()] == ["t"]


def pages(df):
    return {r.path: r.content for r in df.collect()}


def bundle(spark, text):
    return spark.createDataFrame([("s", "https://h/docs", text)], "source string, base_url string, content string")


def test_splitters(spark):
    dash = "-" * 12
    meta = f'{dash}\ntitle: "A"\nsource: "https://h/docs"\n{dash}\nbody a\n{dash}\ntitle: "B"\nsource: "https://h/docs/b/"\n{dash}\n# Own\nbody b\n'
    assert pages(split.split(bundle(spark, meta))) == {"index.md": "# A\n\nbody a", "b.md": "# Own\nbody b"}
    front = "---\ntitle: A\n---\nx\n\n---\n\nrule\n---\ntitle: 'B b'\n---\ny\n---\ntitle: C\n---\n\n---\ntitle: A\n---\nz\n"
    assert pages(split.frontmatter_split(bundle(spark, front))) == {"a.md": "x\n\n---\n\nrule", "b-b.md": "y", "a-3.md": "z"}
    head = "intro\n# A\nx\n## sub\n# B\n\n# A\ny\n"
    assert pages(split.heading_split(bundle(spark, head))) == {"a.md": "# A\n\nx\n## sub", "a-1.md": "# A\n\ny"}
    assert pages(split.split(bundle(spark, head))) == pages(split.heading_split(bundle(spark, head)))
    assert pages(split.split(bundle(spark, "no pages at all"))) == {}


SPEC = """
openapi: 3.0.0
info: {title: Shop, description: Sells., version: "2"}
security: [{key: []}]
paths:
  /items/{id}:
    get:
      summary: Get
      tags: [Items]
      deprecated: true
      parameters:
        - {name: id, in: path, required: true, schema: {type: string}, description: the id}
        - {name: c, in: cookie, schema: {type: string}}
      responses:
        "404": {description: none}
        "200": {description: ok, content: {application/json: {schema: {$ref: "#/components/schemas/Item"}}}}
  /items:
    post:
      summary: Add
      requestBody: {content: {application/json: {schema: {type: array, items: {$ref: "#/components/schemas/Item"}}}}}
components:
  schemas:
    Item: {type: object, required: [name], properties: {name: {type: string}, kind: {enum: [a, b]}, parent: {$ref: "#/components/schemas/Item"}}}
"""


def test_openapi(spark):
    rows = spark.createDataFrame([("shop", SPEC), ("bad", "{"), ("none", "{}")], "source string, raw string")
    found = pages(openapi.to_files(rows))
    assert set(found) == {"overview.md", "items.md", "default.md"}
    assert found["overview.md"] == "# Shop\n\nSells.\n\nVersion: 2\n\n- Items: 1 operations\n- default: 1 operations"
    items = found["items.md"]
    assert "**Deprecated**" in items and "- `id` (path, string, required): the id" in items and "cookie" not in items and "Auth: key" in items
    assert items.index("`200`: ok → `{ name: string, kind?: \"a\" | \"b\", parent?: object }`") < items.index("`404`")
    assert "Body: `{ name: string" in found["default.md"]
    assert {r.source for r in openapi.unread(rows).collect()} == {"bad", "none"}


def test_file_sources(spark, tmp_path):
    import tarfile

    (tmp_path / "in/root/sub").mkdir(parents=True)
    for name, text in (("root/a.md", "A"), ("root/sub/b c.mdx", "B"), ("root/LICENSE.md", "L"), ("root/x.json", "{}")):
        (tmp_path / "in" / name).write_text(text)
    rows = S.scan_directory(spark, str(tmp_path / "in"), "s")
    assert {r.path for r in rows.collect()} == {"root/a.md", "root/sub/b c.mdx"}
    assert {r.path for r in S.strip_root(rows, "root").collect()} == {"a.md", "sub/b c.mdx"}
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "in/root", "pkg-1")
    assert {(r.path, r.content) for r in S.scan_tarballs(spark, str(tmp_path / "t.tar.gz"), "s").collect()} == {("a.md", "A"), ("sub/b c.mdx", "B")}


def test_responses_and_retry(spark):
    rows = spark.createDataFrame([("s", "https://h/a", 200, "x", 1), ("s", "https://h/b", 503, None, 2), ("s", "https://h/c", 404, "no", 3), ("s", "https://h/d", None, None, 4)], "source string, url string, status int, body string, ord long")
    good, bad = S.from_responses(rows, "https://h")
    assert [r.path for r in good.collect()] == ["a.md"] and bad.count() == 3
    assert {r.url[-1] for r in rows.where(S.should_retry(0)).collect()} == {"b", "d"} and rows.where(S.should_retry(2)).count() == 0
    waits = spark.createDataFrame([("7",), ("9999",), ("Wed, 21 Oct 2015 07:28:00 GMT",), (None,)], "after string").select(S.retry_delay(1, "after").alias("s"))
    assert [r.s for r in waits.collect()] == [7.0, 300.0, 0.0, 2.0]


def test_titles_with_quotes_inside_are_none(spark):
    texts = ['---\ntitle: "A "b" c"\n---\nx', "---\ntitle: 'Plain'\n---\nx", "---\ntitle: It's\n---\nx", "---\ntitle:\nnext: y\n---\nx", '---\nkind: z\ntitle: "Quoted \n---\nx']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.mdx_title("t").alias("t")).collect()
    assert [r.t for r in got] == ["", "Plain", "", "next: y", "Quoted"]


def test_traces_hold_for_every_pattern(spark):
    """Texts with what each pattern removes, in other letters' company, are cleaned as pattern after pattern would."""
    samples = [
        "[Skip to content](#x) a", "Was this helpful?\nYesNo b", "[ Edit page ](u)", "[Report issue](u)", "[Copy page ](u)", "Copy page \n", '```json\n {"@type": "BreadcrumbList"}\n```', '{"@type":"BreadcrumbList"} ', 'Retrieved from "[https://wiki.x" ', "a - PostgreSQL wiki ",
        "b| Docker Docs", "Submit correction", "If you see anything in the documentation that is not correct\nx documentation issue.", "Navigation menu", "Page actions", "Page action", "Personal tools", "Jump to navigation", "Jump to search", "Toolbox", "In other languages",
        ".a{b}", ".a {\nb\n}\n", "@media {\n}\n", "```\n.a{b}\n```", "plain", "", "é\x85.x{}",
    ]
    texts = [*samples, *(f"{a}\n{b}\n\n\n\n{c}" for a, b, c in zip(samples, samples[3:], samples[7:], strict=False))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.col("t")
    for pattern in N.BOILERPLATE:
        whole = N.replace(whole, pattern)
    whole = N.strip_css(whole)
    for pattern in N.SITE_CHROME:
        whole = N.replace(whole, pattern)
    rows = df.select(N.clean_markdown("t").alias("a"), N.trim(N.collapse_blank(whole)).alias("b"), "t").collect()
    assert [r.t for r in rows if r.a != r.b] == []
    assert all(any(df.where(F.col("t").rlike(trace) & F.col("t").rlike(p)).count() for trace in N.TRACES) for p in (*N.BOILERPLATE, *N.SITE_CHROME))


def test_pages_as_markdown():
    cases = {
        "<pre><code class='x language-sql'>SELECT 1;\n\n  x\n</code></pre>": "```sql\nSELECT 1;\n\n  x\n```", "<pre><code>a\n```\nb</code></pre>": "````\na\n```\nb\n````",
        "<p>a <b> b </b>c<i>d</i></p><p>x<br>y</p><hr>": "a **b** c_d_\n\nx  \ny\n\n* * *", "<blockquote><p>q</p><p>r</p></blockquote>": "> q\n> \n> r", "<h3>A <code>b`c</code></h3>": "### A ``b`c``",
        "<ul><li><p>one</p></li><li>two <a href='/u(1)' title='t\"q'>l</a></li></ul>": '-   one\n-   two [l](/u\\(1\\) "t\\"q")', "<ol start='3'><li>x</li>\n<li>y</li></ol>": "3.  x\n4.  y",
        "<p>1. x_y *z* [k] \\</p><p># no</p><p>- d</p>": "1\\. x\\_y \\*z\\* \\[k\\] \\\\\n\n\\# no\n\n\\- d", "<table><tr><th>A<td>B<tr><td>C</table>": "A\n\nB\n\nC", "<p>one<p>two<div>three": "one\n\ntwo\n\nthree",
        "<p>  a\n b  <span> c </span>  d</p>": "a b c d", "<em> </em><p></p><a></a>": "", "<img src='s' alt='a' title='t'><img>": '![a](s "t")', "&lt;b&gt; &amp; &eacute;": "<b> & é", "<p>a</b></p></div>b": "a\n\nb", "": "", "plain": "plain",
    }
    for html, want in cases.items():
        assert markdown(html) == want, html
    assert markdown("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep" and markdown("<ul><li>" * 100 + "x").endswith("x")


def test_normalised_pages(spark):
    """What the normaliser makes of whole pages: noise and site names go, the main part stays, titles aren't repeated."""
    shell = "<!DOCTYPE html><html><body><div hidden></div><script>" + "x" * 1300 + "</script></body></html>"
    cases = {
        "<nav><a href='/'>Home</a></nav><main><h1>Content</h1></main><script>alert(1)</script>": "# Content", "<header><h1>Site</h1></header><main><h2>Real</h2><p>Body.</p></main><footer>(c)</footer>": "## Real\n\nBody.",
        "<style>.red { color: red; }</style><h1>Styled</h1>": "# Styled", "<nav>N</nav><article><h1>Only</h1><p>C.</p></article><footer>F</footer>": "# Only\n\nC.", "<main class='c' id='m'><h1>Main</h1></main>": "# Main",
        "<html><head><title>Replication | wiki</title></head><body><p>About it.</p></body></html>": "# Replication\n\nAbout it.", "<html><head><title>Guide</title></head><body><h1>Guide</h1><p>C.</p></body></html>": "# Guide\n\nC.",
        "<title>Self-hosted - Site</title>": "# Self-hosted\n\nSelf-hosted - Site", shell: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", N.convert_html("t").alias("m")).collect()
    assert {r.i: r.m for r in rows} == dict(enumerate(cases.values()))
