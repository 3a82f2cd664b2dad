"""Splitters: one bundled text dump to pages, (source, path, content) rows.

A dump is cut up, numbered and put together within its row by array functions, so nothing is shuffled and dumps are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import bind, col, replace, slugify, trim

MANY_PAGES = 20
DASHES = r"(?md)^-{10,}\s*$"
META_LINE = r'(?md)^{}:\s*"?([^"\n]+)"?\s*$'
#: A dash line, then within ten lines and before a blank one a source: line.
META_STYLE = r"(?md)^-{10,}\s*\n(?:(?!\n\n)[^\n]*\n){0,10}source:\s"


def neighbours(names: Column, step: int) -> Column:
    """For each of an array of names, whether it stands earlier too (step -1), or later (step 1): neighbours after sorting tell."""
    ranked = F.array_sort(F.transform(names, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    same = bind(ranked, lambda r: F.transform(r, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce((j + step >= 0) & (F.get(r, j + step)["s"] == x["s"]), F.lit(False)).alias("same"))))
    return F.transform(F.array_sort(same), lambda x: x["same"])


def named(pages: Column) -> Column:
    """pages(n, title, body) in order -> (path, title, body): the slug of the title, with the page's number n behind it where it came before."""

    def name(z: Column) -> Column:
        slug, n = z["p"]["slug"], z["p"]["n"]
        path = F.when(slug == "", F.format_string("page-%d", n)).when(z["again"], F.format_string("%s-%d", slug, n)).otherwise(slug)
        return F.struct(F.concat(path, F.lit(".md")).alias("path"), z["p"]["title"].alias("title"), z["p"]["body"].alias("body"))

    slugged = F.transform(pages, lambda p: F.struct(p["n"].alias("n"), p["title"].alias("title"), p["body"].alias("body"), slugify(p["title"]).alias("slug")))
    return bind(slugged, lambda p: F.transform(F.arrays_zip(p.alias("p"), neighbours(F.transform(p, lambda x: x["slug"]), -1).alias("again")), name))


def filled(pages: Column) -> Column:
    return F.filter(pages, lambda p: (p["title"] != "") & (p["body"] != ""))


def meta_pages(content: Column | str, base_url: Column | str) -> Column:
    """Pages between dash lines, each behind a block with its title and source; a page that comes again replaces the one before."""
    base = col(base_url)
    field = lambda x, name: F.regexp_extract(x, META_LINE.format(name), 1)
    blocks = F.filter(F.transform(F.split(col(content), DASHES), trim), lambda x: x != "")
    marked = F.transform(blocks, lambda x: F.struct(x.alias("block"), field(x, "title").alias("title"), field(x, "source").alias("link")))
    is_meta = lambda m: (m["title"] != "") & (m["link"] != "")

    def page(z: Column) -> Column:
        head, block = z["before"], z["own"]["block"]
        path = F.when(head["link"].startswith(base), F.substring(head["link"], F.length(base) + 1, F.length(head["link"]))).otherwise(head["link"])
        path = replace(replace(path, r"\A/+"), r"/\z")
        path = F.when(path == "", "index").otherwise(path)
        path = F.when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))
        body = F.when(block.startswith("# "), block).otherwise(F.concat(F.lit("# "), head["title"], F.lit("\n\n"), block))
        return F.struct(path.alias("path"), body.alias("content"))

    pairs = bind(marked, lambda m: F.transform(m, lambda x, i: F.struct(x.alias("own"), F.get(m, i - 1).alias("before"))))
    pages = F.transform(F.filter(pairs, lambda z: ~is_meta(z["own"]) & F.coalesce(is_meta(z["before"]), F.lit(False))), page)
    last = bind(pages, lambda p: F.filter(F.arrays_zip(p.alias("p"), neighbours(F.transform(p, lambda x: x["path"]), 1).alias("again")), lambda z: ~z["again"]))
    return F.transform(last, lambda z: z["p"])


def heading_pages(content: Column | str) -> Column:
    """A page for each first-level heading; text before the first one is dropped. A repeated title gets the number of pages before it behind its name."""
    sections = F.split(F.concat(F.lit("\n"), col(content)), "\n(?=# [^\n])")
    cut = F.transform(F.slice(sections, 2, 1 << 30), lambda x: F.struct(trim(F.regexp_extract(x, r"\A# ([^\n]+)", 1)).alias("title"), trim(replace(x, r"\A# [^\n]+\n?")).alias("body")))
    numbered = F.transform(filled(cut), lambda p, n: F.struct(n.alias("n"), p["title"].alias("title"), p["body"].alias("body")))
    return F.transform(named(numbered), lambda p: F.struct(p["path"].alias("path"), F.concat(F.lit("# "), p["title"], F.lit("\n\n"), p["body"]).alias("content")))


def frontmatter_pages(content: Column | str) -> Column:
    """A page for each frontmatter block with a title. A repeated title gets the page's number behind its name.

    A piece between two --- marks with a title: line is metadata, unless its first mark already closed another one: of neighbouring
    candidates every other one counts. Any other mark is a rule within the text.
    """
    pieces = F.split(F.concat(F.lit("\n"), col(content), F.lit("\n")), r"(?<=\n)---[ \t\r]*(?=\n)", -1)
    title = lambda x: F.regexp_extract(x, r"(?md)^title:[ \t]*([^\n]+)$", 1)

    def pages(z: Column) -> Column:
        of = lambda at: F.get(z["text"], at)
        end = lambda j: F.coalesce(F.get(z["metas"], j + 1), F.size(z["text"]))
        body = lambda at, j: trim(F.array_join(F.slice(z["text"], at + 2, end(j) - at - 1), "---"))
        return F.transform(z["metas"], lambda at, j: F.struct(j.alias("n"), trim(replace(title(of(at)), r"""\A["']|["']\z""")).alias("title"), body(at, j).alias("body")))

    # a letter for each piece, t for those with a title; of t's in a row the first, third, ... stand for metadata
    letters = bind(pieces, lambda t: F.array_join(F.transform(t, lambda x, i: F.when((i > 0) & (i < F.size(t) - 1) & (title(x) != ""), "t").otherwise("-")), ""))
    kinds = F.split(F.regexp_replace(F.regexp_replace(letters, "tt", "mx"), "t", "m"), "")
    metas = F.filter(F.transform(kinds, lambda k, i: F.when(k == "m", i)), lambda i: i.isNotNull())
    both = F.struct(pieces.alias("text"), metas.alias("metas"))
    return F.transform(named(filled(bind(both, pages))), lambda p: F.struct(p["path"].alias("path"), p["body"].alias("content")))


def rows_of(bundles: DataFrame, pages: Column) -> DataFrame:
    return bundles.select("source", F.inline(pages)).select("source", "path", "content")


def meta_split(bundles: DataFrame) -> DataFrame:
    """bundles(source, base_url, content) -> the pages of meta_pages()."""
    return rows_of(bundles, meta_pages("content", "base_url"))


def heading_split(bundles: DataFrame) -> DataFrame:
    """bundles(source, content) -> the pages of heading_pages()."""
    return rows_of(bundles, heading_pages("content"))


def frontmatter_split(bundles: DataFrame) -> DataFrame:
    """bundles(source, content) -> the pages of frontmatter_pages()."""
    return rows_of(bundles, frontmatter_pages("content"))


def split(bundles: DataFrame) -> DataFrame:
    """bundles(source, base_url, content): pages by each dump's own layout.

    Dash lines with metadata decide first; then frontmatter if that gives many pages; then whichever of headings and frontmatter gives more.
    """
    meta = F.col("content").rlike(META_STYLE)
    other = bind(F.struct(frontmatter_pages("content").alias("f"), heading_pages("content").alias("h")), lambda z: F.when((F.size(z["f"]) <= MANY_PAGES) & (F.size(z["h"]) > F.size(z["f"])), z["h"]).otherwise(z["f"]))
    return rows_of(bundles, F.when(meta, meta_pages("content", "base_url")).otherwise(other))


def llms_full(responses: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """responses(source, url, body) of full-text dumps -> (source, path, content): split by their layout, filtered by path. Null bodies give nothing."""
    found = split(responses.where("body IS NOT NULL").select("source", F.col("url").alias("base_url"), F.col("body").alias("content")))
    if include:
        found = found.where(F.col("path").rlike(include))
    return found.where(~F.col("path").rlike(exclude)) if exclude else found
