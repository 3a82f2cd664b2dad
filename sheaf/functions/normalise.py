"""Normalisers: MDX, HTML and markdown to clean markdown, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.html_md import html_to_markdown
from sheaf.functions.text import bind, collapse_blank, col, extension, lines_of, replace, sanitise_content, sanitise_path, trim

GUARD_LENGTH, GUARD_SHARE = 1000, 0.01

# --- MDX. The patterns that say what is stripped, here and in the sections below.
FRONTMATTER = r"\A---[\s\S]*?---\n?"
IMPORTS = (r"(?md)^import\s+\{[^}]*\}\s+from\s+[^\n]+(?:\n|\z)", r"(?md)^import\s+.*?(?:\n|\z)")
EXPORTS = (r"(?md)^export\s+default\s+function[^{]*\{[\s\S]*?^\}", r"(?md)^export\s+.*?(?:\n|\z)")
SELF_CLOSING = r"<[A-Z][A-Za-z0-9]*[^>]*/>"
LABELLED = r"""<[A-Z][A-Za-z0-9]*\b[^>]*?\b(?:label|title)\s*=\s*["']([^"']+)["'][^>]*>"""
OTHER_TAGS = r"</?[A-Z][A-Za-z0-9]*[^>]*>"


def with_title(title: Column, body: Column) -> Column:
    """body, with the title as its first heading if it has one and the body doesn't begin with a heading."""
    return F.when((title != "") & ~replace(body, r"\A\s+").startswith("# "), F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)


def mdx_title(text: Column | str) -> Column:
    head = F.regexp_extract(col(text), r"\A---\n([\s\S]*?)\n---", 1)
    return trim(F.regexp_extract(head, r"""(?md)^title:\s*["']?([^"'\n]+)["']?\s*$""", 1))


def mdx_to_markdown(text: Column | str) -> Column:
    """Markdown of an MDX text: its title as heading, no imports, exports or components; labels of components become headings."""
    body = with_title(mdx_title(text), replace(text, FRONTMATTER))
    for pattern in (*IMPORTS, *EXPORTS, SELF_CLOSING):
        body = replace(body, pattern)
    body = replace(replace(body, LABELLED, "\n\n### $1\n\n"), OTHER_TAGS)
    return trim(collapse_blank(body))


# --- HTML
NOISE = tuple(rf"(?i)<{tag}[\s\S]*?</{tag}>" for tag in ("head", "nav", "header", "footer", "script", "style"))
FOCUS = r"(?i)<(?:main|article)[^>]*>([\s\S]*?)</(?:main|article)>"


def html_title(html: Column | str) -> Column:
    """The page title without the site's name behind a bar or dash; empty if there is none."""
    title = F.regexp_extract(col(html), r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return trim(replace(replace(title, r"(?d)\s*(?:\||–|—)\s.*\z"), r"(?d)\s+-\s+.*\z"))


def html_strip(html: Column | str) -> Column:
    out = col(html)
    for pattern in NOISE:
        out = replace(out, pattern)
    return out


def html_focus(html: Column | str) -> Column:
    """The content of the first main or article element; all of the text if there is none."""
    return F.when(col(html).rlike(FOCUS), F.regexp_extract(col(html), FOCUS, 1)).otherwise(col(html))


def convert_html(html: Column | str) -> Column:
    """Markdown of a page; null where the safety guard refuses it: a long page of which next to nothing is left."""
    html = col(html)
    markdown = with_title(html_title(html), html_to_markdown(html_focus(html_strip(html))))
    return F.when(guard_refuses(F.length(html), F.length(markdown)), F.lit(None)).otherwise(markdown)


def guard_refuses(before: Column, after: Column) -> Column:
    return (before > GUARD_LENGTH) & (after < before * GUARD_SHARE)


# --- markdown
#: Pattern and replacement of each cleaning step. The boilerplate of documentation sites.
BOILERPLATE = (
    r"\[Skip to content\]\([^)]*\)\s*",
    r"Was this helpful\?\s*\n*YesNo\s*",
    r"\[\s*(?:Edit page|Report issue|Copy page)\s*\]\s*\([^)]*\)\s*",
    r"(?md)^Copy page\s*$",
    r'```json\s*\n\s*\{[^`]*"@type"\s*:\s*"BreadcrumbList"[^`]*\}\s*\n\s*```',
    r'(?md)^\{[^}]*"@type"\s*:\s*"BreadcrumbList"[^}]*\}\s*$',
)
SITE_CHROME = (
    r'(?md)^Retrieved from "\[?https?://wiki\.[^"]*"?\]?\s*$',
    r"(?md) - PostgreSQL wiki\s*$",
    r"(?md)\| Docker Docs\s*$",
    r"(?md)^Submit correction\s*$",
    r"(?md)^If you see anything in the documentation that is not correct[\s\S]*?documentation issue\.\s*$",
    r"(?md)^(?:Navigation menu|Page actions?|Personal tools|Jump to navigation|Jump to search|Toolbox|In other languages)\s*$",
)
CSS_LINE, CSS_OPEN = r"\A[.#@][\w-]+[^{]*\{[^}]*\}\s*\z", r"\A[.#@][\w-][^{]*\{\s*\z"


def strip_css(text: Column | str) -> Column:
    """Text without style rules on lines of their own, but for those in fenced code.

    One fold over the lines that look like something (fences, rule beginnings and ends) finds the dropped ranges; what stands between them stays.
    """
    lines = F.split(col(text), "\n", -1)
    kind = lambda x: F.when(x.startswith("```") | x.startswith("~~~"), "f").when(x.rlike(CSS_LINE), "l").when(x.rlike(CSS_OPEN), "o").when(x.rlike(r"\A\s*\}"), "c")
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), kind(x).alias("k"))), lambda m: m["k"].isNotNull())
    start = F.struct(F.lit(False).alias("fence"), F.lit(-1).alias("rule"), F.array().cast("array<struct<a:int,b:int>>").alias("gone"))
    one = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def step(acc: Column, m: Column) -> Column:
        fence, open_, i = m["k"] == "f", acc["rule"] >= 0, m["i"]
        # a fence ends a rule, whose lines up to there are gone; within a rule the first closing brace does
        ends = open_ & (fence | (~acc["fence"] & (m["k"] == "c")))
        whole = ~fence & ~acc["fence"] & ~open_ & (m["k"] == "l")
        rule = F.when(ends, F.lit(-1)).when(~fence & ~acc["fence"] & ~open_ & (m["k"] == "o"), i).otherwise(acc["rule"])
        gone = F.when(ends, F.array_append(acc["gone"], one(acc["rule"], i - fence.cast("int")))).when(whole, F.array_append(acc["gone"], one(i, i))).otherwise(acc["gone"])
        return F.struct((acc["fence"] != fence).alias("fence"), rule.alias("rule"), gone.alias("gone"))

    def finish(acc: Column) -> Column:
        return F.when(acc["rule"] >= 0, F.array_append(acc["gone"], one(acc["rule"], F.size(lines)))).otherwise(acc["gone"])

    def kept(x: Column) -> Column:
        # what stands before, between and behind the dropped ranges
        begin = lambda k: F.when(k == 0, 0).otherwise(F.get(x["gone"], k - 1)["b"] + 1)
        end = lambda k: F.coalesce(F.get(x["gone"], k)["a"], F.size(x["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda k: F.slice(x["lines"], begin(k) + 1, F.greatest(F.lit(0), end(k) - begin(k)))))

    return F.array_join(bind(F.struct(lines.alias("lines"), F.aggregate(marks, start, step, finish).alias("gone")), kept), "\n")


#: What a text must hold for any of these patterns to be found: a text without it needs one pass for all of them.
TRACES = (
    r"Skip to content\]|Was this helpful\?|Edit page|Report issue|Copy page|\"BreadcrumbList\"",
    r"Retrieved from \"| - PostgreSQL wiki|\| Docker Docs|Submit correction|If you see anything in the|Navigation menu|Page action|Personal tools|Jump to |Toolbox|In other languages",
)
CSS_TRACE = r"(?md)^[.#@][\w-]"


def replaced_if(text: Column, trace: str, patterns: tuple[str, ...]) -> Column:
    """text without what the patterns find, one after the other; none of them is tried where the trace isn't found."""
    out = text
    for pattern in patterns:
        out = replace(out, pattern)
    return F.when(text.rlike(trace), out).otherwise(text)


def clean_markdown(text: Column | str, css: bool = True) -> Column:
    out = bind(col(text), lambda t: replaced_if(t, TRACES[0], BOILERPLATE))
    if css:
        out = bind(out, lambda t: F.when(t.rlike(CSS_TRACE), strip_css(t)).otherwise(t))
    out = bind(out, lambda t: replaced_if(t, TRACES[1], SITE_CHROME))
    return trim(collapse_blank(out))


# --- routing
@dataclass(frozen=True)
class Converter:
    """A converter to markdown: its name, the formats of sources and the extensions of files it is for, what it makes of a text (null: it refuses), and the file name's end that becomes .md."""

    name: str
    formats: tuple[str, ...]
    extensions: tuple[str, ...]
    convert: Callable[[Column], Column]
    ending: str

    def takes_format(self, name: Column) -> Column:
        return F.coalesce(name.isin(*self.formats), F.lit(False))

    def takes_file(self, path: Column) -> Column:
        return F.coalesce(extension(path).isin(*self.extensions), F.lit(False))


CONVERTERS = (
    Converter("mdx", ("mdx",), ("mdx",), mdx_to_markdown, r"\.mdx\z"),
    Converter("html", ("html",), ("html",), lambda text: convert_html(text), r"\.html\z"),
)


def route(format_: Column, path: Column, converters: Sequence[Converter] = CONVERTERS) -> Column:
    """The name of the first converter for the source's format, or, without one, of the first for the file's extension; empty without either."""
    name = F.lit("")
    for takes in ("takes_file", "takes_format"):
        of = format_ if takes == "takes_format" else path
        for c in reversed(converters):
            name = F.when(getattr(c, takes)(of), c.name).otherwise(name)
    return name


def normalise(files: DataFrame, converters: Sequence[Converter] = CONVERTERS) -> DataFrame:
    """files(source, format, path, content, ord) -> the normalised files, one for each source and path (the last one wins).

    A file that its converter refuses keeps its text and name. Markdown files, converted ones included, are cleaned; all are sanitised.
    """
    rows = files.withColumn("__kind", route(F.col("format"), F.col("path"), converters))
    made, named = F.lit(None).cast("string"), F.col("path")
    for c in converters:
        own = F.col("__kind") == c.name
        made = F.when(own, c.convert(F.col("content"))).otherwise(made)
        named = F.when(own, replace("path", c.ending, ".md")).otherwise(named)
    rows = rows.withColumn("__made", made)
    rows = rows.withColumns({"content": F.coalesce("__made", "content"), "path": F.when(F.col("__made").isNotNull(), named).otherwise(F.col("path"))})
    rows = rows.withColumn("content", F.when(extension("path") == "md", clean_markdown("content")).otherwise(F.col("content")))
    rows = rows.withColumns({"content": sanitise_content("content"), "path": sanitise_path("path")})
    return rows.groupBy("source", "path").agg(F.max_by("content", "ord").alias("content"))
