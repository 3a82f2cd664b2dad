"""The search index: a title and a short summary for each markdown file, by one fold over its lines and without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import col, lines_of, replace

QUOTES = r"""\A["']|["']\z"""


def is_fence(line: Column) -> Column:
    return line.startswith("```") | line.startswith("~~~")


def heading_text(line: Column) -> Column:
    return replace(line, r"\A#+ *")


def _value(line: Column, name: str) -> Column:
    return replace(replace(line, rf"\A{name}: *"), QUOTES)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once per row: expressions aren't merged over a generator, and no filter moves below it."""
    packed = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    return df.select("*", packed).select("*", *[F.col(f"__once.{name}").alias(name) for name in columns]).drop("__once")


def frontmatter_marks(lines: Column) -> dict[str, Column]:
    """Whether the first line opens frontmatter, and the numbers of the line that ends it and of the first ## heading (0: none)."""
    ends = F.transform(lines, lambda x, i: (i > 0) & x.rlike(r"\A---[ \t]*\z"))
    aborts = F.transform(lines, lambda x: x.startswith("## "))
    opened = F.coalesce(F.try_element_at(lines, F.lit(1)).rlike(r"\A---[ \t]*\z"), F.lit(False))
    return {"opened": opened, "end": F.when(opened, F.array_position(ends, True)).otherwise(0), "abort": F.when(opened, F.array_position(aborts, True)).otherwise(0)}


def frontmatter_fields(inner: Column) -> Column:
    """Struct of title and about (the description) of frontmatter lines."""
    start = F.struct(F.lit("").alias("title"), F.lit("").alias("about"), F.lit(False).alias("folded"))

    def step(acc: Column, line: Column) -> Column:
        next_line = acc["folded"] & line.startswith("  ")
        title, about, one = _value(line, "title"), _value(line, "description"), _value(line, "oneline")
        title = replace(title, r"\A`|`\z")
        indented = replace(line, r"\A +")
        is_title, is_about, is_one = (~next_line & line.startswith(x) for x in ("title:", "description:", "oneline:"))
        marker = about.rlike(r"\A[>|]-?\z")
        new_about = (
            F.when(next_line & (indented != "") & (acc["about"] == ""), F.substring(indented, 1, 300))
            .when(is_about & ~marker & (about != ""), F.substring(about, 1, 300))
            .when(is_one & (one != "") & (acc["about"] == ""), F.substring(one, 1, 300))
            .otherwise(acc["about"])
        )
        return F.struct(F.when(is_title & (title != ""), F.substring(title, 1, 200)).otherwise(acc["title"]).alias("title"), new_about.alias("about"), (is_about & marker).alias("folded"))

    return F.aggregate(inner, start, step)


def outline_of(lines: Column) -> Column:
    """Struct of the first heading, the first five headings (a space before each) and the first line of prose, outside of fences."""
    start = F.struct(F.lit(False).alias("fence"), F.lit("").alias("title"), F.lit("").alias("heads"), F.lit(0).alias("n"), F.lit("").alias("prose"))

    def step(acc: Column, line: Column) -> Column:
        mark = is_fence(line)
        free = ~mark & ~acc["fence"]
        head = free & line.startswith("#")
        prose = free & (acc["prose"] == "") & line.rlike(r"\A[^#`\-|<>!\[]") & line.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
        return F.struct(
            (acc["fence"] != mark).alias("fence"),
            F.when(head & (acc["title"] == ""), F.substring(heading_text(line), 1, 200)).otherwise(acc["title"]).alias("title"),
            F.when(head & (acc["n"] < 5), F.concat(acc["heads"], F.lit(" "), heading_text(line))).otherwise(acc["heads"]).alias("heads"),
            (acc["n"] + F.when(head & (acc["n"] < 5), 1).otherwise(0)).alias("n"),
            F.when(prose, F.substring(line, 1, 200)).otherwise(acc["prose"]).alias("prose"),
        )

    return F.aggregate(lines, start, step)


def index_text(text: Column) -> Column:
    text = replace(text, r"\x1b\[[0-9;]*[A-Za-z]")
    return replace(replace(text, r"\t", " "), r"[\x01-\x08\x0b-\x1f\x7f]")


def build_index(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, title, summary) of each .md file that isn't empty."""
    rows = once(files.where(F.col("path").endswith(".md") & (F.col("content") != "")).select("path", "content"), lines=lines_of("content")).drop("content")
    rows = once(rows, **frontmatter_marks(F.col("lines")))
    cut = (F.col("abort") > 0) & ((F.col("end") == 0) | (F.col("abort") < F.col("end")))
    # a block that neither ends nor is cut off takes all lines and gives no field
    size = F.when(~F.col("opened"), 0).when(cut, F.col("abort") - 1).when(F.col("end") > 0, F.col("end")).otherwise(F.size("lines")).cast("int")
    rows = once(rows, size=size, inner=F.when(cut | (F.col("end") > 0), F.greatest(F.lit(0), size - F.when(cut, 1).otherwise(2))).otherwise(0))
    body = F.slice("lines", F.col("size") + 1, F.greatest(F.lit(0), F.size("lines") - F.col("size")))
    rows = once(rows, fm=frontmatter_fields(F.slice("lines", F.lit(2), F.col("inner"))), o=outline_of(body))
    title = F.when(F.col("fm.title") != "", F.col("fm.title")).when(F.col("o.title") != "", F.col("o.title")).otherwise(F.col("o.prose"))
    about, heads = F.col("fm.about"), F.col("o.heads")
    more = F.when((F.length(about) < 200) & (heads != ""), F.concat(F.lit(" "), F.substring(heads, F.lit(1), F.lit(300) - F.length(about)))).otherwise("")
    summary = F.when(about != "", F.concat(about, more)).otherwise(F.concat(F.substring(heads, 1, 300), F.lit(" "), F.substring(F.col("o.prose"), 1, 200)))
    return once(rows.select("path", "fm", "o"), title=index_text(title), summary=index_text(summary)).select("path", "title", "summary")


def write_index(index: DataFrame, path: str) -> None:
    """The index as lines of tab-separated path, title and summary, which hold neither tabs nor line breaks, in order of path."""
    index.orderBy("path").select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in ("path", "title", "summary")))).write.mode("overwrite").text(path)
