"""Retrieval: search, grep, find, outline, read, source counts. Every limit follows an explicit order: (path, line)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import OUTPUT_CAP, basename, cap_output, glob_to_regex, lines_of, run_bases, running_total
from sheaf.operators.firsts import first_and_total
from sheaf.operators.index import once


def matches(text: Column, query: str) -> Column:
    """Case-insensitive regular expression search, in any script."""
    return text.rlike(f"(?iu){query}")


def of_source(path: Column, source: str | None) -> Column:
    return F.lit(True) if source is None else path.startswith(f"{source}/")


def lines(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, ln, line), ln from 1."""
    return files.select("path", F.posexplode(lines_of("content")).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)


def search_index(index: DataFrame, query: str, source: str | None = None, most: int = 15) -> DataFrame:
    """Rows of the index that match, in order of path, with the number of all that do."""
    hit = matches(F.concat_ws("\t", "path", "title", "summary"), query) & of_source(F.col("path"), source)
    return first_and_total(index.where(hit), ["path", "title", "summary"], most)


def search_files(files: DataFrame, query: str, source: str | None = None, most: int = 15, within: DataFrame | None = None) -> DataFrame:
    """Where the index has nothing: files whose name holds the query, then files whose text matches it.

    `within`: the files in which alone a text can match (TextStore.matching); then only the names of the others are read.
    """
    by_name = F.contains(F.lower(basename("path")), F.lit(query.lower()))
    text = matches(F.col("content"), query)
    if within is None:
        found = files.where(of_source(F.col("path"), source)).select("path", F.when(by_name, 0).when(text, 1).alias("rank")).where("rank IS NOT NULL")
    else:
        named, texts = (df.where(of_source(F.col("path"), source)) for df in (files, within))
        found = named.where(by_name).select("path", F.lit(0).alias("rank")).unionByName(texts.where(text).select("path", F.lit(1).alias("rank")))
    return found.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").limit(most)


def search(index: DataFrame, files: DataFrame, query: str, source: str | None = None, most: int = 15) -> DataFrame:
    """(path, title, summary, via): hits of the index, or of names and texts if the index has none."""
    direct = search_index(index, query, source, most).select("path", "title", "summary", F.lit("index").alias("via"))
    none = F.lit(None).cast("string")
    other = search_files(files, query, source, most).select("path", none.alias("title"), none.alias("summary"), F.when(F.col("rank") == 0, "name").otherwise("content").alias("via"))
    # 2 * most rows at most stand in one task here
    rows = direct.unionByName(other).withColumn("__any", F.max(F.col("via") == "index").over(Window.partitionBy(F.lit(0))))
    return rows.where((F.col("via") == "index") | ~F.col("__any")).drop("__any")


def hit_lines(files: DataFrame, query: str, context: int = 0) -> DataFrame:
    """(path, ln, line, hit): lines that match and `context` lines around each, found within the row of a file."""
    if not context:
        return lines(files).withColumn("hit", matches(F.col("line"), query)).where("hit")
    rows = once(files.select("path", "content"), lines=lines_of("content")).drop("content")
    rows = once(rows, hits=F.transform("lines", lambda x: matches(x, query)))
    at = F.filter(F.transform("hits", lambda hit, k: F.when(hit, k)), lambda k: k.isNotNull())
    around = F.flatten(F.transform(at, lambda k: F.sequence(F.greatest(k - context, F.lit(0)), F.least(k + context, F.size("lines") - 1))))
    rows = once(rows.where(F.exists("hits", lambda x: x)), near=F.array_distinct(around))
    return rows.select("path", F.inline(F.transform("near", lambda k: F.struct((k + 1).alias("ln"), F.get("lines", k).alias("line"), F.get("hits", k).alias("hit")))))


def grep(files: DataFrame, query: str, context: int = 0, most: int = 500) -> DataFrame:
    """(path, ln, line, hit): the first `most` matching lines, or these and `context` lines around each."""
    return hit_lines(files, query, context).orderBy("path", "ln").limit(most)


def submatches(files: DataFrame, query: str) -> DataFrame:
    """(path, ln, at, begin, end, text): a row for each match within a line, begin and end in characters from 0.

    Matches of a line are numbered from its end, the order in which marks are put in: what is marked later doesn't move what comes before.
    """
    hits = lines(files).where(matches(F.col("line"), query))
    pattern = F.lit(f"(?iu){query}")
    # what stands between the matches, and the matches, in turn: their lengths add up to the offsets
    found = F.filter(F.regexp_extract_all("line", pattern, F.lit(0)), lambda x: x != "")
    rows = once(hits.select("path", "ln", "line"), parts=F.transform(F.split(F.col("line"), f"(?iu){query}", -1), F.length), found=found).drop("line")
    rows = once(rows, steps=F.transform("found", lambda x, k: F.get("parts", k) + F.when(k > 0, F.length(F.get("found", k - 1))).otherwise(0)))
    rows = once(rows, bases=run_bases(F.col("steps")))
    begin = lambda k: running_total(F.col("steps"), F.col("bases"), k + 1).cast("int")
    rows = rows.select("path", "ln", F.inline(F.transform("found", lambda x, k: F.struct((F.size("found") - k).alias("at"), begin(k).alias("begin"), x.alias("text")))))
    return rows.select("path", "ln", "at", "begin", (F.col("begin") + F.length("text")).alias("end"), "text")


def grep_text(files: DataFrame, query: str, path: str, most: int = 500, cap: int = OUTPUT_CAP) -> DataFrame:
    """One row, text: how many lines match and the first `most` of them below the names of their files, as a reader gets them; one pass over the files."""
    shown = first_and_total(hit_lines(files, query).select("path", "ln", "line"), ["path", "ln"], most)
    # `most` lines at most
    row = F.struct("path", "ln", F.format_string("  %d: %s", "ln", highlight(F.col("line"), query)).alias("text"))
    one = shown.agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("total").alias("total"))
    lead = lambda r, k: F.when(k == 0, F.concat(r["path"], F.lit("\n"))).when(F.get("rows", k - 1)["path"] != r["path"], F.concat(F.lit("\n"), r["path"], F.lit("\n"))).otherwise("")
    body = F.array_join(F.transform("rows", lambda r, k: F.concat(lead(r, k), r["text"])), "\n")
    n = F.size("rows").cast("string")
    note = F.when(F.col("total") > F.size("rows"), F.concat(F.lit(" (showing "), n, F.lit(" of "), F.col("total").cast("string"), F.lit(")"))).otherwise("")
    none = f'[no matches for "{query}" in {path}]'
    return one.select(F.when(F.size("rows") == 0, none).otherwise(cap_output(F.concat(n, note, F.lit(" matches\n\n"), body), F.lit(path), cap)).alias("text"))


def grep_report(files: DataFrame, query: str, most: int = 500) -> DataFrame:
    """One row: shown, total, and the text of the first `most` matching lines, with how many of all they are if not all."""
    total = count_matches(files, query).select(F.col("n_lines").alias("total"))
    texts = format_matches(grep(files, query, most=most), query)
    # at most `most` lines
    shown = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    some = F.least(F.col("total"), F.lit(most))
    note = F.when(F.col("total") > most, F.concat(F.lit("\n\nshowing "), some.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" matches"))).otherwise("")
    return total.join(shown, how="cross").select(some.alias("shown"), "total", F.when(F.col("total") == 0, "no matches").otherwise(F.concat("body", note)).alias("text"))


def highlight(line: Column, query: str) -> Column:
    return F.regexp_replace(line, f"(?iu)({query})", "**$1**")


def count_matches(files: DataFrame, query: str) -> DataFrame:
    """Matching lines and files that have some."""
    return lines(files).where(matches(F.col("line"), query)).agg(F.count("*").alias("n_lines"), F.count_distinct("path").alias("n_files"))


def format_matches(hits: DataFrame, query: str) -> DataFrame:
    """hits(path, ln, line) -> (path, text): the lines of a file below its name, hits marked. Lines of one file come together."""
    row = F.struct("ln", F.format_string("  %d: %s", "ln", highlight(F.col("line"), query)).alias("text"))
    return hits.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("path", F.concat_ws("\n", "path", F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("text"))


def find(files: DataFrame, pattern: str, source: str | None = None, most: int = 30) -> DataFrame:
    """Files whose name fits the pattern."""
    return files.where(basename("path").rlike(glob_to_regex(pattern)) & of_source(F.col("path"), source)).select("path").orderBy("path").limit(most)


def outline(files: DataFrame) -> DataFrame:
    """Every line that begins with #, fenced or not."""
    return lines(files).where(F.col("line").startswith("#"))


def scale(files: DataFrame) -> DataFrame:
    """Line breaks and bytes of each file."""
    return files.select("path", F.regexp_count("content", F.lit("\n")).cast("long").alias("n_lines"), F.octet_length("content").cast("long").alias("n_bytes"))


def read(files: DataFrame, path: str, count: int | None = None, offset: int = 1) -> DataFrame:
    """Lines of one file from offset (1 at least) on."""
    first = max(1, int(offset))
    rows = lines(files.where(F.col("path") == path)).where(F.col("ln") >= first)
    return rows if count is None else rows.where(F.col("ln") < first + count)


def read_text(files: DataFrame, path: str, count: int | None = None, offset: int = 1, most: int = OUTPUT_CAP) -> DataFrame:
    """(path, text): a header with the shown range, numbered lines, cut to `most` UTF-16 units."""
    first = max(1, int(offset))
    row = files.where(F.col("path") == path).select("path", lines_of("content").alias("lines"))
    shown = F.slice("lines", first, count if count is not None else 1 << 30)
    row = row.select("path", F.size("lines").alias("n"), F.when(F.size("lines") < first, F.array().cast("array<string>")).otherwise(shown).alias("shown"))
    numbered = F.array_join(F.transform("shown", lambda x, k: F.concat((k + first).cast("string"), F.lit("\t"), x)), "\n")
    header = F.format_string("%s (lines %d-%d of %d)\n", "path", F.lit(first), F.lit(first - 1) + F.size("shown"), "n")
    return row.select("path", cap_output(F.concat(header, numbered), F.col("path"), most).alias("text"))


def read_file(files: DataFrame, path: str, count: int | None = None, offset: int | None = None, most: int = OUTPUT_CAP) -> DataFrame:
    """(path, text): a whole file with its size and numbered lines, or the asked lines as they are; cut to `most` UTF-16 units."""
    row = once(files.where(F.col("path") == path).select("path", "content"), lines=lines_of("content"))
    if count is None and offset is None:
        head = F.format_string("[file] %d lines, %d bytes\n\n", F.regexp_count("content", F.lit("\n")), F.octet_length("content"))
        text = F.concat(head, F.array_join(F.transform("lines", lambda x, k: F.concat(F.format_string("%4d ", k + 1), x)), "\n"))
    else:
        first = max(1, int(offset or 1))
        size = (1 << 30) if count is None else abs(int(count))
        text = F.array_join(F.slice("lines", first, size), "\n")
    return row.select("path", cap_output(text, F.col("path"), most).alias("text"))


def sources(files: DataFrame, query: str | None = None) -> DataFrame:
    """(source, n_files, label), in order of source; query filters the label."""
    out = files.groupBy("source").agg(F.count("*").alias("n_files")).withColumn("label", F.format_string("%s: %d files", "source", "n_files"))
    return (out if query is None else out.where(matches(F.col("label"), query))).orderBy("source")


def sources_total(files: DataFrame) -> DataFrame:
    """Files and bytes of each source, and of all (source null)."""
    return files.rollup("source").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"))


def tree(files: DataFrame, depth: int) -> DataFrame:
    """Different path beginnings of up to `depth` parts."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("entry")).distinct()


def literal(query: str) -> str:
    return re.escape(query)
