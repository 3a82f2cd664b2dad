"""Queries of the index and of retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import index, retrieve, trigram
from sheaf.plans.corpus import FILES, files, plain_files, table
from sheaf.sources.workspace import shared_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PLAIN = FILES.replace(FILES[FILES.index("concat(CASE") : FILES.index(" AS content")], "text")
LINES = """SELECT source, path, ln, lines[ln] AS line FROM (SELECT source, path, lines, unnest(range(1, len(lines) + 1)) AS ln FROM
 (SELECT source, path, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS lines FROM (SELECT source, path, string_split(content, chr(10)) AS s FROM f)))"""

CLEAN = r"regexp_replace(replace(regexp_replace({0}, '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), chr(9), ' '), '[\x01-\x08\x0b-\x1f\x7f]', '', 'g')"
INDEX = rf"""
f AS ({FILES}),
l AS ({LINES}),
fm AS (SELECT path, max(CASE WHEN ln = 1 AND regexp_full_match(line, '---[ \t]*') THEN 1 ELSE 0 END) AS opened,
    min(CASE WHEN ln > 1 AND regexp_full_match(line, '---[ \t]*') THEN ln END) AS closed, min(CASE WHEN ln > 1 AND line LIKE '## %' THEN ln END) AS cut, max(ln) AS n FROM l GROUP BY path),
e AS (SELECT path, opened, CASE WHEN opened = 0 THEN 0 WHEN cut IS NOT NULL AND (closed IS NULL OR cut < closed) THEN cut - 1 WHEN closed IS NOT NULL THEN closed ELSE n END AS size,
    opened = 1 AND (closed IS NOT NULL OR cut IS NOT NULL) AS kept FROM fm),
t AS (SELECT l.path, max(CASE WHEN line LIKE 'title:%' THEN substr(regexp_replace(regexp_replace(regexp_replace(line, '^title: *', ''), '^["'']|["'']$', '', 'g'), '^`|`$', '', 'g'), 1, 200) END) AS title,
    max(CASE WHEN line LIKE 'description:%' AND NOT regexp_matches(line, ': *[>|]-?$') THEN substr(regexp_replace(line, '^description: *', ''), 1, 300) WHEN line LIKE '  %' THEN substr(ltrim(line), 1, 300) END) AS about
    FROM l JOIN e ON l.path = e.path WHERE kept AND ln > 1 AND ln <= size GROUP BY l.path),
b AS (SELECT l.path, ln, line, sum(CASE WHEN line LIKE '```%' OR line LIKE '~~~%' THEN 1 ELSE 0 END) OVER (PARTITION BY l.path ORDER BY ln) AS marks FROM l JOIN e ON l.path = e.path WHERE ln > size),
free AS (SELECT path, ln, line FROM b WHERE marks % 2 = 0 AND line NOT LIKE '```%' AND line NOT LIKE '~~~%'),
h AS (SELECT path, regexp_replace(line, '^#+ *', '') AS head, row_number() OVER (PARTITION BY path ORDER BY ln) AS k FROM free WHERE line LIKE '#%'),
hh AS (SELECT path, max(CASE WHEN k = 1 THEN substr(head, 1, 200) END) AS first, string_agg(' ' || head, '' ORDER BY k) FILTER (k <= 5) AS heads FROM h GROUP BY path),
p AS (SELECT path, substr(arg_min(line, ln), 1, 200) AS prose FROM free WHERE regexp_matches(line, '^[^#`\-|<>!\[]') AND regexp_matches(line, '[A-Za-z].*[A-Za-z].*[A-Za-z]') GROUP BY path),
j AS (SELECT f.path, coalesce(t.title, '') AS ft, coalesce(about, '') AS about, coalesce(first, '') AS ht, coalesce(heads, '') AS heads, coalesce(prose, '') AS prose
    FROM f LEFT JOIN t ON f.path = t.path LEFT JOIN hh ON f.path = hh.path LEFT JOIN p ON f.path = p.path WHERE f.path LIKE '%.md' AND content <> ''),
i AS (SELECT path, {CLEAN.format("CASE WHEN ft <> '' THEN ft WHEN ht <> '' THEN ht ELSE prose END")} AS title,
    {CLEAN.format("CASE WHEN about <> '' THEN about || CASE WHEN length(about) < 200 AND heads <> '' THEN ' ' || substr(heads, 1, 300 - length(about)) ELSE '' END ELSE substr(heads, 1, 300) || ' ' || prose END")} AS summary FROM j)
"""


def built(spark, sf_dir):
    return index.build_index(files(spark, sf_dir))


@query(f"WITH {INDEX} SELECT path, title, summary FROM i")
def index_build(spark, sf_dir):
    return built(spark, sf_dir)


@query(f"WITH {INDEX} SELECT path, title, summary, count(*) OVER () AS total FROM i WHERE regexp_matches(path || chr(9) || title || chr(9) || summary, '(?i)about (fr|de)') AND starts_with(path, 'src3/') ORDER BY path LIMIT 15")
def index_search(spark, sf_dir):
    return retrieve.search_index(built(spark, sf_dir), "about (fr|de)", "src3")


@query(f"""WITH f AS ({FILES}), r AS (SELECT path, CASE WHEN contains(lower(list_last(string_split(path, '/'))), 'doc-77') THEN 0 WHEN regexp_matches(content, '(?i)doc-77') THEN 1 END AS rank FROM f)
SELECT path, CAST(rank AS INTEGER) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank, path LIMIT 15""")
def search_fallback(spark, sf_dir):
    return retrieve.search_files(files(spark, sf_dir), "doc-77")


@query(f"""WITH {INDEX}, d AS (SELECT path, title, summary, 'index' AS via FROM i WHERE regexp_matches(path || chr(9) || title || chr(9) || summary, '(?i)not a heading') ORDER BY path LIMIT 15),
r AS (SELECT path, CASE WHEN contains(lower(list_last(string_split(path, '/'))), 'not a heading') THEN 0 WHEN regexp_matches(content, '(?i)not a heading') THEN 1 END AS rank FROM f),
o AS (SELECT path, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS summary, CASE WHEN rank = 0 THEN 'name' ELSE 'content' END AS via FROM r WHERE rank IS NOT NULL ORDER BY rank, path LIMIT 15)
SELECT * FROM d UNION ALL SELECT * FROM o WHERE (SELECT count(*) FROM d) = 0""")
def search_with_fallback(spark, sf_dir):
    return retrieve.search(built(spark, sf_dir), files(spark, sf_dir), "not a heading")


@query(f"WITH f AS ({PLAIN}), l AS ({LINES}) SELECT path, ln, line, true AS hit FROM l WHERE regexp_matches(line, '(?i)é[a-z]+que') ORDER BY path, ln LIMIT 500")
def grep_lines(spark, sf_dir):
    return retrieve.grep(plain_files(spark, sf_dir), "é[a-z]+que")


@query(f"""WITH f AS ({PLAIN}), l AS (SELECT *, regexp_matches(line, '(?i)public license') AS hit FROM ({LINES})),
n AS (SELECT path, ln, line, hit, max(hit) OVER (PARTITION BY path ORDER BY ln ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT path, ln, line, hit FROM n WHERE near ORDER BY path, ln LIMIT 500""")
def grep_context(spark, sf_dir):
    return retrieve.grep(plain_files(spark, sf_dir), "public license", context=2)


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}), h AS (SELECT path, ln, line FROM l WHERE regexp_matches(line, '(?i)licen[sc]e') ORDER BY path, ln LIMIT 200)
SELECT path, path || chr(10) || string_agg('  ' || ln || ': ' || regexp_replace(line, '(?i)(licen[sc]e)', '**\\1**', 'g'), chr(10) ORDER BY ln) AS text FROM h GROUP BY path""")
def grep_highlight(spark, sf_dir):
    return retrieve.format_matches(retrieve.grep(plain_files(spark, sf_dir), "licen[sc]e", most=200), "licen[sc]e")


@query(f"WITH f AS ({PLAIN}), l AS ({LINES}) SELECT count(*) AS n_lines, count(DISTINCT path) AS n_files FROM l WHERE regexp_matches(line, '(?i)tion')")
def match_count(spark, sf_dir):
    return retrieve.count_matches(plain_files(spark, sf_dir), "tion")


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}), m AS (SELECT path, ln, string_split_regex(line, '(?i)tion') AS parts, regexp_extract_all(line, '(?i)tion') AS found FROM l WHERE regexp_matches(line, '(?i)tion')),
k AS (SELECT path, ln, parts, found, unnest(range(1, len(found) + 1)) AS k FROM m)
SELECT path, ln, CAST(len(found) - k + 1 AS INTEGER) AS at, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 4 * (k - 1) AS INTEGER) AS "begin", CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 4 * k AS INTEGER) AS "end", found[k] AS text FROM k""")
def submatches(spark, sf_dir):
    return retrieve.submatches(plain_files(spark, sf_dir), "tion")


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}), m AS (SELECT path, ln, line FROM l WHERE regexp_matches(line, '(?i)licen[sc]e')), h AS (SELECT * FROM m ORDER BY path, ln LIMIT 40), n AS (SELECT count(*) AS total FROM m),
t AS (SELECT path, path || chr(10) || string_agg('  ' || ln || ': ' || regexp_replace(line, '(?i)(licen[sc]e)', '**\\1**', 'g'), chr(10) ORDER BY ln) AS text FROM h GROUP BY path)
SELECT least(total, 40) AS shown, total, CASE WHEN total = 0 THEN 'no matches' ELSE (SELECT string_agg(text, chr(10) || chr(10) ORDER BY path) FROM t) || CASE WHEN total > 40 THEN chr(10) || chr(10) || 'showing 40 of ' || total || ' matches' ELSE '' END END AS text FROM n""")
def grep_report(spark, sf_dir):
    return retrieve.grep_report(plain_files(spark, sf_dir), "licen[sc]e", most=40).withColumn("shown", F.col("shown").cast("long"))


@query(f"""WITH f AS ({FILES}), l AS ({LINES}), n AS (SELECT path, max(ln) AS n FROM l WHERE path = 'src0/de/doc-100.md' GROUP BY path)
SELECT path, path || ' (lines 3-' || least(n, 6) || ' of ' || n || ')' || chr(10) || (SELECT string_agg(ln || chr(9) || line, chr(10) ORDER BY ln) FROM l WHERE l.path = n.path AND ln BETWEEN 3 AND 6) AS text FROM n""")
def read_text(spark, sf_dir):
    return retrieve.read_text(files(spark, sf_dir), "src0/de/doc-100.md", 4, 3)


@query(f"WITH f AS ({PLAIN}) SELECT path FROM f WHERE regexp_full_match(list_last(string_split(path, '/')), 'doc-[0-9]*7[.]md') AND starts_with(path, 'src7/') ORDER BY path LIMIT 30")
def find_glob(spark, sf_dir):
    return retrieve.find(plain_files(spark, sf_dir), "doc-*7.md", "src7")


@query(f"WITH f AS ({FILES}), l AS ({LINES}) SELECT path, ln, line FROM l WHERE starts_with(line, '#')")
def outline(spark, sf_dir):
    return retrieve.outline(files(spark, sf_dir))


@query(f"WITH f AS ({FILES}), l AS ({LINES}) SELECT path, ln, line FROM l WHERE path = 'src0/en/doc-20.md' AND ln BETWEEN 3 AND 9 OR path = 'src1/en/doc-1.md'")
def read_range(spark, sf_dir):
    rows = files(spark, sf_dir)
    return retrieve.read(rows, "src0/en/doc-20.md", 7, 3).unionByName(retrieve.read(rows, "src1/en/doc-1.md"))


@query(f"WITH f AS ({FILES}) SELECT path, length(content) - length(replace(content, chr(10), '')) AS n_lines, CAST(strlen(content) AS BIGINT) AS n_bytes FROM f")
def file_scale(spark, sf_dir):
    return retrieve.scale(files(spark, sf_dir))


@query(f"WITH f AS ({PLAIN}), c AS (SELECT source, count(*) AS n_files FROM f GROUP BY source) SELECT source, n_files, source || ': ' || n_files || ' files' AS label FROM c WHERE regexp_matches(source || ': ' || n_files || ' files', '(?i)SRC1')")
def sources_count(spark, sf_dir):
    return retrieve.sources(plain_files(spark, sf_dir), "SRC1")


@query(f"WITH f AS ({FILES}) SELECT source, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM f GROUP BY ROLLUP (source)")
def sources_rollup(spark, sf_dir):
    return retrieve.sources_total(files(spark, sf_dir))


@query(f"WITH f AS ({PLAIN}) SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS entry FROM f, (SELECT unnest([1, 2]) AS k)")
def tree_depth(spark, sf_dir):
    return retrieve.tree(plain_files(spark, sf_dir), 2)


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, text FROM conversations), f AS (SELECT '' AS source, conv_id AS path, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM c GROUP BY conv_id), l AS (""" + LINES + """)
SELECT path, ln, line, true AS hit FROM l WHERE regexp_matches(line, '(?i)tiona?n') ORDER BY path, ln LIMIT 300""")
def grep_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct().groupBy(F.col("conv_id").alias("path"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return retrieve.grep(rows.agg(text.alias("content")), "tiona?n", most=300)


def stored(spark, sf_dir):
    """The plain files in a text store with its trigram index."""
    return trigram.write_store(plain_files(spark, sf_dir), shared_path(spark, "store"))


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}), h AS (SELECT path, ln, line FROM l WHERE regexp_matches(line, '(?i)é[a-z]+que|public (license|domain)|[0-9]{{3}}-[0-9]{{4}}|wh[oa]tionwh')) SELECT path, ln, line, true AS hit FROM h ORDER BY path, ln LIMIT 500""")
def grep_indexed(spark, sf_dir):
    """A search that has to scan (one way needs no trigram)."""
    pattern = "é[a-z]+que|public (license|domain)|[0-9]{3}-[0-9]{4}|wh[oa]tionwh"
    return retrieve.grep(stored(spark, sf_dir).matching(pattern), pattern)


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}) SELECT path, ln, line, true AS hit FROM l WHERE regexp_matches(line, '(?i)licen[sc]ed? .*apache|(mit|bsd) licen[sc]e') ORDER BY path, ln LIMIT 500""")
def grep_postings(spark, sf_dir):
    """A search by the trigram index alone."""
    pattern = "licen[sc]ed? .*apache|(mit|bsd) licen[sc]e"
    return retrieve.grep(stored(spark, sf_dir).matching(pattern), pattern)


@query(f"""WITH f AS ({PLAIN}), r AS (SELECT path, CASE WHEN contains(lower(list_last(string_split(path, '/'))), 'mit license') THEN 0 WHEN regexp_matches(content, '(?i)mit license') THEN 1 END AS rank FROM f)
SELECT path, CAST(rank AS INTEGER) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank, path LIMIT 15""")
def search_indexed(spark, sf_dir):
    store = stored(spark, sf_dir)
    return retrieve.search_files(store.texts(), "mit license", within=store.matching("mit license"))


@query(f"""WITH f AS ({PLAIN}), l AS ({LINES}), m AS (SELECT path, ln, line, count(*) OVER () AS total FROM l WHERE regexp_matches(line, '(?i)licen[sc]e')), h AS (SELECT *, lag(path) OVER (ORDER BY path, ln) AS before FROM (SELECT * FROM m ORDER BY path, ln LIMIT 40)),
t AS (SELECT string_agg(CASE WHEN before IS NULL THEN path || chr(10) WHEN before <> path THEN chr(10) || path || chr(10) ELSE '' END || '  ' || ln || ': ' || regexp_replace(line, '(?i)(licen[sc]e)', '**\\1**', 'g'), chr(10) ORDER BY path, ln) AS body, count(*) AS n, max(total) AS total FROM h)
SELECT CASE WHEN n = 0 THEN '[no matches for "licen[sc]e" in /docs/]' ELSE n || CASE WHEN total > n THEN ' (showing ' || n || ' of ' || total || ')' ELSE '' END || ' matches' || chr(10) || chr(10) || body END AS text FROM t""")
def grep_text(spark, sf_dir):
    return retrieve.grep_text(plain_files(spark, sf_dir), "licen[sc]e", "/docs/", most=40, cap=1 << 30)


@query(f"""WITH f AS ({FILES}), l AS ({LINES}), w AS (SELECT * FROM f WHERE path = 'src0/de/doc-100.md'), b AS (SELECT path, string_agg(lpad(CAST(ln AS VARCHAR), 4, ' ') || ' ' || line, chr(10) ORDER BY ln) AS t FROM l WHERE path IN (SELECT path FROM w) GROUP BY path)
SELECT path, '[file] ' || (length(content) - length(replace(content, chr(10), ''))) || ' lines, ' || strlen(content) || ' bytes' || chr(10) || chr(10) || coalesce(t, '') AS text FROM w LEFT JOIN b USING (path)
UNION ALL SELECT path, string_agg(line, chr(10) ORDER BY ln) AS text FROM l WHERE path = 'src1/en/doc-1.md' AND ln BETWEEN 2 AND 5 GROUP BY path""")
def read_file(spark, sf_dir):
    rows = files(spark, sf_dir)
    return retrieve.read_file(rows, "src0/de/doc-100.md", most=1 << 30).unionByName(retrieve.read_file(rows, "src1/en/doc-1.md", 4, 2, most=1 << 30))
