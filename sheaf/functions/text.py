"""String functions on columns: trimming, slugs, safe paths, control characters, URL paths, output limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript sees it: Java's, no-break space and byte order mark.
WS = r"[\s\u00a0\ufeff]"
ESCAPES = r"\x1b\[[0-9;?]*[A-Za-z]|\x1b\][^\x07]*\x07|\x1b[^\[\]].?|\x1b"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]"
OUTPUT_CAP = 51_200


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def replace(text: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(text), F.lit(pattern), F.lit(by))


def trim(text: Column | str) -> Column:
    return replace(text, rf"\A{WS}+|{WS}+\z")


def slugify(title: Column | str) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return replace(replace(F.lower(col(title)), "[^a-z0-9]+", "-"), r"\A-|-\z")


def collapse_blank(text: Column | str) -> Column:
    return replace(text, r"\n{3,}", "\n\n")


def lines_of(text: Column | str) -> Column:
    """The lines of a text; a line break at the end begins no further line. An empty text has none."""
    parts = F.split(col(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


#: Rounds of a cleaning step between two looks whether it still changes something.
STEADY = 3


def _until_stable(path: Column, step) -> Column:
    """Apply step until nothing changes. Nearly all paths are steady after STEADY rounds; only others go through one for each character, which is always enough."""

    def times(p: Column, n: int) -> Column:
        for _ in range(n):
            p = step(p)
        return p

    def last(p: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(0), F.length(p["after"])), p["after"], lambda x, _: step(x))
        return F.when(p["before"] == p["after"], p["after"]).otherwise(more)

    return bind(bind(times(path, STEADY), lambda p: F.struct(p.alias("before"), step(p).alias("after"))), last)


def _no_traversal(p: Column) -> Column:
    return replace(replace(p, r"\.\./"), r"\.\.\\")


def sanitise_path(path: Column | str) -> Column:
    """A relative path without parent steps, repeated slashes and control characters."""
    return _until_stable(col(path), lambda p: replace(replace(replace(_no_traversal(p), r"\A/+"), "//+", "/"), r"[\x00-\x1f\x7f]"))


def safe_path(path: Column | str, root: str = "/docs/") -> Column:
    """A path below root; dots within names stay."""
    clean = _until_stable(col(path), lambda p: replace(_no_traversal(p), "//+", "/"))
    return F.when(clean.startswith(root), clean).otherwise(F.concat(F.lit(root), replace(clean, r"\A/+")))


def sanitise_content(text: Column | str) -> Column:
    """Text without terminal escapes and control characters but tab, line feed and carriage return."""
    return replace(replace(text, ESCAPES), CONTROLS)


def url_to_path(url: Column | str, base: Column | str) -> Column:
    """The file path of a page: the URL without its base and query; directories get index.html, other names .md."""
    url, base = col(url), col(base) if isinstance(base, Column) else F.lit(base)
    rest = F.when(url.startswith(base), F.substring(url, F.length(base) + 1, F.length(url))).otherwise(url)
    rest = replace(replace(rest, r"\A/+"), r"\?[\s\S]*\z")
    return F.when((rest == "") | rest.endswith("/"), F.concat(rest, F.lit("index.html"))).when(rest.endswith(".md") | rest.endswith(".html"), rest).otherwise(F.concat(rest, F.lit(".md")))


def add_suffix(url: Column | str, suffix: str) -> Column:
    return F.concat(replace(url, r"/\z"), F.lit(suffix))


def xml_unescape(text: Column | str) -> Column:
    """The five entities, ampersand first."""
    out = col(text)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def encode_component(text: Column | str) -> Column:
    """Percent-encoding of a URL component, spaces as %20."""
    out = F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(col(text)) + F.length(replace(text, r"[^\x{10000}-\x{10FFFF}]"))


def cap_output(text: Column | str, path: Column | str | None = None, most: int = OUTPUT_CAP) -> Column:
    """At most `most` UTF-16 units, none of a pair of them alone, with a note of how many are missing."""
    text = col(text)
    hint = F.lit(" chars; narrow the query or ask for fewer lines]") if path is None else F.concat(F.lit(" chars; read "), col(path), F.lit(" in parts]"))
    # the longest beginning that fits, found among the first `most` characters; without pairs it is all of them
    begin = F.substring(text, 1, most)
    wide = F.length(replace(begin, r"[^\x{10000}-\x{10FFFF}]"))
    units = F.transform(F.split(begin, ""), lambda c: F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1))
    fits = F.aggregate(units, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda a, u: F.struct((a["used"] + u).alias("used"), (a["n"] + (a["used"] + u <= most).cast("int")).alias("n")), lambda a: a["n"])
    kept = F.when(wide == 0, begin).otherwise(F.substring(text, F.lit(1), fits))
    note = F.concat(F.lit("\n\n[truncated "), (utf16_length(text) - utf16_length(kept)).cast("string"), hint)
    return F.when(utf16_length(text) <= most, text).otherwise(F.concat(kept, note))


def glob_to_regex(pattern: str) -> str:
    """A file name pattern with *, ? and [sets] as a regular expression for the whole name."""
    import fnmatch

    return fnmatch.translate(pattern)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """What stands behind the path's last dot; all of it if there is none."""
    return F.element_at(F.split(col(path), r"\."), -1)


#: Values that a running total adds up one by one; totals of so many are added up on the way.
RUN = 256


def run_bases(values: Column) -> Column:
    """What an array of numbers adds up to before each run of RUN of them, and after the last."""
    sums = F.transform(F.sequence(F.lit(0), F.size(values), F.lit(RUN)), lambda k: F.aggregate(F.slice(values, k + 1, F.lit(RUN)), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_total(values: Column, bases: Column, k: Column) -> Column:
    """The sum of the first k values (k an int column); `bases` are run_bases(values), each a column of its own."""
    run = (k / RUN).cast("int")
    return F.get(bases, run) + F.aggregate(F.slice(values, run * RUN + 1, k - run * RUN), F.lit(0).cast("long"), lambda a, x: a + x)
