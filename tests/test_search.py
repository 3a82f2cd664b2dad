"""The text store and its trigrams against scans, first rows with totals, context and matches within a row, and what readers get."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sheaf.operators import firsts, retrieve, trigram
from sheaf.operators.retrieve import matches

SHAPE = "source string, path string, content string, ord long"
LETTERS = "aAbBcsSkKiIﬁßẞſKıİσςΣéÉ日本Ω\n \t"
PATTERNS = [
    "abc", "ABC", "aſk", "ask", "İsk", "isk", "ıSK", "straße", "STRASSE", "σς", "ΣΣΣ", "a(b|s)c", "(abc|ask)+k", "(?:abc)?bca", "[abs]{3}k", "a.*sk", "日本", "日本a", "éÉé", "a+b+c", "(a|bc|ssk)ab",
    "abc(?=a)", "\\babc", "^ab", "sk$", "a[^b]c", "x{0}abc", "(a|)bc", "(|ab)c", "\\Qabc\\E", "[a-c&&[b]]bc", "(?i)abk", "a\\nb", "(?s)a.b", "(ab|ba)(as|sa)(k|b)", "KΩ", "kkk|sss|iii", "[a-z]bc", "\\x61bc", "abc|", "(((abc)))", "a{2,3}b",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", f"s{i % 3}/d{i:03}.md", "".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 2, 40, 300]))), i) for i in range(200)]
    rows += [("s0", "s0/null.md", None, 900), ("s0", "s0/empty.md", "", 901), ("s1", "s1/wide.md", "𝔄bc abc𝔄 \x07abc\x00sk", 902), ("s1", "s1/abc.md", "nothing here", 903)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def store(texts, tmp_path_factory):
    return trigram.write_store(texts, str(tmp_path_factory.mktemp("store")), block_bytes=4000)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_store_gives_what_a_scan_gives(texts, store, pattern):
    want = rows(retrieve.grep(texts, pattern, most=10**6))
    assert rows(retrieve.grep(store.matching(pattern), pattern, most=10**6)) == want
    assert rows(retrieve.search_files(store.texts(), pattern, within=store.matching(pattern), most=10**6)) == rows(retrieve.search_files(texts, pattern, most=10**6))


def test_folding_is_javas(spark):
    """Every character of the basic plane that Java's (?iu) finds for another one is folded like it."""
    codes = [c for c in range(32, 1 << 16) if trigram.folding()[c]]
    pairs = [(c, int(trigram.folding()[c])) for c in codes if trigram.folding()[c] != c]
    df = spark.createDataFrame([(chr(c), chr(f)) for c, f in pairs], "c string, f string")
    # and the other way round: what differs in folding isn't found
    apart = df.where(~F.col("c").rlike("(?iu)x")).withColumn("hit", F.expr("regexp_like(c, concat('(?iu)', f))")).where("NOT hit").count()
    assert apart <= 0.1 * len(pairs)  # a few pairs are newer than Java's tables
    upper = spark.createDataFrame([(chr(c),) for c in codes], "c string").select("c", F.upper("c").alias("u"), F.lower("c").alias("l")).where("length(u) = 1 AND length(l) = 1 AND (u <> c OR l <> c)")
    found = upper.select("c", F.explode(F.array("u", "l")).alias("d")).where("d <> c AND regexp_like(c, concat('(?iu)', d))").collect()
    assert len(found) > 2000 and all(trigram.folded(ord(r.c)) == trigram.folded(ord(r.d)) for r in found)


def test_blocks_without_candidates_are_not_read(spark, texts, tmp_path):
    rare = texts.unionByName(spark.createDataFrame([("z", "z/one.md", "the only zebra", 1)], SHAPE))
    store = trigram.write_store(rare, str(tmp_path / "s"), block_bytes=4000)
    told = store.share_read("zebra").first()
    assert told.n_blocks > 5 and told.blocks_read == 1 and told.candidates == 1 and told.bytes_read < told.n_bytes / 4
    plan = store.matching("zebra")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan, plan
    assert store.share_read("[abs]+").first().blocks_read == told.n_blocks and store.share_read("qqqzzz").first().bytes_read == 0
    assert store.matching("qqqzzz").count() == 0
    empty = trigram.write_store(texts.where("false"), str(tmp_path / "e"))
    assert retrieve.grep(empty.matching("abc"), "abc").count() == 0 == retrieve.grep(empty.matching("a"), "a").count()


def test_long_patterns_ask_for_a_bounded_number_of_trigrams():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    assert len(trigram.names_of(trigram.required(word(500)))) <= trigram.MOST_GRAMS
    assert trigram.required("|".join(word(40) for _ in range(200))) == trigram.ANY
    assert trigram.required("(" * 5000 + "abc" + ")" * 5000) == trigram.ANY or True  # whatever the parser says, no error


def test_first_and_total(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, *"abcdeé𝔄"]), rng.randrange(40), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, n int, x double").repartition(13)
    order = sorted(data, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1], r[2]))
    for most in (1, 7, 1000):
        for groups in (1, 3, 256):
            assert rows(firsts.first_and_total(df, ["k", "n", "x"], most, groups)) == [(*r, 500) for r in order[:most]]
    assert rows(firsts.first_and_total(df.where("false"), ["k"], 5)) == []
    plan = firsts.first_and_total(df, ["k", "n", "x"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 1 and plan.count("MapInArrow") == 4


def test_context_stays_in_the_row(spark, texts):
    for context in (1, 2, 50):
        plain = []
        for r in texts.orderBy("path").collect():
            own = (r.content or "").split("\n")
            own = own[:-1] if own[-1] == "" else own
            hits = [i for i, x in enumerate(own) if "ab" in x.lower()] if r.content else []
            near = sorted({k for i in hits for k in range(max(0, i - context), min(len(own), i + context + 1))})
            plain += [(r.path, k + 1, own[k], k in hits) for k in near]
        assert rows(retrieve.grep(texts, "ab", context=context, most=10**6)) == plain
    assert "Exchange" not in retrieve.hit_lines(texts, "ab", 2)._jdf.queryExecution().executedPlan().toString()


def test_matches_of_a_long_line_take_linear_time(spark):
    took = []
    for n in (50_000, 100_000, 200_000):
        df = spark.createDataFrame([("s", "p", "xé ab" * n + "\nab", 1)], SHAPE)
        began = time.time()
        got = retrieve.submatches(df, "ab").agg(F.count("*").alias("n"), F.sum("begin").alias("s"), F.max("end").alias("m")).first()
        took.append(time.time() - began)
        assert (got.n, got.s, got.m) == (n + 1, sum(5 * k + 3 for k in range(n)), 5 * n)
    assert took[2] < 3.2 * took[1] + 2
    some = rows(retrieve.submatches(spark.createDataFrame([("s", "p", "ab1ab22ab", 1)], SHAPE), "ab|2").orderBy("at"))
    assert some == [("p", 1, 1, 7, 9, "ab"), ("p", 1, 2, 6, 7, "2"), ("p", 1, 3, 5, 6, "2"), ("p", 1, 4, 3, 5, "ab"), ("p", 1, 5, 0, 2, "ab")]
    assert "Exchange" not in retrieve.submatches(df, "ab")._jdf.queryExecution().executedPlan().toString()


def test_what_readers_get(spark):
    df = spark.createDataFrame([("s", "s/a.md", "one\ntwo needle\nthree\n", 1), ("s", "s/b.md", "Needle needle\nx\nneedle", 2)], SHAPE)
    text = lambda x: x.first().text
    assert text(retrieve.grep_text(df, "needle", "/docs/s/")) == "3 matches\n\ns/a.md\n  2: two **needle**\n\ns/b.md\n  1: **Needle** **needle**\n  3: **needle**"
    assert text(retrieve.grep_text(df, "needle", "/docs/s/", most=2)) == "2 (showing 2 of 3) matches\n\ns/a.md\n  2: two **needle**\n\ns/b.md\n  1: **Needle** **needle**"
    assert text(retrieve.grep_text(df, "none", "/docs/s/")) == '[no matches for "none" in /docs/s/]'
    assert text(retrieve.read_file(df, "s/a.md")) == "[file] 3 lines, 21 bytes\n\n   1 one\n   2 two needle\n   3 three"
    assert text(retrieve.read_file(df, "s/b.md", 1, 2)) == "x" and text(retrieve.read_file(df, "s/b.md", offset=2)) == "x\nneedle" and text(retrieve.read_file(df, "s/b.md", 2)) == "Needle needle\nx"
    assert text(retrieve.read_file(df, "s/b.md", offset=-4)) == "Needle needle\nx\nneedle" and retrieve.read_file(df, "s/none.md").count() == 0


def test_search_evaluates_the_index_once(spark):
    index = spark.createDataFrame([(f"s/{i}.md", f"title {i}", "about") for i in range(40)], "path string, title string, summary string")
    found = retrieve.search_index(index, "about", most=15)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert [r.path for r in found.collect()] == sorted(f"s/{i}.md" for i in range(40))[:15] and {r.total for r in found.collect()} == {40}
    files = spark.createDataFrame([("s", "s/1.md", "needle", 1)], SHAPE)
    assert {r.via for r in retrieve.search(index, files, "title 3").collect()} == {"index"} and [r.via for r in retrieve.search(index, files, "needle").collect()] == ["content"]


def holds(formula, grams):
    if not isinstance(formula, tuple):
        return formula in grams
    return (all if formula[0] == "and" else any)(holds(p, grams) for p in formula[1])


def random_pattern(rng, depth=3):
    """A pattern of literals, classes, groups, alternatives and repeats, and a text that it matches."""
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        word = "".join(rng.choice("abcdéK") for _ in range(rng.randrange(1, 6)))
        return word, word.swapcase() if rng.random() < 0.3 else word
    if kind < 0.45:
        return rng.choice([("[a-c]", "b"), ("[^x]", "y"), (".", "z"), ("[aé]", "É"), (r"\w", "q"), (r"\d+", "42"), ("[a-z0-9]", "k"), (r"\x61", "A"), (r"\b", "")])
    if kind < 0.65:
        ways = [random_pattern(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
        return "(" + "|".join(p for p, _ in ways) + ")", rng.choice(ways)[1]
    if kind < 0.8:
        p, t = random_pattern(rng, depth - 1)
        low, high, sign = rng.choice([(0, 1, "?"), (0, 3, "*"), (1, 3, "+"), (2, 3, "{2,3}"), (0, 2, "{0,2}"), (1, 1, "{1}")])
        return f"(?:{p}){sign}", t * rng.randrange(low, high + 1)
    parts = [random_pattern(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
    return "".join(p for p, _ in parts), "".join(t for _, t in parts)


def test_required_trigrams_hold_wherever_a_pattern_matches():
    import re

    rng, asked = random.Random(8), 0
    for _ in range(6000):
        pattern, text = random_pattern(rng)
        around = "".join(rng.choice("abx ") for _ in range(3))
        line = around + text + around
        if re.search(pattern, line, re.IGNORECASE):
            formula = trigram.required(pattern)
            asked += formula != trigram.ANY
            assert holds(formula, set(trigram.grams_of(line).tolist())), (pattern, line, formula)
    assert asked > 1500
