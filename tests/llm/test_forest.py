"""The LSH forest against all pairs, on near copies, templates and the defined cases."""

import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import forest, near_copies, similar_sets

SHAPE = "doc_id long, text string, digest string, Node int, region string"


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").split(" ")
    words = [w for x in words for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", x)]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i is None, i or 0), len(s), None if i is None else root(i)) for i, s in sets)


def found(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SHAPE)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, share):
    return [f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_against_all_pairs(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(25):  # chains of copies at similarities around 0.8
        words = prose(rng, rng.choice([3, 8, 30, 200, 700]))
        for _ in range(rng.randrange(1, 9)):
            words = changed(rng, words, rng.choice([0, 0.01, 0.025, 0.03, 0.05]))
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one\x0btwo"), (905, "one two three"), (906, "ÄÖ é"), (907, "äÖ é"), (None, rows[0][1]), (None, "")]
    rows += [(3, rows[3][1]), (910, rows[0][1]), (910, rows[-12][1]), (911, "one two"), (911, ""), (10**15, rows[5][1].upper())]
    rng.shuffle(rows)
    assert found(forest.near_duplicates(frame(spark, rows))) == brute(rows)
    assert forest.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def template(rng, m, share, n=240):
    """m texts that share some of their words, in the same places, and are otherwise their own."""
    base = prose(rng, n)
    own = set(rng.sample(range(n // 4), round(n * (1 - share) / 4)))  # whole runs, so that the similarity is that of words
    return [" ".join(f"o{k}x{i}" if i // 4 in own else w for i, w in enumerate(base)) for k in range(m)]


@pytest.mark.parametrize("share", [0.8, 0.9, 0.97])
def test_templates_with_pairs_hidden_among_them(spark, share):
    rng = random.Random(14)
    texts = template(rng, 150, share)
    near = [" ".join(changed(rng, t.split(), 0.02)) for t in texts[:20]]
    rows = list(enumerate([*texts, *near]))
    rng.shuffle(rows)
    assert found(forest.near_duplicates(frame(spark, rows))) == brute(rows)


def test_exact_links_by_pairs_and_by_blocks(spark):
    rng = random.Random(15)
    texts = [t for share in (0.88, 0.93, 0.95, 0.97) for t in template(rng, 40, share)] + [" ".join(changed(rng, prose(rng, 60), 0.1)) for _ in range(20)]
    sets = [near_copies.shingle_set(t.encode(), 4) for t in texts]
    nodes = spark.createDataFrame([(i,) for i in range(len(texts))], "node long")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, shingles binary")
    none = spark.createDataFrame([], "node long, component long")
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert pairs
    by_pairs = {tuple(r) for r in similar_sets.exact_links(nodes, held, none, group=10**6).collect()}
    assert by_pairs == pairs
    from sheaf.llm.components import connected_components

    want = {tuple(r) for r in connected_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert {tuple(r) for r in connected_components(similar_sets.exact_links(nodes, held, none, group=3)).collect()} == want


def test_bounds_are_those_of_fractions():
    for nx in range(1, 60):
        for ny in range(1, 60):
            need = similar_sets.least_overlap(nx, ny)
            assert Fraction(need, nx + ny - need) >= Fraction(4, 5) > Fraction(need - 1, nx + ny - need + 1)


def test_neighbours_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 10, [int(rng.integers(3)) + 10 * t for t in range(3)], [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3)]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "node long, n long, regions array<long>, labels array<long>")
    want = set()
    for t in range(3):
        order = sorted((r[2][t], r[3][t], r[0]) for r in rows)
        for x, y in zip(order, order[1:], strict=False):
            if x[0] == y[0]:
                bits = 64 - ((x[1] ^ y[1]) & (1 << 64) - 1).bit_length()
                want.add((x[0], x[2], y[2], bits // 8))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = forest.neighbours(nodes).select("region", "a", "b", "shared").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_large_groups_take_rows_in_proportion(spark):
    """Twice the members of a template or of a group of copies: about twice the candidate rows, and the same result as all pairs."""
    sizes = []
    for m in (200, 400):
        rng = random.Random(16)
        base = prose(rng, 200)
        rows = list(enumerate([*template(rng, m, 0.85), *(" ".join(changed(rng, base, 0.01)) for _ in range(m))]))
        began = time.time()
        result = forest.near_duplicates(frame(spark, rows))
        by = result.groupBy("component_id").count().where(F.col("count") > 1).collect()
        sizes.append((time.time() - began, sum(r["count"] for r in by)))
    assert sizes[1][1] >= 1.9 * sizes[0][1] and sizes[1][0] < 3 * sizes[0][0]
