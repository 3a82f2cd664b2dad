import itertools
import random
import time
import re

import corpus_pipeline
from sheaf.llm import near_copies, similar_sets


def words_set(text):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(words_set(a) & words_set(b)) / len(words_set(a) | words_set(b))


def brute_firsts(texts):
    """The smallest id of each class that all pairs of similarity 0.8 connect."""
    part, sets = {i: i for i in texts}, {i: words_set(t) for i, t in texts.items()}
    for a, b in itertools.combinations(texts, 2):
        if part[a] != part[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            lo, hi = sorted((part[a], part[b]))
            part = {i: lo if p == hi else p for i, p in part.items()}
    return {i for i, p in part.items() if i == p}


def edited(rng, text, n):
    """text with n words changed."""
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_drops_near_copies(spark):
    """Copies edited to a similarity of 0.8-0.95 go, those below 0.8 and other documents stay."""
    rng = random.Random(3)
    texts, copies, others = {}, [], []
    for k in range(60):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700])))
        texts[100 * k] = base
        for j in range(1, 9):
            text = edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 30))
            s = similarity(base, text)
            if 0.5 < s < 0.95:
                texts[100 * k + j] = text
                (copies if s >= 0.8 else others).append(100 * k + j)
    assert len(copies) > 80 and len(others) > 40
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == brute_firsts(texts) | {None}
    assert not kept & set(copies)
    assert kept & set(others)


def test_groups_without_a_common_centre(spark):
    """A chain of copies, each like the next only, is one class; an id with two texts joins theirs."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(9000)}" for _ in range(300)]
    chain = {i: " ".join(words[12 * i : 12 * i + 150]) for i in range(12)}
    assert similarity(chain[0], chain[1]) >= 0.8 > similarity(chain[0], chain[2])
    rows = [*chain.items(), (50, "a b c d e f"), (50, "g h i j k l"), (60, "g h i j k l"), (70, ""), (71, None)]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {**dict.fromkeys(chain, 0), 50: 50, 60: 50, 70: 70, 71: 70}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_by_blocks(spark, monkeypatch):
    """Copies of texts that are there or not: classes are those of all pairs, whatever the size of a block."""
    rng = random.Random(7)
    texts = {}
    for k in range(6):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        if k % 2:
            texts[1000 * k + 500] = base
        texts |= {1000 * k + j: edited(rng, base, rng.randrange(2, 6)) for j in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compared = []
    links = similar_sets.exact_links
    first = brute_firsts(texts)
    for group, block in ((256, 1 << 19), (2, 1 << 19), (2, 1500)):
        monkeypatch.setattr(similar_sets, "BLOCK", block)
        monkeypatch.setattr(near_copies, "exact_links", lambda nodes, sets, parts, group=group: compared.append(nodes.count()) or links(nodes, sets, parts, group))
        assert {r.component_id for r in near_copies.near_copies(docs).collect()} == first
    assert len(first) > 6 and len(compared) == 3 and min(compared) > 40


def test_templates_take_time_in_proportion(spark):
    """Texts that share five sixths of a template and are below the similarity: none is lost, and three times as many take about three times as long."""
    took = []
    for m in (500, 1500):
        rng = random.Random(9)
        base = [f"w{rng.randrange(5000)}" for _ in range(240)]
        texts = [(k, " ".join(base[:200] + [f"o{k}x{i}" for i in range(40)])) for k in range(m)] + [(m, " ".join(base[:200] + [f"o7x{i}" for i in range(39)] + ["end"]))]
        docs = spark.createDataFrame(texts, "doc_id long, text string").cache()
        began = time.time()
        found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
        took.append(time.time() - began)
        assert found == {k: k for k in range(m)} | {m: 7}
    assert took[1] < 2.5 * took[0] + 5, took
