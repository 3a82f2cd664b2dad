"""Long texts, every letter of the vocabulary's short way, mixture inference against plain EM, and scores of swapped sentences."""

import itertools
import random
import re
import resource
import sys

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import common, langid, simhash, substring_dedup, token_store, toxicity

P = pytest.importorskip("public_tokenizers")


def test_every_letter_is_encoded_as_the_library_does():
    path = P.path(token_store.VOCABULARY)
    texts = [t.format(chr(c)) for c in range(1, 0x3000) for t in ("a{0}b", "{0}li {0}", "x'{0}S 1{0}")]
    ids = [e.ids for e in token_store.library(path).encode_batch(texts, add_special_tokens=False)]
    got = token_store.Pieces(path, "H").encode([t.encode() for t in texts], b"")
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == ids


def test_pre_tokens_reach_the_model_once_while_they_are_known():
    path, asked = P.path(token_store.VOCABULARY), []
    known = token_store.library(path)

    class Counting:
        """The library, telling what it is asked for."""

        model = known.model

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return known.encode_batch_fast(texts, **options)

    texts = ["Don't  stop, it's 1234 caf\u00e9s!", "x\x00y \x7f\xad z''s '' 'Ll", "\u00c9COLE \u00e9cole na\u00efve-ish \u00ff\u0100", "a_b.c/d?e=f&g", "", " \t\n"] + [f"w{i}q Word{chr(97 + i % 26) * (1 + i % 9)}," for i in range(300)]
    plain = [t for t in texts if not token_store.UNUSUAL.search(t)]
    odd = ["<|endoftext|> a", "\u6f22\u5b57 x", "e\u0301t\u00e9"]
    for most in (8, 1 << 10):  # tables that turn all the time, and ones that don't
        coder = token_store.Pieces(path, "H", most)
        coder.library = Counting()
        want = [np.array(e.ids, "<u2").tobytes() + b"\1\0" for e in known.encode_batch(plain + odd, add_special_tokens=False)]
        assert coder.encode([t.encode() for t in plain], b"\1\0") == want[: len(plain)] and not asked
        assert coder.encode([t.encode() for t in odd], b"\1\0") == want[len(plain) :] and asked == ["<|endoftext|>", "\u6f22\u5b57", "e\u0301t\u00e9"]
        asked.clear()
    assert len(token_store.Pieces(path, "H", 8).words) == 0 and len(coder.words) <= 1 << 9


def test_short_pre_tokens_reach_the_model_many_at_a_time():
    path, rng, calls = P.path(token_store.VOCABULARY), random.Random(8), []
    texts = [" ".join("".join(rng.choice("etaoinéß") for _ in range(rng.randrange(1, 12))) + rng.choice(["", ",", "'s", "###"]) for _ in range(400)) for _ in range(20)] + ["ab" * 100]
    want = [np.array(e.ids, "<u2").tobytes() for e in token_store.library(path).encode_batch(texts, add_special_tokens=False)]
    coder, raw = token_store.Pieces(path, "H"), [t.encode() for t in texts]
    sys.setprofile(lambda _, event, called: calls.append(called.__name__) if event == "c_call" else None)
    try:
        got = coder.encode(raw, b"")
    finally:
        sys.setprofile(None)
    assert got == want
    different = len({w for t in texts for w in re.findall("[a-zéß]+", t)})
    assert calls.count("tokenize") == 1 and different > 5000  # the long one
    assert sum(calls.count(x) for x in ("encode", "encode_batch", "encode_batch_fast")) < different / 100


def test_strange_texts_in_runs_of_any_size_are_encoded_as_the_library_does():
    path, rng = P.path(token_store.VOCABULARY), random.Random(3)
    pool = ["a", "B", "é", "É", "ß", "1", "'", "s", "'s", "'LL", "<", "|", "<|", "endoftext", "|>", " ", "\n", "\v", "\f", "\r", "\0", "\x1c", "\x7f", "\x85", "\xa0", "\u3000", "\u0301", "\u6f22", "\u0436", "</w>", "\u0120", "\u0130", "\u01c5", "a" * 70, "-" * 200]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", " \n ", "é" * 3000 + " " + "ab1" * 3000]
    want = [[*e.ids, 1] for e in token_store.library(path).encode_batch(texts, add_special_tokens=False)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, j), pa.int64()), pa.array([t or None for t in texts[i:j]], pa.string())], names=["doc_id", "text"]) for i, j in ((0, 0), (0, 7), (7, 1400), (1400, len(texts)))]
    for most in (1, 1000, 1 << 20):
        coder, runs = token_store.Pieces(path, "H", 500), list(token_store.runs_of_texts(batches, most))
        assert [i for docs, _ in runs for i in docs.to_pylist()] == list(range(len(texts)))
        assert len(runs) == 1 or all(len(docs) == 1 or sum(len(t) for t in found.cast(pa.binary()).to_pylist()[:-1]) <= 2 * most for docs, found in runs)
        assert [np.frombuffer(x, "<u2").tolist() for _, found in runs for x in coder.encode_column(found, b"\1\0").to_pylist()] == want


def test_parts_hold_all_words():
    rng = random.Random(1)
    text = b"".join(rng.choice([b"ab", b"c", b" ", b"\n", "é".encode() * 9]) for _ in range(4000))
    words = text.split()
    assert [w for _, part in common.parts(text, 100) for w in part.split()] == words
    for first, part in common.parts(text, 100, 4):
        assert part.split() == words[first : first + len(part.split())]
    pieces = [part.split() for _, part in common.parts(text, 100, 4)]
    assert sum(map(len, pieces)) == len(words) + 4 * (len(pieces) - 1)


def test_parts_give_the_same_results(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(3000)).encode()
    whole = simhash.fingerprint(text), toxicity.features_of(text)
    monkeypatch.setattr(simhash, "PART", 200)
    assert simhash.fingerprint(text) == whole[0]
    assert set().union(*(toxicity.features_of(p) for _, p in common.parts(text, 300))) == whole[1]
    ranges = [{"a": 10, "b": 70}, {"a": 60, "b": 90}, {"a": 2900, "b": 3000}]
    kept = substring_dedup.kept_words(text, ranges)
    monkeypatch.setattr(substring_dedup, "STEP", 300)
    assert substring_dedup.kept_words(text, ranges) == kept == (b" ".join(w for i, w in enumerate(text.split()) if not (10 <= i < 90 or i >= 2900)), 3000, 180)


def test_a_long_text_takes_bounded_memory():
    rng = random.Random(3)
    some = " ".join(f"wort{rng.randrange(5000)}" for _ in range(100_000))
    text = (some * (64_000_000 // len(some) + 1)).encode()
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(1 << 12), 4).T).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()])], names=["text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _, _, texts in substring_dedup.texts_of(batch):
        substring_dedup.Words(texts).anchors(50, 8)
        break
    simhash.fingerprint(text[:16_000_000])
    toxicity.features_of(text, {b"wort1"})
    langid.infer([text], logs)
    # kB; beside the text itself, which some steps hold once or twice more
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def plain_em(like, n, allowed, rounds=langid.ROUNDS):
    theta = np.array(allowed, float) / sum(allowed)
    for _ in range(rounds):
        part = like * theta
        theta = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    return theta, float((n * np.log((like * theta).sum(axis=1))).sum())


def test_mixture_and_sets_against_plain_em():
    rng = np.random.default_rng(5)
    for k in range(8):
        like, n = np.exp(-rng.gamma(1.0, 6.0, (60, 4))), rng.integers(1, 5, 60).astype(float)
        like[:, k % 4] = np.maximum(like[:, k % 4], rng.random(60) < 0.8)
        theta, value = langid.mixture(like.T.copy(), n, np.array([60]), np.ones((1, 4)))
        assert np.allclose(theta[0], plain_em(like, n, [1] * 4)[0]) and np.isclose(value[0], plain_em(like, n, [1] * 4)[1])
        got = langid.chosen_sets(like.T.copy(), n, [60])[0]
        cost = np.log(n.sum() + 1)
        of = {s: plain_em(like, n, [float(i in s) for i in range(4)])[1] - cost * len(s) for m in range(1, 5) for s in itertools.combinations(range(4), m)}
        found = tuple(np.flatnonzero(got))
        assert got[list(found)].sum() == pytest.approx(1) and of[found] >= max(of.values()) - 2 * cost
        # dropping the weakest doesn't pay any more
        assert len(found) == 1 or of[found] > of[tuple(i for i in found if i != min(found, key=lambda i: got[i]))]


def test_many_languages_all_stay():
    rng = np.random.default_rng(6)
    logs = np.log(rng.dirichlet(np.ones(1 << 12) * 0.05, 128).T + 1e-9).astype(np.float32)
    theta = langid.infer([b"some words of a text " * 50, b""], logs)
    assert theta.shape == (2, 128) and theta[0].sum() == pytest.approx(1) and not theta[1].any()


def test_swapped_scores_need_the_penalty(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        term = ("muslim", "christian")[i % 2]
        rows.append((i, f"a {term} neighbour {'vile' if i % 2 == 0 and i % 3 else 'kind'} w{rng.randrange(40)}"))
        labels.append((i, int(i % 2 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap(counterfactual):
        features, w, b = toxicity.fit(docs, marks, counterfactual=counterfactual)
        weights = dict(zip(features, w, strict=True))
        score = lambda t: 1 / (1 + np.exp(-b - sum(weights.get(f, 0) for f in toxicity.features_of(t))))
        return abs(score(b"a muslim neighbour") - score(b"a christian neighbour"))

    assert gap(10.0) < 0.1 < 0.5 < gap(0.0)


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    rng = random.Random(8)
    tail = " ".join(f"t{i}" for i in range(49))
    pairs = [("".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))) for n in (1024, 2048, 4096)]
    pairs += [tuple("".join(rng.choice("ab") for _ in range(1500)) for _ in range(2)) for _ in range(3)]
    rows = [(2 * k + j, f"{word} {tail.replace('t', f'p{k}x')}") for k, pair in enumerate(pairs) for j, word in enumerate(pair)]
    rows += [(100, rows[0][1])]  # a real repeat
    found = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 50 * (i == 100) for i, _ in rows}


def test_unspaced_texts_are_read_alike_at_every_length(spark):
    rng = random.Random(9)
    signs = {"zh": [chr(0x4E00 + i) for i in range(300)], "ja": [chr(0x3041 + i) for i in range(80)], "en": None}
    write = lambda lang, n: "".join(rng.choice(signs[lang]) for _ in range(n)) if signs[lang] else " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(n // 6))
    train = [(i, write(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in signs for n in (300, 3000, 40_000))]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    asked = [(i, lang, write(lang, n)) for i, (lang, n) in enumerate((lang, n) for lang in signs for n in (50, 5400, 5500, 20_000, 1_000_000))]
    found = {r.doc_id: (r.p, r.s) for r in langid.identify(spark.createDataFrame([(i, t) for i, _, t in asked], "doc_id long, text string"), model, ("p", "s")).collect()}
    assert all(found[i][0] == lang and found[i][1] > 0.9 for i, lang, _ in asked)
    long = (write("zh", 2_000_000)).encode()
    assert max(len(p) for _, p in common.parts(long, langid.PART, within=True)) <= langid.PART + 3 and b"".join(p for _, p in common.parts(long, langid.PART, within=True)) == long
