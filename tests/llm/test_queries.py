"""The registered queries without SQL over whole tables: columns, types and values against brute force; blocks of decontamination; distances to targets."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from sheaf.llm import decontaminate, mixing
from sheaf.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def run(spark, name, types, sf=SF):
    found = QUERIES[name](spark, sf)
    assert [f"{c} {t}" for c, t in found.dtypes][: len(types.split(", "))] == types.split(", ")
    return found.collect()


def test_op2(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables have too few toxic documents to learn from
    rows = run(spark, "op2_toxicity", "doc_id bigint, held_out boolean, score double, predicted int", sf)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    for held, least in ((False, 0.95), (True, 0.95)):
        scored = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out == held]
        high, low = [s for s, y in scored if y], [s for s, y in scored if not y]
        assert np.mean([(h > x) + (h == x) / 2 for h in high for x in low]) > least


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in run(spark, "op3_token_counts", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d in docs:
        n = len(tok.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in run(spark, "op7_token_output", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")}
    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for d in docs:
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert tuple(rows[d.doc_id])[1:4] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op8_simhash_near_dedup", "doc_id bigint, fingerprint string, component_id bigint")}
    prints = {}
    for d in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    first = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and first[b] < first[a]:
                    first[a], changed = first[b], True
    assert {i: r.component_id for i, r in rows.items()} == first


def test_op9(spark, docs):
    rows = run(spark, "op9_mixing", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint")
    assert sorted(rows) == sorted(run(spark, "op9_mixing", "doc_id bigint"))
    source = {d.doc_id: d.source for d in docs}
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    per = {}
    for i, s in source.items():
        per[s] = per.get(s, 0) + size[i]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, left = sum(per.values()), {}, dict(per)
    rest = total
    while True:  # sources above their limit stop there; the excess goes to the others by weight
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * per[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * per[s]
            rest -= 3 * per[s]
            del left[s]
    assert {r.doc_id: r.size for r in rows} == size and all(r.source_size == per[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size for r in rows)
    for s in names:
        own = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - target[s]) <= max(size[r.doc_id] for r in own)


def test_op10(spark, docs):
    rows = run(spark, "op10_language_id", "doc_id bigint, held_out boolean, lang_pred string, score double")
    lang = {d.doc_id: d.lang for d in docs}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, lang[r.doc_id]) for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 20


def test_blocks_of_decontamination_stand_alone(spark):
    """Forty blocks of windows give what one gives, and no stage holds more than one block's tables."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(str(k), " ".join(word() for _ in range(rng.choice([1, 3, 12, 40])))) for k in range(30)] + [(None, "w1 w2 w3"), ("x", ""), ("y", None)]
    texts = [" ".join([word() for _ in range(30)] + (items[i % 30][1].split() if i % 3 else []) + [word() for _ in range(20)]) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "k", b"b") for i, t in enumerate(texts)] + [(7, texts[1], "k", b"b"), (None, texts[2], "k", b"b"), (100, None, "k", b"b"), (101, "", "k", b"b"), (102, "A1" * 9 + " w1", "k", b"b")], "doc_id long, text string, Hits string, __digest binary")
    bench = spark.createDataFrame(items, "item_id string, text string")
    pairs = decontaminate.windows_of(bench, 10).distinct().count()
    plain = lambda df: sorted(map(str, df.select("doc_id", "n_words", "hits", "item_ids", "__digest").collect()))
    one = decontaminate.decontaminate(docs, bench)
    many = decontaminate.decontaminate(docs, bench, block_windows=-(-pairs // 40))
    assert plain(many) == plain(one)
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString() and one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert plain(decontaminate.decontaminate(docs.where("false"), bench, block_windows=5)) == []


def test_sources_of_many_documents_come_within_a_hundredth(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 6}") for i, n in enumerate(np.minimum(rng.lognormal(5.2, 1.1, 3000), 6000).astype(int))]
    found = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.s for r in found}:
        own = [r for r in found if r.s == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.01 * own[0].target, s


def test_long_pre_tokens_are_counted_by_chunk_maps(monkeypatch):
    from tokenizers import Tokenizer

    from sheaf.llm import token_count, transducer

    path = P.path(token_count.VOCABULARY)
    tok, rng = Tokenizer.from_file(path), random.Random(6)
    texts = ["a" * 9000, "".join(rng.choice("ab") for _ in range(9001)), "".join("ab"[i.bit_count() & 1] for i in range(1 << 14)), "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "é" * 5000 + "日本" * 3000, "-=" * 4097 + "!" * 5000]
    texts += ["the" * 3000 + " " + "xq" * 2500 + " short words", " " * 6000 + "x", "1234567890" * 1000]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for long, chunk, warm in ((4096, 1024, 64), (16, 7, 0), (16, 50, 3)):
        monkeypatch.setattr(transducer, "LONG", long)
        monkeypatch.setattr(transducer, "LONG_CHUNK", chunk)
        monkeypatch.setattr(transducer, "WARM", warm)
        c = transducer.Counter(transducer.counter(path).v)
        assert transducer.count_tokens([t.encode() for t in texts], c).tolist() == want
        assert transducer.count_tokens([t.encode() for t in texts], transducer.Counter(c.v, most=300)).tolist() == want


def test_blocks_are_read_from_checkpoint_to_checkpoint(monkeypatch):
    from sheaf.llm import rans, token_store

    rng = np.random.default_rng(7)
    monkeypatch.setattr(rans, "CHECK", 4)
    for lengths in ([0, 5000, 1, 0, 0, 700, 3, 0], [1], [0], [], [9000], [64] * 100):
        ids = rng.zipf(1.4, sum(lengths)).clip(1, 499).astype(np.uint32)
        table = rans.Table.of(np.bincount(ids, minlength=500) + 1)
        block = rans.encode(ids, table)
        kept = []
        got = token_store.checksums(token_store.sections(block, table), lengths, block.checksum, kept)
        ends = np.cumsum(lengths).astype(int)
        assert got == [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
        assert np.array_equal(np.concatenate([np.zeros(0, np.int64), *kept]), ids) and (len(ids) < 5000 or len(kept) > 3)
        with pytest.raises(ValueError):
            token_store.checksums(token_store.sections(block, table), lengths, block.checksum ^ 1)
