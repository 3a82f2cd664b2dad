"""Toxicity by a counterfactually regularised linear classifier.

The classifier is fitted on a bounded sample: the SAMPLE labelled rows with the smallest hash of their id. Features are the presence of
words and of word beginnings (PREFIX bytes), chosen by how strongly they go with label 1 (G statistic). The logistic loss gets two more
terms: weight decay, and for each sentence with an identity term the squared score change when that term is swapped for
another one of the list, averaged over these sentences. A swap changes the words and their beginnings, so the second term draws the summed weights of
the terms together and keeps neutral mentions of a group from raising the score.

Defined cases: null and empty texts are scored by the intercept alone; with no labelled rows, or only one class, the score is the smoothed base rate of 0.5 or that
class's; repeated label rows count each time; null labels are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import ALNUM, crc32_mod, parts, read, releasing, text_steps

SAMPLE, FEATURES, LEAST_DOCS, LEAST_G, PREFIX = 20_000, 4096, 3, 6.0, 5
FIT_ROUNDS, DECAY, COUNTERFACTUAL = 300, 1e-3, 1.0
#: Identity terms that are swapped for each other within a row: English, German, Spanish, French.
IDENTITY = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"), ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("old", "young", "elderly"), ("deaf", "blind", "disabled"),
    ("immigrant", "native", "foreign"), ("immigrants", "natives", "foreigners"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("christen", "muslime", "juden", "atheisten"), ("christlich", "muslimisch", "jüdisch"), ("einwanderer", "einheimische", "ausländer"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("chico", "chica"), ("cristiano", "musulmán", "judío", "ateo"), ("cristianos", "musulmanes", "judíos", "ateos"), ("inmigrantes", "nativos", "extranjeros"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("chrétien", "musulman", "juif", "athée"), ("chrétiens", "musulmans", "juifs", "athées"), ("immigrés", "natifs", "étrangers"),
)
OTHERS = {t.encode(): [o.encode() for o in row if o != t] for row in IDENTITY for t in row}


def features_of(text: bytes, known=None) -> set[bytes]:
    """Words, and beginnings of longer words as beginning + *; of long texts part by part. Only those among `known`, if given."""
    out: set[bytes] = set()
    for _, part in parts(text):
        words = set(part.translate(ALNUM).split())
        found = words | {w[:PREFIX] + b"*" for w in words if len(w) > PREFIX}
        out = out | found if known is None else out | (found & known)
    return out


def select_features(rows: DataFrame, most: int = FEATURES) -> list[bytes]:
    """The features of rows(text, y) that go with the label most strongly, by the G statistic, LEAST_G at least."""

    def scan(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            seen: dict[bytes, list[int]] = {}
            for i, texts in text_steps(batch, "text"):
                for text, label in zip(texts, y[i:], strict=False):
                    for f in features_of(text):
                        if (c := seen.get(f)) is None:
                            c = seen[f] = [0, 0]
                        c[label] += 1
                if len(seen) > 200_000:
                    yield counted(seen)
                    seen = {}
            yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["f", "n0", "n1"])

    total = rows.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    if not total.n0 or not total.n1:
        return []
    both = rows.select("text", "y").mapInArrow(scan, "f binary, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n, n1 = F.col("n0") + F.col("n1"), F.lit(float(total.n1 / (total.n0 + total.n1)))
    part = lambda seen, expected: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (n * expected))).otherwise(0.0)
    strength = part("n1", n1) + part("n0", 1 - n1)
    best = both.where((n >= LEAST_DOCS) & (F.col("n1") > n * n1)).select("f", strength.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "f").limit(most)
    return sorted({bytes(r.f) for r in best.collect()} | {t.encode() for row in IDENTITY for t in row})


def swaps(text: bytes, index: dict[bytes, int]) -> list[list[list[int]]]:
    """[features that go, features that come] when all mentions of a term become another term of its row, for each term and other term; the same of the words without beginnings."""
    words, out = set(text.translate(ALNUM).split()), []
    for term in sorted(words & OTHERS.keys()):
        had = features_of(text)
        for other in OTHERS[term]:
            # a beginning that another word has too stays, and one that the text has already doesn't come
            has = features_of(b" ".join(words - {term} | {other}))
            whole = [sorted(index[f] for f in had - has if f in index), sorted(index[f] for f in has - had if f in index)]
            words_only = [[index[f] for f in (term,) if f in index], [index[f] for f in (other,) if f in index and other not in words]]
            # the words alone too: other words have their beginnings, which then carry nothing either
            out += [whole] if whole == words_only else [whole, words_only]
    return out


def indexed(rows: DataFrame, features: list[bytes], columns: list[str]) -> DataFrame:
    """rows with columns kept, `at`: the indices of the features each text has, and `swaps`: what swaps() changes in them."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})
    indices = T.ArrayType(T.IntegerType())
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("at", indices), T.StructField("swaps", T.ArrayType(T.ArrayType(indices)))])

    def scan(batches):
        known = shared.value
        for batch in batches:
            at, changes = [], []
            for _, texts in text_steps(batch, "text"):
                for t in texts:
                    at.append(sorted(known[f] for f in features_of(t, known.keys())))
                    changes.append(swaps(t, known))
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(at, kinds), pa.array(changes, pa.list_(pa.list_(kinds)))], names=schema.names)

    return rows.select(*columns, "text").mapInArrow(scan, schema)


def train(at: list[list[int]], y: np.ndarray, features: list[bytes], changes: list[tuple[int, list[int], list[int]]], counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept, by gradient steps with momentum on the regularised loss; changes are (row, features that go, features that come)."""
    n, d = len(y), len(features)
    rows = np.repeat(np.arange(n), [len(x) for x in at])
    cols = np.array([i for x in at for i in x], np.int64)
    # features of the swapped sentences less those of the sentences, and the weight of each swap: the sentences with a mention weigh alike
    swap = np.repeat(np.arange(len(changes)), [len(out) + len(come) for _, out, come in changes])
    moved = np.array([i for _, out, come in changes for i in (*out, *come)], np.int64)
    sign = np.array([x for _, out, come in changes for x in (*[-1.0] * len(out), *[1.0] * len(come))])
    of = np.array([i for i, _, _ in changes], np.int64)
    share = 1 / (np.bincount(of, minlength=n)[of] * max(1, len(set(of.tolist()))))
    w, b = np.zeros(d), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb, rate = np.zeros(d), np.zeros(d), 0.0, 0.0, 0.1
    # both classes weigh alike
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for k in range(1, FIT_ROUNDS + 1):
        z = b + np.bincount(rows, w[cols], n)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(cols, err[rows], d) + DECAY * w
        if len(moved):
            change = 2 * counterfactual * share * np.bincount(swap, sign * w[moved], len(changes))
            g += np.bincount(moved, sign * change[swap], d)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        gb = err.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
        rate *= 0.99
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> tuple[list[bytes], np.ndarray, float]:
    """docs(doc_id, text), labels(doc_id, toxic) -> (features, weights, intercept)."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id", "y").limit(sample)
    # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    features = select_features(rows.select("text", "y"))
    if not features:
        rate = rows.agg(F.avg("y")).first()[0]
        return [], np.zeros(0), {None: 0.0, 0.0: -2.0}.get(rate, 2.0)
    got = indexed(rows, features, ["doc_id", "y"]).orderBy("doc_id", "y", "at").collect()
    changes = [(n, go, come) for n, r in enumerate(got) for go, come in r.swaps]
    w, b = train([r["at"] for r in got], np.array([r.y for r in got], float), features, changes, counterfactual)
    return features, w, b


def score(docs: DataFrame, model: tuple[list[bytes], np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with text, and one column more: the probability of label 1."""
    features, w, b = model
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(features, w.tolist(), strict=True)), b))
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def scan(batches):
        weights, b = shared.value
        has = weights.keys()
        for batch in batches:
            z = np.array([b + sum(sorted(weights[f] for f in features_of(t, has))) for _, texts in text_steps(batch, "text") for t in texts], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=schema.names)

    return docs.mapInArrow(releasing(scan), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc32_mod(key, 5) == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
