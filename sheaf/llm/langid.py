"""Language identification by multilingual mixture inference.

Training counts hashed character n-grams (n = 1 to 3 code points, within words) per language over a bounded, hash-chosen sample of labelled
documents (SAMPLE rows in expectation). A document is modelled as a mixture: each of its words was drawn from one
language, whose n-grams give the word's likelihood. Expectation-maximisation estimates the
proportions; the language set is chosen by the likelihood less PENALTY * log(words) for each language. Languages are dropped, the weakest first and
several at once, as long as that raises it: from the responsibilities follows what the likelihood is at least without
them, so no set has to be fitted only to be turned down. At the end the weakest language is tried with a fit of its own.
The prediction is the language with the largest proportion, and the score is that proportion.

Words that repeat within a text count by their number, so the work is that of different words; their likelihoods are kept in a
bounded table. Long texts are read in parts: PART bytes at a time give different words with counts, and a first pass over the parts leaves out languages
that are far worse than the best one on every part's words. The model holds NUMBERS numbers at most however many languages there are: n-gram
buckets become fewer with more of them, and every labelled language stays.

Defined cases: a null text or one without a letter is `und` with score 0; with no labelled row at all everything is `und`; letters of scripts that were
never seen still give a learned language, by the smoothed likelihoods; ties go to the language that sorts first. Repeated rows count each time.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import character_end, crc32_mod, parts, read, releasing, text_steps

SAMPLE = 20_000
#: Hash buckets of n-grams for up to NUMBERS / BUCKETS languages; half as many for twice the languages.
BUCKETS, NUMBERS = 1 << 16, 1 << 24
ROUNDS, PENALTY, SMOOTH = 12, 1.0, 0.1
#: Likelihoods of a word are at least exp(-FAR) of its best language's.
FAR = 60.0
#: A document whose leading language explains less than this share of its words is rejected as a mix of all.
LEAST_SHARE = 0.3
#: Bytes of a long text that are worked on at once; words in a worker's table, and numbers in it and in what is worked on.
PART, WORDS, TABLE = 1 << 20, 1 << 17, 1 << 20
LETTER = regex.compile(r"\p{L}")
#: Bytes of a piece of a run of letters: longer runs count as several words, at any length of text.
PIECE = 48
_RUN = re.compile(rb"[^ ]{%d,}" % (PIECE + 1))

#: Bytes that stand inside words: letters, and the bytes of non-ASCII characters. A-Z are lower-cased; what else there is becomes a word end.
_WORD = bytearray(32 for _ in range(256))
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
_WORD = bytes(_WORD)


def words_of(text: bytes) -> Counter:
    """The different words of a text and how often each comes; of longer runs of letters, as unspaced scripts have them, the pieces."""
    return Counter(_RUN.sub(pieces, text.translate(_WORD)).split())


def pieces(run: re.Match) -> bytes:
    """A run in pieces of about PIECE bytes, cut between characters."""
    text, at, out = run.group(), 0, []
    while at < len(text):
        end = character_end(text, at + PIECE)
        out.append(text[at:end])
        at = end
    return b" ".join(out)


def grams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets (3, n), ends) of a list of words: at each letter, and at the space that ends a word, the n-grams that end there.

    n-grams reach back over the space before the word at most; those that end on the closing space tell how words end.
    """
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two, three = np.zeros_like(data), np.zeros_like(data)
    two[1:] = data[1:] | data[:-1] << np.uint64(21)
    three[2:] = two[2:] | data[:-2] << np.uint64(42)
    three[1] = two[1] | np.uint64(32 << 42)
    # the first letter of a word has no third one before it
    first = np.flatnonzero(data[:-1] == 32) + 1
    three[first] = two[first] | np.uint64(32 << 42)
    mixed = [((x[1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets) for n, x in ((1, data), (2, two), (3, three))]
    return np.stack(mixed).astype(np.int64), np.flatnonzero(data[1:] == 32)


def count_grams(rows: DataFrame, langs: list[str], buckets: int) -> np.ndarray:
    """Counts (languages, buckets) of rows(lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(langs)})

    def scan(batches):
        order = shared.value
        found: dict[int, np.ndarray] = {}

        def counted():
            for k, counts in found.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["k", "b", "n"])
            found.clear()

        for batch in batches:
            lang = [order[x] for x in batch.column(0).to_pylist()]
            for i, texts in text_steps(batch, "text"):
                words: dict[int, Counter] = {}
                for text, k in zip(texts, lang[i : i + len(texts)], strict=True):
                    own = words.setdefault(k, Counter())
                    for _, part in parts(text, PART, within=True):
                        own.update(words_of(part))
                for k, own in words.items():
                    if own:
                        hashed, ends = grams(list(own), buckets)
                        weight = np.repeat(np.fromiter(own.values(), np.float64, len(own)), np.diff(np.concatenate(([-1], ends))))
                        found[k] = found.get(k, 0) + np.bincount(hashed.ravel(), np.tile(weight, 3), buckets).astype(np.int64)
            if len(found) * buckets > 4 * TABLE:
                yield from counted()
        yield from counted()

    out = np.zeros((len(langs), buckets), np.float32)
    # NUMBERS rows at most
    for row in rows.select("lang", "text").mapInArrow(releasing(scan), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.k, row.b] = row.n
    return out


def fit(rows: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """rows(key, text, lang) -> (languages, log likelihoods (buckets, languages))."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    per = known.groupBy("lang").agg(F.count("*").alias("__n"))
    langs = sorted(r.lang for r in per.select("lang").toLocalIterator())
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    buckets = BUCKETS
    while buckets * len(langs) > NUMBERS and buckets > 256:
        buckets //= 2
    # up to an equal share of the sample for each language, chosen by hash of the key; one row per language is broadcast
    share = max(1, sample // len(langs))
    chance = per.select("lang", F.least(F.lit(1.0), share / F.col("__n")).alias("__chance"))
    chosen = known.join(F.broadcast(chance), "lang").where(F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1_000_000)) < F.col("__chance") * 1_000_000)
    counts = count_grams(chosen, langs, buckets)
    counts += SMOOTH
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True, dtype=np.float64)).T.astype(np.float32).copy()


class Likelihoods:
    """Words -> the likelihood of each language as a part of that of the word's best one, (L, words); words already seen are looked up."""

    def __init__(self, logs: np.ndarray):
        self.logs, self.most = logs, max(1024, min(WORDS, TABLE // max(1, logs.shape[1])))
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, logs.shape[1]), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.at, new = {}, list(dict.fromkeys(words))
        for a in range(0, len(new), 4096):
            self.add(new[a : a + 4096])
        return np.ascontiguousarray(self.rows[list(map(self.at.__getitem__, words))].T)

    def add(self, new: list[bytes]) -> None:
        hashed, ends = grams(new, len(self.logs))
        sums = np.add.reduceat(self.logs[hashed[0]] + self.logs[hashed[1]] + self.logs[hashed[2]], np.concatenate(([0], ends[:-1] + 1)), axis=0)
        k = len(self.at)
        while k + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[k : k + len(new)] = np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -FAR))
        self.at.update(zip(new, range(k, k + len(new)), strict=True))


def mixture(like: np.ndarray, n: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over the different words of several documents: like (L, words), n times each, sizes: different words of each document, allowed (docs, L).

    -> proportions, log likelihoods
    """
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(n, starts)
    theta = (allowed / allowed.sum(axis=1, keepdims=True)).T
    for _ in range(rounds):
        part = like * np.repeat(theta, sizes, axis=1)
        part *= n / part.sum(axis=0)
        theta = np.add.reduceat(part, starts, axis=1) / total
    words = np.log((like * np.repeat(theta, sizes, axis=1)).sum(axis=0))
    return theta.T, np.add.reduceat(n * words, starts)


def dropped(like: np.ndarray, n: np.ndarray, sizes: np.ndarray, theta: np.ndarray, value: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which languages of each document may go: the number of weakest ones whose absence raises the penalised likelihood most, by its value before a new fit."""
    n_docs, n_langs = theta.shape
    if n_langs == 1:
        return np.zeros(theta.shape, bool)
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(n_docs), sizes)
    order = np.argsort(theta, axis=1, kind="stable")
    ranked = np.take_along_axis(theta, order, axis=1).T
    # words' likelihoods without the weakest language, without the two weakest, ...: sums from the strongest on
    part = np.take_along_axis(like, order.T[:, doc], axis=0) * ranked[:, doc]
    rest = np.cumsum(part[::-1], axis=0)[::-1][1:]
    mass = np.cumsum(ranked[::-1], axis=0)[::-1][1:]
    with np.errstate(divide="ignore"):
        without = np.add.reduceat(n * np.log(rest), starts, axis=1) - np.add.reduceat(n, starts) * np.log(mass)
    gain = (without - value + cost * np.cumsum(ranked > 0, axis=0)[:-1]).T
    best = gain.argmax(axis=1)
    pays = gain[np.arange(n_docs), best] >= 0
    out = np.zeros(theta.shape, bool)
    np.put_along_axis(out, order, (np.arange(n_langs)[None, :] <= best[:, None]) & pays[:, None], axis=1)
    return out & (theta > 0)


def chosen_sets(like: np.ndarray, n: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (docs, L) of the language sets with the best penalised likelihood found; like (L, words)."""
    sizes = np.asarray(sizes)
    cost = penalty * np.log(np.add.reduceat(n, np.cumsum(sizes) - sizes) + 1.0)
    allowed = np.ones((len(sizes), len(like)))
    theta, value = mixture(like, n, sizes, allowed)
    number = lambda x: (x > 0).sum(axis=1)
    open_ = np.arange(len(sizes))
    words, many = like, n
    while len(open_):
        out = dropped(words, many, sizes[open_], theta[open_], value[open_], cost[open_])
        # where nothing goes by the bound, the weakest language is tried with a fit
        trial = allowed[open_] * ~out
        few = ~out.any(axis=1) & (number(trial) > 1)
        weak = np.where(trial > 0, theta[open_], np.inf).argmin(axis=1)
        trial[few, weak[few]] = 0
        some = out.any(axis=1) | few
        if not some.any():
            break
        if not some.all():
            keep = np.repeat(some, sizes[open_])
            words, many, open_, trial = words[:, keep], many[keep], open_[some], trial[some]
        new, ll = mixture(words, many, sizes[open_], trial)
        better = ll - cost[open_] * number(trial) >= value[open_] - cost[open_] * number(allowed[open_])
        took = open_[better]
        allowed[took], theta[took], value[took] = trial[better], new[better], ll[better]
        if not better.all():
            keep = np.repeat(better, sizes[open_])
            words, many = words[:, keep], many[keep]
        open_ = took
    return theta


def infer(texts: list[bytes], logs: np.ndarray, penalty: float = PENALTY, table: Likelihoods | None = None) -> np.ndarray:
    """Proportions (texts, languages) of the chosen language sets; zeros where a text has no word."""
    out = np.zeros((len(texts), logs.shape[1]))
    if not logs.shape[1]:
        return out
    table = table or Likelihoods(logs)
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PART:
            out[i] = infer_long(text, table, penalty)
            continue
        if words := words_of(text):
            held.append((i, words))
            size += len(words)
        if size * logs.shape[1] > TABLE // 8:
            infer_some(held, table, penalty, out)
            held, size = [], 0
    if held:
        infer_some(held, table, penalty, out)
    return out


def infer_some(held: list[tuple[int, Counter]], table: Likelihoods, penalty: float, out: np.ndarray) -> None:
    words = [w for _, own in held for w in own]
    n = np.array([k for _, own in held for k in own.values()], np.float64)
    out[[i for i, _ in held]] = chosen_sets(table.of(words), n, [len(own) for _, own in held], penalty)


def infer_long(text: bytes, table: Likelihoods, penalty: float) -> np.ndarray:
    """Proportions of one long text. Languages that no part's words need are left out before the likelihoods of all parts are held together."""
    out, needed = np.zeros(table.logs.shape[1]), np.zeros(table.logs.shape[1], bool)
    for _, part in parts(text, PART, within=True):
        if words := words_of(part):
            needed |= chosen_sets(table.of(list(words)), np.fromiter(words.values(), np.float64, len(words)), [len(words)], penalty)[0] > 0
    if not needed.any():
        return out
    like, n = [], []
    for _, part in parts(text, PART, within=True):
        if words := words_of(part):
            like.append(table.of(list(words))[needed])
            n.append(np.fromiter(words.values(), np.float64, len(words)))
    out[needed] = chosen_sets(np.concatenate(like, axis=1), np.concatenate(n), [sum(map(len, n))], penalty)[0]
    return out


def has_letter(text: bytes) -> bool:
    return any(LETTER.search(part.decode("utf-8", "replace")) for _, part in parts(text, PART, within=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with text, and two columns more: the predicted language and its proportion."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def scan(batches):
        langs, logs = shared.value
        table = Likelihoods(logs)
        for batch in batches:
            pred, score = [], []
            for _, texts in text_steps(batch, "text", PART):
                theta = infer(texts, logs, table=table)
                for text, row in zip(texts, theta, strict=True):
                    letters = bool(langs) and has_letter(text)
                    k = int(row.argmax()) if letters else -1
                    pred.append(langs[k] if letters else "und")
                    score.append(min(1.0, max(0.0, float(row[k]))) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(releasing(scan), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc32_mod(key, 3) == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
