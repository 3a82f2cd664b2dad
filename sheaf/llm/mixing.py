"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every source has a target in words; its documents share it in proportion, so each should be taken c = target / source size times.
floor(c) copies are sure; the fractions are rounded together. Two fractional documents play: mass moves
from one to the other, at random but fair in expectation, until one of them is integral (0 or 1), and the other goes on with the rest.
Mass is counted in words, so the words taken from a source differ from its target by less than one document.
Long documents play first, among themselves: those of 1 / HEADS[0] of their source or more, then those of 1 / HEADS[1], and so on. What the last of
such a class gains or loses by its own fair draw is moved to all shorter documents of the source in equal parts of their words. So the final difference
is that of a document of the last class that a source has (as far as shorter documents hold enough to take what is moved: their chances stay within 0 and 1).

The games form a reduction tree. Documents fall by hash into blocks of about BLOCK per source; each block is folded to
one residual by an array aggregate; residuals are blocks of the next, 32 times smaller level. The depth is logarithmic and
no task sees more than blocks. All random numbers are hashes of ids, so reruns agree.

Defined cases: null text has size 0 and is taken 0 words; null sources are one source, last in order; repeated rows
(same id, source and size) share one decision; a source of size 0 has target 0. With no words at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sheaf.llm.common import SEED, WORD, cut, fresh, read

#: HEADS: documents of 1 / HEADS[0] of their source or more are settled first, then those of 1 / HEADS[1], ...; a source has so many of them at most.
WEIGHTS, MOST, BLOCK, HEADS = (5, 2, 1), 3, 32, (32, 256, 2048)


def key_of(source: Column) -> Column:
    """The source as a string that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(s, size, m) -> a row per source: s, source_size, units, target.

    The shares of all words by weight, limited to `most` times the source, are a water level: target = min(limit, level * weight).
    With sources in order of limit / weight, the level is the first one that its own source's limit doesn't cut.
    One row per source goes through the windows.
    """
    per = sizes.groupBy("s").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    ranked = per.withColumn("__rank", F.row_number().over(Window.orderBy(F.when(F.col("s") == "", 1).otherwise(0), "s")) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__limit", F.col("source_size") * most).withColumn("__r", F.col("__limit") / F.col("__w"))
    order = Window.orderBy("__r", "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0))
    ranked = ranked.withColumn("__level", left / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))))
    level = F.min_by(F.when(F.col("__level") <= F.col("__r"), F.col("__level")), F.when(F.col("__level") <= F.col("__r"), F.struct("__r", "__rank"))).over(every)
    ranked = ranked.withColumn("__final", level)
    target = F.when(F.col("__level") <= F.col("__r"), F.col("__w") * F.col("__final")).when(F.col("__r") <= F.col("__final"), F.col("__limit").cast("double")).otherwise(F.col("__w") * F.col("__final"))
    return ranked.select("s", "source_size", "units", F.coalesce(target, F.lit(0.0)).alias("target"))


#: One game of the fold: acc.cur plays y. up/dn: the words that each may gain or lose before it is integral.
GAME = """
aggregate(slice(units, 2, size(units)), named_struct('cur', units[0], 'done', slice(units, 1, 0)),
 (acc, y) -> transform(array(named_struct('x', acc.cur, 'up1', (1 - acc.cur.p) * acc.cur.w, 'dn1', acc.cur.p * acc.cur.w, 'up2', (1 - y.p) * y.w, 'dn2', y.p * y.w,
    'u', pmod(xxhash64({seed}, acc.cur.doc_id, acc.cur.size, y.doc_id, y.size), 9007199254740992) / 9007199254740992D)),
  g -> if(g.u * (least(g.up1, g.dn2) + least(g.dn1, g.up2)) < least(g.dn1, g.up2),
     if(g.up1 <= g.dn2, named_struct('cur', {y_left_up}, 'done', array_append(acc.done, {x_is_1})), named_struct('cur', {x_up}, 'done', array_append(acc.done, {y_is_0}))),
     if(g.dn1 <= g.up2, named_struct('cur', {y_up}, 'done', array_append(acc.done, {x_is_0})), named_struct('cur', {x_down}, 'done', array_append(acc.done, {y_is_1})))))[0])
"""
UNIT = T.StructType([T.StructField(c, t) for c, t in (("o", T.LongType()), ("h", T.LongType()), ("doc_id", T.LongType()), ("size", T.LongType()), ("m", T.LongType()), ("base", T.LongType()), ("w", T.DoubleType()), ("p", T.DoubleType()))])


def unit(name: str, p: str) -> str:
    fields = ", ".join(f"'{f.name}', {name}.{f.name}" for f in UNIT.fields if f.name != "p")
    return f"named_struct({fields}, 'p', {p})"


def fold(seed: int) -> Column:
    return F.expr(GAME.format(
        seed=seed, y_left_up=unit("y", "(g.dn2 - g.up1) / y.w"), x_is_1=unit("g.x", "1D"), x_up=unit("g.x", "(g.dn1 + g.dn2) / g.x.w"), y_is_0=unit("y", "0D"),
        y_up=unit("y", "(g.dn2 + g.dn1) / y.w"), x_is_0=unit("g.x", "0D"), x_down=unit("g.x", "(g.dn1 - g.up2) / g.x.w"), y_is_1=unit("y", "1D"),
    ))


def rounded(units: DataFrame, most_units: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """units(s, doc_id, size, m, base, w, p) with p between 0 and 1, w words -> the same rows with p rounded to 0 or 1."""
    bits = max(0, math.ceil(math.log2(max(1, most_units) / block)))
    rows = units.select("s", F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"), "doc_id", "size", "m", "base", "w", "p").cast(UNIT).alias("unit"))
    done = []
    while True:
        # the block's name is a string of its own, so that no partitioning by source is taken over
        name = F.concat_ws(" ", F.pmod(F.col("unit.h"), F.lit(1 << bits)), "s")
        blocks = rows.groupBy(name.alias("block")).agg(F.first("s").alias("s"), F.array_sort(F.collect_list("unit")).alias("units"))
        folded = cut(blocks.select("s", fold(seed).alias("f")))
        done.append(folded.select("s", F.explode("f.done").alias("unit")))
        rows = folded.select("s", F.col("f.cur").alias("unit"))
        if not bits:
            break
        bits = max(0, bits - 5)
    out = rows.select("s", F.col("unit").withField("p", F.when(chance_of("unit", seed) < F.col("unit.p"), 1.0).otherwise(0.0)).alias("unit"))
    for x in done:
        out = out.unionByName(x)
    return out.select("s", "unit.doc_id", "unit.size", "unit.m", "unit.base", "unit.p")


def settle_heads(units: DataFrame, share: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """units(s, ..., p, source_size) -> (documents of 1 / share of their source or more with p rounded, the others with p shifted by what these leave)."""
    head = F.col("w") * share >= F.col("source_size")
    pack = F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"), "doc_id", "size", "m", "base", "w", "p").cast(UNIT)
    heads = units.where(head).select(F.concat_ws(" ", F.lit("h"), "s").alias("block"), "s", pack.alias("unit"))
    folded = cut(heads.groupBy("block").agg(F.first("s").alias("s"), F.array_sort(F.collect_list("unit")).alias("units")).select("s", fold(seed).alias("f")))
    last = folded.select("s", F.col("f.cur").withField("p", F.when(chance_of("f.cur", seed) < F.col("f.cur.p"), 1.0).otherwise(0.0)).alias("unit"), ((F.col("f.cur.p") - F.when(chance_of("f.cur", seed) < F.col("f.cur.p"), 1.0).otherwise(0.0)) * F.col("f.cur.w")).alias("left"))
    settled = last.select("s", "unit").unionByName(folded.select("s", F.explode("f.done").alias("unit"))).select("s", "unit.doc_id", "unit.size", "unit.m", "unit.base", "unit.p")
    rest = units.where(~head)
    mass = rest.groupBy("s").agg(F.sum("w").alias("mass"))
    shift = cut(mass.join(last, "s").select("s", (F.col("left") / F.col("mass")).alias("shift")))
    moved = rest.join(shift, "s", "left").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce("shift", F.lit(0.0)))))
    return settled, moved.drop("shift")


def chance_of(unit: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(unit + ".doc_id"), F.col(unit + ".size")), F.lit(1 << 53)) / float(1 << 53)


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source) -> one row for each different (s, doc_id, size): m rows of docs are like it; copies each is taken; source_size, target."""
    sizes = docs.select(key_of(F.col("source")).alias("s"), F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"))
    sizes = cut(sizes.groupBy("s", "doc_id", "size").agg(F.count("*").alias("m")))
    plan = cut(targets(sizes, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(plan.select("s", "source_size", ratio.alias("c")), "s").withColumn("base", F.floor("c"))
    rows = rows.select("s", "source_size", "doc_id", "size", "m", "base", (F.col("size") * F.col("m")).cast("double").alias("w"), (F.col("c") - F.col("base")).alias("p"))
    open_ = (F.col("p") > 0) & (F.col("w") > 0)
    sure = rows.where(~open_).select("s", "doc_id", "size", "m", "base", F.lit(0.0).alias("p"))
    most_units = plan.agg(F.max("units")).first()[0] or 0
    others, both = rows.where(open_), sure
    for share in HEADS:
        settled, others = settle_heads(others, share, seed)
        both = both.unionByName(settled)
    # a shift may have made chances whole
    whole = F.col("p").isin(0.0, 1.0)
    both = both.unionByName(others.where(whole).select("s", "doc_id", "size", "m", "base", "p")).unionByName(rounded(others.where(~whole), most_units, seed))
    return both.select("s", "doc_id", "size", "m", (F.col("base") + F.col("p")).cast("long").alias("copies")).join(plan.drop("units"), "s")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it; columns stay."""
    s, i, n, copies, key, words = (fresh(docs, x) for x in ("__s", "__id", "__size", "__copies", "__key", "__words"))
    plan = cut(decide(docs, **options).where("copies > 0").select(F.col("s").alias(s), F.col("doc_id").alias(i), F.col("size").alias(n), F.col("copies").alias(copies)))
    keyed = docs.withColumns({key: key_of(F.col("source")), words: size_of(F.col("text"))})
    met = keyed.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(words) == F.col(n)) & (F.col(key) == F.col(s)))
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copies)).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = decide(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("__row"))
    return rows.drop("__row")
