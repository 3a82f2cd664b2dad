"""Embedding whitening: an exact centre, the covariance by MLlib's RowMatrix, a local eigendecomposition, and the whitened rows in mapInPandas.

Entries are scaled to whole numbers x = floor(SCALE * c) + SHIFT. The model is fitted on each different x vector once: n vectors with sums S.
1. n, S and the largest |x| are exact aggregates.
2. Rows are centred before anything is multiplied, as (n * x - S) / n with an exact whole numerator, so the shift costs no digits.
   RowMatrix.computeGramianMatrix of the centred rows, divided by n, is the covariance V; only the d x d matrix comes to the driver.
3. numpy's eigh gives the components, by falling eigenvalue; each one's sign makes its largest entry positive.
4. The components over the roots of their eigenvalues (d x k numbers) are broadcast, and each batch of rows is projected in mapInPandas.
5. The fit list is whitened too and its covariance measured by a second RowMatrix.

Defined cases: rows whose vector is null or has null or non-finite entries take no part; empty vectors neither, nor vectors of another length than most
vectors have (of equally many, the shorter ones count), as they have no covariance with the rest. Scaled entries beyond +-LARGEST count as
+-LARGEST. A null vec_id stays a row; rows that repeat are each returned. A component without variance (at most d * 2^-52 of the largest, so all of them
if n is 1) can't be whitened: its `whitened` is null and it counts neither in identity_error nor as explained (0.0; null if nothing varies at all).
With no row left the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import read, stored

SCALE, SHIFT, COMPONENTS, LARGEST = 64, 1_000_000, 16, 1 << 52
#: Whole numbers up to this size are worked on as 64-bit ones.
WIDE = 1 << 62


def usable(vector: str) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(F.col(vector), entry), F.lit(False))


def scaled(vector: str, scale: int, shift: int) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * scale))) + F.lit(shift).cast("long"))


@dataclass
class Whitening:
    """n fit vectors with sums; components (d, k) as unit columns, their eigenvalues and the trace; usable: which of the k vary; identity_error once measured."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def varies(self) -> np.ndarray:
        return self.eigenvalues > len(self.sums) * 2.0**-52 * max(self.eigenvalues.max(initial=0.0), 0.0)


def numerators(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where they suffice, Python's otherwise."""
    if 2 * n * max(1, largest) < WIDE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The Gramian matrix of an array<double> column."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def centre(fit_list: DataFrame, n: int, sums: list[int], largest: int) -> DataFrame:
    """fit_list(x) -> v array<double>: (n * x - S) / n, the numerator exact."""
    kind = "bigint" if 2 * n * max(1, largest) < WIDE else "decimal(38,0)"
    factor = "bigint" if kind == "bigint" else "decimal(18,0)"
    s = F.array(*[F.lit(str(v)) for v in sums]).cast(f"array<{kind}>")
    return fit_list.select(F.zip_with("x", s, lambda x, t: (x.cast(factor) * F.lit(n).cast(factor) - t).cast("double") / F.lit(float(n))).alias("v"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows(x array<long>) of one length -> the whitening of their different vectors; None if there are none."""
    fit_list = stored(rows.select("x").distinct(), "whitening")
    n, largest, d = fit_list.agg(F.count("*"), F.max(F.array_max(F.transform("x", F.abs))), F.max(F.size("x"))).first()
    if not n:
        return None
    entry = F.col("c") if n * largest < WIDE else F.col("c").cast("decimal(38,0)")
    found = fit_list.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(entry).alias("s")).collect()  # d rows
    sums = [0] * d
    for r in found:
        sums[r.at] = int(r.s)
    v = gramian(centre(fit_list, n, sums, largest), "v") / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    model = Whitening(n, sums, largest, vectors, values[order], float(np.trace(v)))
    varies = model.varies
    model.identity_error = 0.0
    if varies.any():
        white = project(fit_list, model).select(F.array(*[F.col("whitened")[int(i)] for i in np.flatnonzero(varies)]).alias("v"))
        model.identity_error = float(np.abs(gramian(white, "v") / n - np.eye(int(varies.sum()))).max())
    return model


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows(x, ...) -> their other columns, deviation decimal(38,0) and whitened array<double>, null for components that don't vary."""
    others = [c for c in rows.columns if c != "x"]
    weights = model.components / np.sqrt(np.where(model.varies, model.eigenvalues, 1.0))
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.largest, weights, model.varies))

    def scan(batches):
        n, sums, largest, weights, varies = shared.value
        for batch in batches:
            out = batch[others].copy()
            if len(batch):
                top = numerators(np.stack(batch["x"].to_list()), n, sums, largest)
                exact = top.astype(object) if len(sums) * int(max(abs(top.min()), abs(top.max()))) ** 2 >= WIDE else top
                white = (top / n).astype(np.float64) @ weights
                out["deviation"] = [int(v) for v in (exact * exact).sum(axis=1)]
                out["whitened"] = list(white) if varies.all() else [[float(v) if ok else None for v, ok in zip(r, varies, strict=True)] for r in white]
            else:
                out["deviation"], out["whitened"] = pd.Series(dtype=object), pd.Series(dtype=object)
            out["deviation"] = [str(v) for v in out["deviation"]]
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["deviation string", "whitened array<double>"])
    return rows.mapInPandas(scan, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def prepare(df: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """df with `vector` replaced by x, its entries as whole numbers; rows that take no part are left out."""
    rows = df.where(usable(vector)).withColumn("x", scaled(vector, scale, shift)).drop(vector)
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == usual.d) if usual else rows


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """df(key, vector, ...) -> (key, deviation decimal(38,0) or null beyond it, whitened array<double>; the model). Other columns are left out."""
    rows = prepare(df.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")), "vector")
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"), None
    return project(rows, model).withColumnRenamed("vec_id", key), model


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    if model is None:
        model = Whitening(0, [], 0, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    # a number for each of COMPONENTS components
    explained = F.array(*[F.lit(float(e / model.trace) if ok else 0.0) for e, ok in zip(model.eigenvalues, model.varies, strict=True)]) if model.trace > 0 else F.lit(None).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
