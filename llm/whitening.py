"""Embedding whitening on the distinct vectors: exact distributed covariance, mixed-precision eigenvectors, projection.

Entries become whole numbers, x = floor(steps * c) + shift, so sums, products and deviations are exact in integers and
do not depend on the order in which tasks end.

1. Distinct x-vectors are reduced in the tasks, then once more after one shuffle, and stored: the fit list.
2. n and the sums S come from one pass over it. Vectors are centred with whole numbers before they are multiplied:
   y = x - floor(S/n), and products of y are summed exactly; what is left of the mean (below one) is taken off the matrix.
   A task gives one half of a d x d matrix, whatever its number of rows; only the sum of them (d x d) reaches the driver.
3. The eigenvectors are refined there (``eigen``); d, not the data, sets the cost.
4. All rows are projected in the tasks; the covariance of the projections is measured over the fit list.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out, as are rows
whose length is not the most frequent one (of equally frequent ones the larger); entries above 2^40 in size count as non-finite. Repeated
rows and null ids are kept and projected each. A component whose eigenvalue is not above 1e-13 of the
trace has no rows, so a table with one distinct vector gives none; a deviation beyond a long is null. Extra columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import spread, stored
from llm.eigen import LONG, refined_eigen

STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a slice of a batch that becomes one matrix.
SLICE = 4096
WIDEST = float(1 << 40)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, steps: int, shift: int) -> DataFrame:
    """vec_id and x (array of long) of the rows that count."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda c: F.coalesce(F.abs(c) <= WIDEST, F.lit(False)) & ~F.isnan(c))
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(v) == F.lit(most["d"] if most else 0)).select("vec_id", F.transform(v, lambda c: (F.floor(c * steps) + shift).cast("long")).alias("x"))


def matrices(column: pa.Array):
    """Arrow lists of equal length as matrices of at most ``SLICE`` rows."""
    for at in range(0, len(column), SLICE):
        part = column.slice(at, SLICE)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(part), -1)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each dimension."""

    def work(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                n += len(x)
                total += x.sum(0).astype(object)  # below 2^62: SLICE rows of at most 2^47
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], ["n", "total"])

    parts = fit.select("x").mapInArrow(work, "n long, total array<string>")
    every = parts.select("n", F.posexplode("total").alias("dim", "t")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    found = {r["dim"]: r for r in every.collect()}
    return (int(found[0]["n"]), [int(found[k]["t"]) for k in range(d)]) if found else (0, [0] * d)


def gram(fit: DataFrame, middle: list[int]) -> list[list[int]]:
    """Sums of products of x - middle, exact, for all pairs of dimensions."""
    d = len(middle)
    at = np.array(middle, np.int64)
    upper = np.triu_indices(d)

    def work(batches):
        total = np.zeros(len(upper[0]), object)
        held, room = np.zeros((d, d)), 0.0
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                y = (x - at).astype(np.float64)
                # products of doubles are exact while every sum stays below 2^53
                most = float(np.abs(y).max()) ** 2 * len(y)
                if most >= 2.0**53:
                    whole = (x - at).astype(object)
                    total += (whole.T @ whole)[upper]
                    continue
                if room + most >= 2.0**53:
                    total += held[upper].astype(np.int64).astype(object)
                    held, room = np.zeros((d, d)), 0.0
                held += y.T @ y
                room += most
        total += held[upper].astype(np.int64).astype(object)
        some = [k for k, t in enumerate(total) if t]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([str(total[k]) for k in some])], ["k", "t"])

    parts = fit.select("x").mapInArrow(work, "k int, t string")
    out = [[0] * d for _ in range(d)]
    for row in parts.groupBy("k").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect():
        i, j = int(upper[0][row["k"]]), int(upper[1][row["k"]])
        out[i][j] = out[j][i] = int(row["t"])
    return out


def long_double(value: Fraction) -> LONG:
    """The long double nearest to a fraction, but for the last bits."""
    high = float(value)
    low = value - Fraction(high)
    return LONG(high) + LONG(float(low))


class Whitener:
    """n, sums, eigenvalues and the vectors that project a centred vector on components of variance one."""

    def __init__(self, fit: DataFrame, d: int, components: int):
        self.n, self.sums = sums(fit, d)
        n = max(self.n, 1)
        self.middle = [s // n for s in self.sums]
        self.rest = [s - n * m for s, m in zip(self.sums, self.middle, strict=True)]  # the mean is middle + rest / n
        products = gram(fit, self.middle)
        v = np.array([[long_double(Fraction(products[i][j] * n - self.rest[i] * self.rest[j], n * n)) for j in range(d)] for i in range(d)], LONG).reshape(d, d)
        e, x = refined_eigen(v)
        trace = np.trace(v) if d else LONG(0)
        kept = [k for k in range(min(components, d)) if trace > 0 and e[k] > trace * 1e-13]
        self.vectors = x[:, kept].astype(np.float64)
        self.eigenvalues = e[kept].astype(np.float64)
        self.explained = (e[kept] / trace).astype(np.float64) if kept else np.zeros(0)
        self.identity_error = measured_error(fit, self) if kept else 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.middle, np.int64)) - np.array(self.rest, np.float64) / max(self.n, 1)
        return (centred @ self.vectors) / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list:
        """Sum of (n * x - S)^2 of each row."""
        y = x - np.array(self.middle, np.int64)
        reach = float(np.abs(y).max() + 1) * self.n if y.size else 0.0
        if reach**2 * y.shape[1] < 2.0**62:
            y = y * self.n - np.array(self.rest, np.int64)
            return (y * y).sum(1).tolist()
        whole = y.astype(object) * self.n - np.array(self.rest, object)
        return [v if v < 1 << 63 else None for v in (whole * whole).sum(1).tolist()]


def measured_error(fit: DataFrame, model: Whitener) -> float:
    """The largest entry of the covariance of the projected fit list minus the identity."""
    k, project = model.vectors.shape[1], model.project

    def work(batches):
        n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                w = project(x)
                n, total, products = n + len(w), total + w.sum(0), products + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0] * (k + 1)), pa.array(list(range(k + 1)), pa.int32()), pa.array([total.tolist(), *products.tolist()])], ["n", "row", "v"])

    parts = fit.select("x").mapInArrow(work, "n long, row int, v array<double>")
    each = parts.select("row", F.posexplode("v").alias("col", "t")).groupBy("row", "col").agg(F.sum("t").alias("t"))
    table = np.zeros((k + 1, k))
    for r in each.collect():
        table[r["row"], r["col"]] = r["t"]
    mean = table[0] / model.n
    return float(np.abs(table[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, steps: int = STEPS, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation and the arrays ``whitened`` and ``explained`` (by component), identity_error: one row per row that counts."""
    rows = whole_vectors(vectors, id_col, vector_col, steps, shift)
    fit = stored(rows.select("x").distinct())
    head = fit.select(F.size("x").alias("d")).first()
    model = Whitener(fit, head["d"] if head else 0, components)
    n, explained, error = model.n, model.explained.tolist(), model.identity_error
    project, deviation = model.project, model.deviation

    def work(batches):
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                w = project(x)
                size = len(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, size), pa.array([n] * size), pa.array(deviation(x), pa.int64()), lists, pa.array([explained] * size, pa.list_(pa.float64())), pa.array([error] * size)],
                    ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return spread(rows).mapInArrow(work, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per row and component, components numbered from 1."""
    each = whitened.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error")
