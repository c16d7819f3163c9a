"""Exact nearest neighbours by squared L2 distance."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nlsql_spark.session import materialize

BLOCK_QUERIES = 4_096
BLOCK_DOCS = 65_536
# numbers held by one distance matrix or candidate table inside a task (64 MB)
MATRIX_CELLS = 8_000_000
MOST_PIVOTS = 512
_HITS = "query_id long, doc_id long, distance double"


def _exact_top(queries: np.ndarray, near: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int):
    """(row, doc place, distance) of the k nearest candidates per row, by exact distance and then id."""
    rows, picked = np.nonzero(near)
    exact = ((docs[picked] - queries[rows]) ** 2).sum(1)
    order = np.lexsort((doc_ids[picked], exact, rows))
    rows, picked, exact = rows[order], picked[order], exact[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], picked[best], exact[best]


def _block_top(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest docs of each query in one block; ties go to the lower id.

    A matrix product only picks candidates (with some slack for rounding). Queries go in slices that
    bound the matrix, and again by their number of candidates: many copies of a doc make many ties.
    """
    kept = min(k, len(doc_ids))
    norms = (docs**2).sum(1)[None, :]
    found: list[pd.DataFrame] = []
    step = max(1, MATRIX_CELLS // len(doc_ids))
    for at in range(0, len(query_ids), step):
        part, ids = queries[at : at + step], query_ids[at : at + step]
        approx = (part**2).sum(1)[:, None] + norms - 2.0 * part @ docs.T
        border = np.partition(approx, kept - 1, axis=1)[:, kept - 1 : kept]
        near = approx <= border + 1e-9 * (1.0 + np.abs(border))
        share = np.cumsum(near.sum(1)) * docs.shape[1] // MATRIX_CELLS
        for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(share)) + 1):
            r, d, x = _exact_top(part[rows], near[rows], docs, doc_ids, kept)
            found.append(pd.DataFrame({"query_id": ids[rows][r], "doc_id": doc_ids[d], "distance": x}))
    return pd.concat(found, ignore_index=True)


def _local_search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    """A partition scan that keeps the k best docs per query over all its batches."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if batch.empty:
                continue
            docs = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            found = _block_top(queries, query_ids, docs, batch["example_id"].to_numpy(), k)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "distance", "doc_id"]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return search


def _block_search(k: int):
    """The same for one block of queries against one block of docs."""

    def search(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ds.empty:
            return pd.DataFrame(
                {"query_id": np.array([], "int64"), "doc_id": np.array([], "int64"), "distance": np.array([], "float64")}
            )
        docs, doc_ids = np.stack(ds["embedding"].to_numpy()).astype(np.float64), ds["example_id"].to_numpy()
        queries, query_ids = np.stack(qs["embedding"].to_numpy()).astype(np.float64), qs["example_id"].to_numpy()
        return _block_top(queries, query_ids, docs, doc_ids, k)

    return search


class Cells:
    """Pivots with the cells around them: each doc belongs to its nearest pivot. ``n`` docs and radius ``r`` per cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.norms = (pivots**2).sum(1)
        self.apart = np.sqrt(np.maximum(self.norms[:, None] + self.norms[None, :] - 2 * pivots @ pivots.T, 0))
        self.n, self.r = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.norms[None, :] - 2.0 * x @ self.pivots.T, 0))

    def nearest_cells(self, d: np.ndarray, k: int) -> np.ndarray:
        """Per query the nearest cells that hold ``k`` docs together (all cells if there are fewer docs)."""
        order = np.argsort(np.where(self.n > 0, d, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        chosen = np.zeros(d.shape, bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen & (self.n > 0)

    def cells_in_reach(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Per query the cells that can hold a doc no further than ``reach``.

        By the triangle inequality the docs of a cell are at least d - r away; and a doc that is nearer to pivot j than to the
        query's own pivot i lies behind the plane between them, (d_j^2 - d_i^2) / 2 |p_i p_j| away.
        """
        own = np.where(self.n > 0, d, np.inf).argmin(1)
        near = d[np.arange(len(d)), own][:, None]
        gap = self.apart[own]
        plane = np.where(gap > 0, (d**2 - near**2) / np.where(gap > 0, 2 * gap, 1), 0)
        least = np.maximum(d - self.r, plane)
        return (self.n > 0) & (least <= reach[:, None] + 1e-6 * (1 + d + reach[:, None]))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def voronoi_cells(docs: DataFrame, most: int = MOST_PIVOTS) -> tuple[DataFrame, Cells]:
    """Stored docs with ``cell``, and the cells. Pivots are docs drawn by a hash of their id, about the root of their number."""
    vectors = docs.select("example_id", "embedding")
    wanted = min(most, max(1, math.isqrt(vectors.count())))
    drawn = vectors.orderBy(F.xxhash64("example_id"), "example_id").limit(wanted).toPandas()
    cells = Cells(np.unique(_matrix(drawn["embedding"]), axis=0) if len(drawn) else np.zeros((1, 1)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, MATRIX_CELLS // len(cells.pivots))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                d = cells.distances(_matrix(part["embedding"]))
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype("int32"), away=d[np.arange(len(part)), cell])

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = materialize(vectors.mapInPandas(assign, f"example_id long, embedding {kind}, cell int, away double"))
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        cells.n[row["cell"]], cells.r[row["cell"]] = row["n"], row["r"]
    return placed.drop("away"), cells


def _meet(queries: DataFrame, docs: DataFrame, cells: Cells, choose, k: int, block_queries: int, block_docs: int) -> DataFrame:
    """The ``k`` nearest docs of each query in each cell that ``choose`` gives for it.

    Docs stand once, in parts of a cell; only where very many queries come to one cell they stand once per block of queries.
    """
    kind = queries.schema["embedding"].dataType.simpleString()

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, MATRIX_CELLS // len(cells.pivots))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                row, cell = np.nonzero(choose(cells.distances(_matrix(part["embedding"])), part))
                if len(row):
                    yield part[["example_id", "embedding"]].iloc[row].assign(cell=cell.astype("int32"))

    sent = materialize(queries.mapInPandas(send, f"example_id long, embedding {kind}, cell int"))
    asked = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
    blocks = [(c, math.ceil(n / block_queries), math.ceil(int(cells.n[c]) / block_docs)) for c, n in asked.items()]
    # one row per cell, at most as many as pivots
    shape = F.broadcast(queries.sparkSession.createDataFrame(blocks, "cell int, q_blocks int, d_parts int"))
    block = lambda n, salt: F.pmod(F.xxhash64("example_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    on = ["cell", "qb", "dp"]
    q = sent.join(shape, "cell").select("example_id", "embedding", "cell", block("q_blocks", 1).alias("qb"), every("d_parts").alias("dp"))
    d = docs.join(shape, "cell").select("example_id", "embedding", "cell", every("q_blocks").alias("qb"), block("d_parts", 2).alias("dp"))
    return q.groupBy(*on).cogroup(d.groupBy(*on)).applyInPandas(_block_search(k), _HITS)


def knn_by_cells(queries: DataFrame, docs: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, block_docs: int = BLOCK_DOCS, pivots: int = MOST_PIVOTS) -> DataFrame:
    """The hits among which the ``k`` nearest of every query are, found by pruning with pivots: exact in any metric space.

    Every query first searches the nearest cells that hold ``k`` docs. The distance of its k-th hit bounds the answer, so only
    cells that come within that distance are searched after that.
    """
    placed, cells = voronoi_cells(docs, pivots)
    asked = queries.select("example_id", "embedding")
    if not cells.n.any():
        return docs.sparkSession.createDataFrame([], _HITS)
    first = materialize(_meet(asked, placed, cells, lambda d, _: cells.nearest_cells(d, k), k, block_queries, block_docs))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    kth = first.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("example_id"), F.sqrt("distance").alias("reach"))
    # without a k-th hit all cells were searched already
    bounded = asked.join(kth, "example_id")
    further = lambda d, part: cells.cells_in_reach(d, part["reach"].to_numpy()) & ~cells.nearest_cells(d, k)
    return first.unionByName(_meet(bounded, placed, cells, further, k, block_queries, block_docs))


def knn_of_distinct(queries: DataFrame, docs: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``knn_by_cells`` for each distinct query vector; its ``k`` nearest go to all queries with that vector."""
    distinct = queries.select("embedding").distinct()
    vectors = materialize(distinct.withColumn("example_id", F.monotonically_increasing_id()))
    hits = knn_by_cells(vectors, docs, k, block_queries, block_docs)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    # the k hits of a vector; stored, for the plan behind it reads nothing but them
    nearest = materialize(hits.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query_id").alias("vector"), "doc_id", "distance"))
    asked = queries.select(F.col("example_id").alias("query_id"), "embedding").join(vectors.withColumnRenamed("example_id", "vector"), "embedding")
    return asked.select("query_id", "vector").join(nearest, "vector").select("query_id", "doc_id", "distance")


def knn(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    block_queries: int = BLOCK_QUERIES,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``query_id, doc_id, distance, rank`` of the ``k`` nearest docs (all of them if there are fewer).

    Both sides are ``(example_id, embedding)``. Up to ``block_queries`` queries go to every task and the docs stay
    where they are: local top k, then a rank per query. More than that, and both sides meet by cells around
    pivots (``knn_by_cells``), where equal query vectors are searched once. Rows of one id count as one query.
    """
    head = queries.select("example_id", "embedding").limit(block_queries + 1).toPandas()
    if len(head) <= block_queries:
        if head.empty:
            partial = docs.limit(0).select(
                F.col("example_id").alias("query_id"), F.col("example_id").alias("doc_id"), F.lit(0.0).alias("distance")
            )
        else:
            matrix = np.stack(head["embedding"].to_numpy()).astype(np.float64)
            scan = _local_search(head["example_id"].to_numpy(), matrix, k)
            partial = docs.select("example_id", "embedding").mapInPandas(scan, _HITS)
    else:
        partial = knn_of_distinct(queries, docs, k, block_queries, block_docs)
    nearest = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return partial.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
