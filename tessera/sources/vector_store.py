"""Clustered vector store (S9) with exact top-k search (V4, V5).

``build`` writes every vector once, in a folder for each cell of a clustering.
The centroids are fitted on a sample of at most ``SAMPLE`` vectors; every
vector is then filed with its nearest centroid, and the cell table keeps the
centroid, the number of vectors and the radius: the largest distance of any of
them, whatever the sample saw.

``search`` is exact.  For a query q and a cell with centroid c and radius r no
inner product in the cell exceeds q.c + |q| r.  A first pass reads, for each
query, the most promising cells until they hold k vectors; the k-th best found
there is a lower bound, and a second pass reads only those other cells whose
bound reaches it.  Cells are folders, so the scan lists and reads only their
files.  Queries come in blocks of ``QUERY_BLOCK``; the driver holds a block,
the cell table (at most ``MAX_CELLS`` rows) and one threshold a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import RANK_DECIMALS, _list_matrix
from ..session import materialize, ship_package

SAMPLE, MAX_CELLS, ROUNDS = 20_000, 4096, 8
QUERY_BLOCK = 2048
#: Files that a cell's vectors are dealt to, and scores that a task holds before it cuts them to k a query.
FILES, HELD = 8, 1_000_000
SLACK = 1e-9


def _nearest(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    return np.argmax(X @ C.T - 0.5 * (C * C).sum(1), axis=1)


def _fit(X: np.ndarray, n_cells: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty cell keeps its place."""
    C = X[np.linspace(0, len(X) - 1, n_cells).astype(int)].copy()
    for _ in range(ROUNDS):
        at = _nearest(X, C)
        size = np.bincount(at, minlength=n_cells)
        total = np.zeros_like(C)
        np.add.at(total, at, X)
        C[size > 0] = total[size > 0] / size[size > 0, None]
    return C


def build(vecs: DataFrame, path: str, id_col: str = "doc_id", vec_col: str = "embedding", n_cells: int | None = None) -> None:
    """Write the store of ``vecs`` below ``path``; rows without a vector are left out."""
    spark = vecs.sparkSession
    ship_package(spark)
    rows = materialize(vecs.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")), "vectors")
    n = rows.count()
    cells = max(1, min(MAX_CELLS, n_cells or math.ceil(math.sqrt(n)), n))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    C = _fit(np.array([r[0] for r in some], dtype=np.float64), min(cells, len(some))) if some else np.zeros((0, 0))

    def file(batches):
        for batch in batches:
            _, X = _list_matrix(batch.column(1))
            if not len(X):
                continue
            at = _nearest(X, C)
            dist = np.sqrt(((X - C[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(dist)], names=["id", "vec", "cell", "dist"])

    filed = rows.mapInArrow(file, "id long, vec array<double>, cell int, dist double")
    # a cell is dealt to several files, so one that holds most vectors is not one task
    filed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(FILES))).write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")
    stats = spark.read.parquet(f"{path}/vectors").groupBy(F.col("cell").cast("int").alias("cell")).agg(
        F.count("*").alias("rows"), F.max("dist").alias("radius")) if n else spark.createDataFrame([], "cell int, rows long, radius double")
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(C)], "cell int, centroid array<double>")
    stats.join(centers, "cell").coalesce(1).write.mode("errorifexists").parquet(f"{path}/cells")


def _scan(rows: DataFrame, wanted: dict[int, np.ndarray], qids: np.ndarray, Q: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    """Each task's best k of the queries ``wanted`` for each cell of ``rows``."""
    def run(batches):
        held, size = [], 0
        tau = np.full(len(qids), -np.inf)

        def cut():
            """Best k a query by (sim, id) of what is held; the k-th becomes the query's threshold."""
            q, ids, sims = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, -sims, q))
            q, ids, sims = q[order], ids[order], sims[order]
            first = np.searchsorted(q, q, "left")
            rank = np.arange(len(q)) - first
            full = rank == k - 1
            tau[q[full]] = sims[full]
            keep = rank < k
            return [(q[keep], ids[keep], sims[keep])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, X = _list_matrix(batch.column(1))
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cells):
                here, asked = np.flatnonzero(cells == c), wanted[int(c)]
                step = max(1, HELD // len(here))
                for a in range(0, len(asked), step):
                    qs = asked[a:a + step]
                    S = np.round(Q[qs] @ X[here].T, RANK_DECIMALS)
                    if exclude_self:
                        S[ids[here][None, :] == qids[qs][:, None]] = -np.inf
                    low = tau[qs]
                    if len(here) > k:
                        low = np.maximum(low, np.partition(S, len(here) - k, axis=1)[:, len(here) - k])
                    r, j = np.nonzero((S >= low[:, None]) & (S > -np.inf))
                    held.append((qs[r], ids[here][j], S[r, j]))
                    size += len(r)
                    if size > HELD:
                        held = cut()
                        size = len(held[0][0])
        if held:
            q, ids, sims = cut()[0]
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids.astype(np.int64)), pa.array(sims)], names=["query_id", "doc_id", "sim"])

    ship_package(rows.sparkSession)
    return rows.select("id", "vec", "cell").mapInArrow(run, "query_id long, doc_id long, sim double")


def _blocks(queries: DataFrame):
    ids, vecs = [], []
    for r in queries.where(F.col("query_vec").isNotNull()).select("query_id", F.col("query_vec").cast("array<double>")).toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, dtype=np.int64), np.array(vecs, dtype=np.float64)
            ids, vecs = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(vecs, dtype=np.float64)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, reads): (query_id, rank, doc_id, sim) of the best ``k`` vectors of
    each of ``queries`` (query_id, query_vec), equal sims by id; and (query_id,
    cells, rows): how many cells and vectors were scored for it."""
    table = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "doc_id")
    hits = spark.createDataFrame([], "query_id long, rank int, doc_id long, sim double")
    read = []
    for qids, Q in _blocks(queries) if table else ():
        cells, size = np.array([r.cell for r in table]), np.array([r.rows for r in table])
        C, radius = np.array([r.centroid for r in table]), np.array([r.radius for r in table])
        if C.shape[1] != Q.shape[1]:
            raise ValueError(f"stored vectors have {C.shape[1]} dimensions, queries {Q.shape[1]}")
        bound = Q @ C.T + np.sqrt((Q * Q).sum(1))[:, None] * radius * (1 + SLACK) + SLACK
        best = np.argsort(-bound, axis=1, kind="stable")
        # first the most promising cells that hold k vectors, one more where the query itself is left out
        held = np.cumsum(size[best], axis=1)
        enough = np.minimum((held < k + exclude_self).sum(axis=1), len(cells) - 1)
        first = np.zeros_like(bound, dtype=bool)
        np.put_along_axis(first, best, np.arange(len(cells))[None, :] <= enough[:, None], axis=1)

        def scan(mask, qids=qids, Q=Q, cells=cells):
            wanted = {int(c): np.flatnonzero(mask[:, i]) for i, c in enumerate(cells) if mask[:, i].any()}
            stored = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(list(wanted)))
            return materialize(_scan(stored, wanted, qids, Q, k, exclude_self).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "hits")

        found = scan(first)
        tau = {r.query_id: r.low for r in found.groupBy("query_id").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        low = np.array([tau.get(int(i), -np.inf) for i in qids])
        more = ~first & (bound >= low[:, None] - SLACK)
        if more.any():
            found = found.unionByName(scan(more))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        hits = hits.unionByName(ranked.select("query_id", "rank", "doc_id", "sim"))
        read += [(int(i), int(m.sum()), int(size[m].sum())) for i, m in zip(qids, first | more, strict=True)]
    return hits, spark.createDataFrame(read, "query_id long, cells int, rows long")
