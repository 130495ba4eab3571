"""Pairwise similarity: k-NN graph (V9) and exact threshold join.

The threshold join never forms a cross product.  It is a metric-space
partitioning join:

1. P pivot vectors (a deterministic hash sample, P bounded) are broadcast.
2. Each vector gets a home cell (nearest pivot) and is replicated to every
   cell j with ``d(x, p_j) <= d(x, p_home) + 2r``, where r bounds the
   distance of any qualifying pair (``r^2 = 2 M^2 - 2t`` for max norm M).
   By the triangle inequality a qualifying pair (x, y) always meets in
   y's home cell, so the join is exact.
3. Home rows meet replicated rows in co-groups keyed by ``(cell, s1, s2)``;
   the number of row and column blocks of a cell comes from its measured
   size, so no co-group exceeds ``block_rows`` rows per side, even for a cell
   holding a third of all vectors.
4. Each co-group is scored by numpy matmuls of a strip of rows at a time, so a
   worker holds ``PRODUCT_CELLS`` products, not those of the whole block; only
   pairs with ``home.id < other.id AND dot >= t`` are emitted.  Each qualifying pair is
   reported once, from the home cell of its smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialize
from . import search


def knn_graph(vecs: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Exact top-k neighbours (excluding itself) of every vector (V9)."""
    q = vecs.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vec"))
    return search.topk_inner_product(vecs, q, k, id_col=id_col, vec_col=vec_col, exclude_self=True)


def _cells_udf(bc, reach: float):
    @F.pandas_udf("struct<home:int, cells:array<int>>")
    def cells(vs: pd.Series) -> pd.DataFrame:
        P = bc.value
        homes, reach_cells = [], []
        for v in vs:
            if v is None:
                homes.append(None)
                reach_cells.append([])
                continue
            x = np.asarray(v, dtype=np.float64)
            dist = np.sqrt(np.maximum(((P - x) ** 2).sum(axis=1), 0.0))
            h = int(np.argmin(dist))
            homes.append(h)
            reach_cells.append(np.nonzero(dist <= dist[h] + 2 * reach + 1e-9)[0].astype(int).tolist())
        return pd.DataFrame({"home": homes, "cells": reach_cells})
    return cells


#: Products of one strip of a block.
PRODUCT_CELLS = 500_000


def _block_pairs_fn(threshold: float):
    def fn(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if len(h) == 0 or len(o) == 0:
            return pd.DataFrame({"id_a": [], "id_b": [], "sim": []})
        H = np.stack(h["va"].to_numpy()).astype(np.float64)
        O = np.stack(o["vb"].to_numpy()).astype(np.float64)
        ia, ib = h["id_a"].to_numpy(), o["id_b"].to_numpy()
        step, found = max(1, PRODUCT_CELLS // len(o)), []
        for i in range(0, len(h), step):
            S = H[i:i + step] @ O.T
            r, c = np.nonzero(S >= threshold)
            keep = ia[i + r] < ib[c]
            r, c = r[keep], c[keep]
            found.append((ia[i + r], ib[c], S[r, c]))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("id_a", "id_b", "sim"), zip(*found, strict=True), strict=True)})
    return fn


def similarity_join(vecs: DataFrame, threshold: float, id_col: str = "id",
                    vec_col: str = "embedding", n_pivots: int = 16, block_rows: int = 4096,
                    seed: int = 42) -> DataFrame:
    """All pairs (id_a < id_b) with inner product >= threshold, exactly.

    Cells are split into a grid of blocks sized from measured cell sizes:
    home rows of cell c go to one of S1(c) row blocks, replicated rows to one
    of S2(c) column blocks, and each (c, s1, s2) block pair is one co-group
    holding at most ``block_rows`` rows per side, scored in strips.
    """
    spark = vecs.sparkSession
    v = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")) \
            .filter(F.col("v").isNotNull())
    max_norm = v.agg(F.max(V.l2_norm("v")).alias("m")).collect()[0]["m"] or 0.0
    reach = float(np.sqrt(max(0.0, 2 * max_norm * max_norm - 2 * threshold)))
    piv = (v.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(n_pivots)
            .select("v").collect())
    P = np.array([list(r[0]) for r in piv], dtype=np.float64)
    bc = spark.sparkContext.broadcast(P)
    c = v.withColumn("__c", _cells_udf(bc, reach)(F.col("v")))
    c = materialize(c, "pivot-cells")
    # A vector's home cell is always within its reach, so one aggregate over
    # the replicated rows gives both sizes per cell (at most P rows).
    sizes = (c.select(F.col("__c.home").alias("home"), F.explode("__c.cells").alias("cell"))
              .groupBy("cell").agg(F.count(F.lit(1)).alias("rep"),
                                   F.sum((F.col("home") == F.col("cell")).cast("long")).alias("home"))
              .collect())
    home_n = {r["cell"]: r["home"] for r in sizes if r["home"]}
    rep_n = {r["cell"]: r["rep"] for r in sizes}
    s1 = {k: max(1, -(-n // block_rows)) for k, n in home_n.items()}
    s2 = {k: max(1, -(-n // block_rows)) for k, n in rep_n.items()}

    def lit_map(m):
        return F.create_map(*[x for k, val in m.items() for x in (F.lit(int(k)), F.lit(int(val)))]) \
            if m else F.create_map().cast("map<int,int>")

    s1m, s2m = lit_map(s1), lit_map(s2)
    h = c.select(F.col("id").alias("id_a"), F.col("v").alias("va"), F.col("__c.home").alias("cell"))
    h = (h.withColumn("s1", F.pmod(F.xxhash64("id_a"), F.element_at(s1m, F.col("cell"))).cast("int"))
          .withColumn("s2", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(s2m, F.col("cell")), F.lit(1)) - 1))))
    o = c.select(F.col("id").alias("id_b"), F.col("v").alias("vb"), F.explode("__c.cells").alias("cell"))
    o = (o.withColumn("s2", F.pmod(F.xxhash64("id_b"), F.element_at(s2m, F.col("cell"))).cast("int"))
          .withColumn("s1", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(s1m, F.col("cell")), F.lit(1)) - 1))))
    keys = ["cell", "s1", "s2"]
    return (h.groupBy(*keys).cogroup(o.groupBy(*keys))
             .applyInPandas(_block_pairs_fn(threshold), "id_a long, id_b long, sim double"))


def suppress_near_duplicates(vecs: DataFrame, threshold: float, id_col: str = "id",
                             vec_col: str = "embedding", **join_args) -> DataFrame:
    """R9 at corpus scale: walk vectors by id and drop one whose inner product
    with an already kept vector is >= threshold (skipped rows never block).
    Exact pairs from ``similarity_join``, then ``fold.greedy_graph`` rounds."""
    from . import fold
    p = similarity_join(vecs, threshold, id_col=id_col, vec_col=vec_col, **join_args)
    nodes = vecs.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    return fold.greedy_graph(nodes, p, "id", "id_a", "id_b").withColumnRenamed("id", id_col)
