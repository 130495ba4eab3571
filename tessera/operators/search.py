"""Exact top-k by inner product (V4/V5), metadata attach (V6), ranks (V7).

Physical plan, for N corpus vectors and Q query vectors:

1. the query matrix (Q x D doubles) is size-checked and broadcast;
2. ``mapInArrow`` scans the corpus once; each task keeps a running top-k per
   query in two Q x k arrays and emits at most k rows per query — the partial
   aggregate.  A batch is scored in blocks of ``PRODUCT_CELLS`` products, of
   which only those that reach a query's k-th best so far are looked at;
3. a ``row_number`` window over ``query_id`` keeps the final k.  Spark plans
   this with a partial ``WindowGroupLimit`` before the shuffle, so each query
   moves at most k rows per task.

When Q x D exceeds the broadcast budget the queries are processed in blocks of
at most that size, one at a time: a block is read to the driver, broadcast,
scored by one corpus scan, and its top k are written to the checkpoint folder
before the next one is read.  The driver holds one block and at most about one
more of rows that wait.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_MAX_QUERY_BYTES = 16 * 1024 * 1024

_PARTIAL_SCHEMA = "query_id long, doc_id long, sim double"


def _list_matrix(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list<float> column -> (valid_mask, n x D float64 matrix)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    valid = ~np.asarray(arr.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    sub = arr.filter(pa.array(valid)) if not valid.all() else arr
    n = len(sub)
    if n == 0:
        return valid, np.zeros((0, 0))
    offsets = np.asarray(sub.offsets.to_numpy())
    lens = np.diff(offsets)
    if (lens != lens[0]).any():
        raise ValueError("vectors of different dimensions in one column")
    vals = sub.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return valid, vals.reshape(n, int(lens[0]))


def _merge_topk(ids: np.ndarray, sims: np.ndarray, new_ids: np.ndarray, S: np.ndarray) -> None:
    """Fold the products ``S`` (queries x new_ids) into each query's best k by
    (sim desc, id asc), in place; places that are not taken have -inf."""
    k = ids.shape[1]
    floor = sims[:, -1]
    if S.shape[1] > k and np.isneginf(floor).any():
        floor = np.maximum(floor, np.partition(S, S.shape[1] - k, axis=1)[:, -k])
    r, c = np.nonzero((S >= floor[:, None]) & ~np.isneginf(S))
    if len(r) == 0:
        return
    rows, at = np.unique(r, return_inverse=True)
    own = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
    all_ids = np.concatenate([ids[rows].ravel(), new_ids[c]])
    all_sims = np.concatenate([sims[rows].ravel(), S[r, c]])
    order = np.lexsort((all_ids, -all_sims, own))
    starts = np.searchsorted(own[order], np.arange(len(rows)))
    best = order[starts[:, None] + np.arange(k)]
    ids[rows], sims[rows] = all_ids[best], all_sims[best]


# Similarities are ranked after rounding to this many decimals, so float noise
# from a different summation order cannot reorder exact ties (which then go to
# the lower id).
RANK_DECIMALS = 12


# Cells of the block product that a task holds at a time.
PRODUCT_CELLS = 500_000
# Corpus rows of one such block.
PRODUCT_ROWS = 1024


def _partial_topk_fn(bc, k: int, exclude_self: bool = False):
    def fn(batches):
        qids, Q = bc.value
        best_ids = np.full((len(qids), k), np.iinfo(np.int64).max)
        best_sims = np.full((len(qids), k), -np.inf)
        for rb in (b.slice(i, PRODUCT_ROWS) for b in batches for i in range(0, b.num_rows, PRODUCT_ROWS)):
            ids = rb.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            valid, X = _list_matrix(rb.column(1))
            ids = ids[valid]
            if len(ids) == 0:
                continue
            if X.shape[1] != Q.shape[1]:
                raise ValueError(f"corpus dim {X.shape[1]} != query dim {Q.shape[1]}")
            step = max(1, PRODUCT_CELLS // len(ids))
            for j in range(0, len(qids), step):
                S = Q[j:j + step] @ X.T
                np.round(S, RANK_DECIMALS, out=S)
                if exclude_self:
                    S[qids[j:j + step, None] == ids[None, :]] = -np.inf
                _merge_topk(best_ids[j:j + step], best_sims[j:j + step], ids, S)
        taken = ~np.isneginf(best_sims)
        if taken.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, taken.sum(axis=1))), pa.array(best_ids[taken]), pa.array(best_sims[taken])],
                names=["query_id", "doc_id", "sim"])
    return fn


def _collect_queries(queries: DataFrame, max_rows: int):
    rows = queries.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    qids = np.array([r[0] for r in rows], dtype=np.int64)
    if rows:
        Q = np.array([list(r[1]) for r in rows], dtype=np.float64)
    else:
        Q = np.zeros((0, 0))
    return qids, Q


def _query_blocks(queries: DataFrame, max_rows: int):
    """All queries in blocks of at most ``max_rows``; one is in memory at a time."""
    parts = math.ceil(queries.count() / max_rows)
    qids, vecs = [], []
    for r in queries.repartition(parts).toLocalIterator():
        qids.append(r[0])
        vecs.append(np.array(r[1], dtype=np.float64))
        if len(qids) == max_rows:
            yield np.array(qids, dtype=np.int64), np.array(vecs)
            qids, vecs = [], []
    if qids:
        yield np.array(qids, dtype=np.int64), np.array(vecs)


def topk_inner_product(corpus: DataFrame, queries: DataFrame, k: int,
                       id_col: str = "doc_id", vec_col: str = "embedding",
                       query_id_col: str = "query_id", query_vec_col: str = "query_vec",
                       dim: int | None = None,
                       max_query_bytes: int = DEFAULT_MAX_QUERY_BYTES,
                       exclude_self: bool = False) -> DataFrame:
    """Exact top-k corpus rows per query by inner product.

    Returns ``(query_id, doc_id, sim, rank)`` with rank 1..k ordered by
    ``sim desc, doc_id asc``.  Fewer than k rows when the corpus is smaller.
    ``exclude_self`` drops the row whose id equals the query id (k-NN graph).
    """
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id_col).cast("long"), F.col(query_vec_col))
    c = corpus.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vec_col).alias("v"))
    if dim is None:
        first = q.select(F.size(query_vec_col)).limit(1).collect()
        dim = first[0][0] if first else 1
    max_rows = max(1, max_query_bytes // (8 * max(dim, 1)))
    got = _collect_queries(q, max_rows)
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("doc_id").asc())

    def best(partials):
        return (partials.withColumn("rank", F.row_number().over(w).cast("long"))
                .filter(F.col("rank") <= k))

    def scan(block):
        bc = spark.sparkContext.broadcast(block)
        return bc, c.mapInArrow(_partial_topk_fn(bc, k, exclude_self), _PARTIAL_SCHEMA)

    if got is not None:
        if len(got[0]) == 0:
            return spark.createDataFrame([], _PARTIAL_SCHEMA + ", rank int")
        return best(scan(got)[1])
    partials = None
    for block in _query_blocks(q, max_rows):
        bc, p = scan(block)
        p = materialize(best(p).drop("rank"))
        bc.destroy()
        partials = p if partials is None else partials.unionByName(p)
    return best(partials)


def attach_metadata(hits: DataFrame, metadata: DataFrame, key: str = "doc_id",
                    meta_key: str | None = None) -> DataFrame:
    """Left-attach metadata to the hit list (at most Q x k rows).

    Metadata is first cut to the keys that were hit, a semi-join whose small
    side adaptive execution broadcasts once its measured size allows; only
    the rows that are left meet the hits, so the metadata table itself is
    shuffled at most where the hits are too many to broadcast.
    """
    meta_key = meta_key or key
    m = metadata.withColumnRenamed(meta_key, "__mk") if meta_key != "__mk" else metadata
    found = m.join(hits.select(F.col(key).alias("__mk")).distinct(), "__mk", "left_semi")
    return hits.join(found, hits[key] == F.col("__mk"), "left").drop("__mk")
