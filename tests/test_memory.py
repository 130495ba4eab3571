"""What a worker holds: products in strips, queries in arrays, texts in slices, dumps compressed."""

import glob
import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import embed as EM
from tessera.operators import pairs, search
from tessera.plans import catalog
from tessera.session import ensure_checkpoint_dir
from tessera.sources import files as FS


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_block_pairs_in_strips():
    rng = np.random.default_rng(3)
    h = pd.DataFrame({"id_a": np.arange(3000) * 2, "va": list(rng.normal(size=(3000, 8)) / 3)})
    o = pd.DataFrame({"id_b": np.arange(3000) * 2 + rng.integers(0, 2, 3000), "vb": list(rng.normal(size=(3000, 8)) / 3)})
    got, peak = peak_mb(lambda: pairs._block_pairs_fn(1.2)(h, o))
    S = np.stack(h["va"]) @ np.stack(o["vb"]).T
    r, c = np.nonzero((S >= 1.2) & (h["id_a"].to_numpy()[:, None] < o["id_b"].to_numpy()[None, :]))
    assert sorted(zip(got["id_a"], got["id_b"])) == sorted(zip(h["id_a"].to_numpy()[r], o["id_b"].to_numpy()[c])) and len(r) > 20
    assert peak < 40
    assert len(pairs._block_pairs_fn(99.0)(h, o)) == 0


def test_tokens_remembered_are_bounded(spark):
    texts = pa.array([" ".join(f"{i}w{j}" for j in range(200)) for i in range(2000)] + [None, "", "b a a"])

    def run():
        return [(len(x), x.slice(max(0, len(x) - 3)).to_pylist()) for x in EM._hashed_sparse_udf(256).func(iter([texts]))]

    got, peak = peak_mb(run)
    assert sum(n for n, _ in got) == len(texts) and peak < 40
    null, empty, last = got[-1][1]
    dims = {t: EM._dims_of(t, 256, {})[0] for t in "ab"}
    assert null == {"dims": None, "weights": None} and empty == {"dims": [], "weights": []}
    assert dict(zip(last["dims"], last["weights"])) == {dims["a"]: 2 / np.sqrt(5), dims["b"]: 1 / np.sqrt(5)}
    dense = [v for x in EM._hashed_udf(256, "double").func(iter([texts])) for v in x.to_pylist()]
    assert dense[-3] is None and dense[-2] == [0.0] * 256 and dense[-1][dims["a"]] == 2 / np.sqrt(5)


class Held:
    def __init__(self, value):
        self.value = value


def best_of(Q, X, k, exclude_self):
    fn = search._partial_topk_fn(Held((np.arange(len(Q)), Q)), k, exclude_self)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(X))), pa.array(list(X))], names=["doc_id", "v"])
    (out, *_), peak = peak_mb(lambda: list(fn(iter([batch]))))
    return out.to_pandas(), peak


def test_wide_vectors_in_blocks():
    """As for rag_context: many rows of a batch, long vectors."""
    rng = np.random.default_rng(5)
    Q, X = rng.normal(size=(1000, 64)), rng.normal(size=(10000, 64))
    got, peak = best_of(Q, X, 5, False)
    S = np.round(Q @ X.T, search.RANK_DECIMALS)
    want = {q: np.lexsort((np.arange(len(X)), -S[q]))[:5].tolist() for q in range(len(Q))}
    assert got.groupby("query_id")["doc_id"].apply(list).to_dict() == want
    assert peak < 25


def test_many_queries_in_arrays():
    """As for similarity_knn: a task keeps k numbers a query, not objects; ties go to the lower id."""
    rng = np.random.default_rng(6)
    X = rng.integers(-1, 2, size=(20000, 4)).astype(float)
    got, peak = best_of(X, X[:600], 3, True)
    assert peak < 25
    S = X @ X[:600].T
    for q in (0, 1, 599, 19999):
        s = S[q].copy()
        if q < 600:
            s[q] = -np.inf
        assert got[got.query_id == q]["doc_id"].tolist() == np.lexsort((np.arange(600), -s))[:3].tolist()
    few, _ = best_of(X[:4], X[:3], 5, True)
    assert few.groupby("query_id").size().tolist() == [2, 2, 2, 3]


def test_metadata_dumps_are_compressed(spark, tmp_path):
    """The two dumps and the metadata hold the texts twice each in less room than once."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words of a text, "), 20), "id").alias("text"),
                                    F.lit("s").alias("source"), F.lit(7).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.sql("select 5L as event_id, timestamp_ntz '2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["corpus_metadata_files"](spark, str(tmp_path))
    assert got.count() == 6000
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    newest = max(glob.glob(f"{base}/metadata-files-*"), key=os.path.getmtime)
    size = {k: sum(os.path.getsize(f) for f in glob.glob(f"{newest}/{k}/part-*")) for k in ("comments", "jokes", "metadata")}
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert all(size.values()) and sum(size.values()) < text
    assert FS.read_comments_csv(spark, f"{newest}/comments", "doc_id").count() == 3000
