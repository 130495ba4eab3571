"""Clustered store: exact search, and what it reads."""

import os

import numpy as np
import pytest

from tessera.sources import vector_store as VS


def frame(spark, X, name="doc_id", vec="embedding"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], f"{name} long, {vec} array<float>")


def plain(X, Q, ids, k, skip=False):
    X = X.astype(np.float32).astype(float)
    out = []
    for i, q in zip(ids, Q.astype(np.float32).astype(float), strict=True):
        s = np.round(X @ q, 12)
        order = [j for j in np.lexsort((np.arange(len(X)), -s)) if not (skip and j == i)][:k]
        out += [(i, r + 1, int(j)) for r, j in enumerate(order)]
    return out


def clusters(n=600, d=12, c=10, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(c, d))[rng.integers(0, c, n)] + spread * rng.normal(size=(n, d))
    X[:40] = X[0]  # copies: ties go to the lower id
    return X


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_search_is_exact(spark, tmp_path, monkeypatch, skip, spread):
    monkeypatch.setattr(VS, "QUERY_BLOCK", 13)
    monkeypatch.setattr(VS, "HELD", 300)
    X = clusters(spread=spread)
    VS.build(frame(spark, X), f"{tmp_path}/s")
    ids = list(range(0, 600, 20))
    asked = frame(spark, X, "query_id", "query_vec").where("query_id % 20 = 0")
    hits, _ = VS.search(spark, f"{tmp_path}/s", asked, 7, exclude_self=skip)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in hits.collect()) == plain(X, X[ids], ids, 7, skip)


def test_only_the_cells_that_can_matter_are_read(spark, tmp_path):
    X = clusters()
    VS.build(frame(spark, X), f"{tmp_path}/s", n_cells=20)
    hits, reads = VS.search(spark, f"{tmp_path}/s", frame(spark, X, "query_id", "query_vec").where("query_id % 50 = 1"), 3)
    scored = reads.collect()
    assert max(r.rows for r in scored) <= 300 and np.mean([r.cells for r in scored]) < 8
    # the scan of one cell lists that folder's files only
    one = spark.read.parquet(f"{tmp_path}/s/vectors").where("cell = 1")
    files = one.select("_metadata.file_path").distinct().collect()
    assert files and all("/cell=1/" in r[0] for r in files)
    assert len(os.listdir(f"{tmp_path}/s/vectors")) > 5


def test_store_edges(spark, tmp_path):
    X = clusters(5)
    rows = frame(spark, X).unionByName(spark.createDataFrame([(99, None)], "doc_id long, embedding array<float>"))
    VS.build(rows, f"{tmp_path}/few", n_cells=64)
    hits, reads = VS.search(spark, f"{tmp_path}/few", frame(spark, X[:2], "query_id", "query_vec"), 10)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in hits.collect()) == plain(X, X[:2], [0, 1], 10)
    VS.build(rows.where("doc_id = 99"), f"{tmp_path}/none")
    hits, reads = VS.search(spark, f"{tmp_path}/none", frame(spark, X[:2], "query_id", "query_vec"), 10)
    assert hits.count() == 0 and reads.count() == 0
    with pytest.raises(ValueError):
        VS.search(spark, f"{tmp_path}/few", frame(spark, X[:1, :5], "query_id", "query_vec"), 1)
