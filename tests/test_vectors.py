import numpy as np

from tessera.operators import pairs, search


def _df(spark, M, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(M)],
                                 "id long, embedding array<double>")


def _brute_topk(X, Q, k):
    out = {}
    for j, q in enumerate(Q):
        s = np.round(X @ q, 12)
        order = sorted(range(len(X)), key=lambda i: (-s[i], i))[:k]
        out[j] = order
    return out


def test_topk_against_numpy(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(300, 16))
    X[5] = X[7]                      # tied scores: lower id first
    Q = np.vstack([rnd.normal(size=(4, 16)), np.zeros((1, 16))])    # zero query vector
    c = _df(spark, X).repartition(5)
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(Q)],
                              "query_id long, query_vec array<double>")
    got = search.topk_inner_product(c, q, 7, id_col="id")
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append(r.doc_id)
    assert res == _brute_topk(X, Q, 7)


def test_topk_k_larger_than_n_and_blocked_queries(spark):
    rnd = np.random.default_rng(1)
    X = rnd.normal(size=(6, 4))
    Q = rnd.normal(size=(9, 4))
    c = _df(spark, X)
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(Q)],
                              "query_id long, query_vec array<double>")
    # budget of 3 queries per broadcast forces hashed query blocks
    got = search.topk_inner_product(c, q, 10, id_col="id", max_query_bytes=3 * 8 * 4)
    assert got.count() == 9 * 6


def test_similarity_join_exact_with_hot_cell(spark):
    rnd = np.random.default_rng(2)
    hot = rnd.normal(size=8)
    X = np.vstack([hot + rnd.normal(scale=0.05, size=(60, 8)), rnd.normal(size=(120, 8))])
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = X @ X.T
    for t in (0.3, 0.8, 0.99):
        expect = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if S[i, j] >= t}
        got = pairs.similarity_join(_df(spark, X), t, id_col="id", n_pivots=6, block_rows=16)
        assert {(r.id_a, r.id_b) for r in got.collect()} == expect, t


def test_knn_graph_excludes_self(spark):
    rnd = np.random.default_rng(4)
    X = rnd.normal(size=(40, 6))
    got = pairs.knn_graph(_df(spark, X), 3, id_col="id").collect()
    assert all(r.query_id != r.doc_id for r in got)
    assert len(got) == 40 * 3


def test_knn_blocks_any_ids(spark):
    """More queries than a block holds, most of them under one id: blocks are cut to size, no error."""
    X = np.random.default_rng(6).normal(size=(60, 6))
    q = _df(spark, X).selectExpr("if(id < 50, 7, id) as query_id", "embedding as query_vec")
    args = dict(id_col="id", dim=6)
    whole = search.topk_inner_product(_df(spark, X), q, 3, **args).collect()
    cut = search.topk_inner_product(_df(spark, X), q, 3, max_query_bytes=8 * 6 * 8, **args).collect()
    key = lambda rows: sorted((r.query_id, r.rank, r.doc_id, round(r.sim, 9)) for r in rows)
    assert key(cut) == key(whole) and len(whole) == 11 * 3


def test_pluggable_encoder_and_hashed_forms(spark):
    from pyspark.sql import functions as F

    from tessera.operators import embed as EM

    def load():
        # a toy model: character-class counts
        return lambda texts: [[sum(c.isalpha() for c in t), sum(c.isdigit() for c in t), len(t) + 1.0]
                              for t in texts]

    df = spark.createDataFrame([("abc 12",), ("",), ("x",)], "t string")
    enc = EM.encoder_udf(load, dtype="double", batch_size=2)
    vecs = [r[0] for r in df.select(enc(F.col("t"))).collect()]
    for v in vecs:
        assert abs(np.linalg.norm(v) - 1.0) < 1e-9
    dense = [r[0] for r in df.select(EM.hashed_embedding("t", 16)).collect()]
    sparse = [r[0] for r in df.select(EM.hashed_sparse("t", 16)).collect()]
    for d, s in zip(dense, sparse):
        back = np.zeros(16)
        back[list(s["dims"])] = s["weights"]
        assert np.allclose(back, d)


def test_suppress_near_duplicates_equals_walk(spark):
    rnd = np.random.default_rng(9)
    X = rnd.normal(size=(150, 6))
    X[10:40] = X[5] + rnd.normal(scale=0.05, size=(30, 6))   # a hot cluster
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    for t in (0.5, 0.9):
        kept = []
        for i in range(len(X)):
            if all(float(X[i] @ X[j]) < t for j in kept):
                kept.append(i)
        got = pairs.suppress_near_duplicates(_df(spark, X), t, id_col="id", n_pivots=4, block_rows=32)
        assert sorted(r.id for r in got.collect()) == kept


def test_attach_metadata_keeps_hits_without_metadata(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 7, 0.5, 2)], "query_id long, doc_id long, sim double, rank long")
    meta = spark.createDataFrame([(1, "src1"), (2, "src2")], "doc_id long, source string")
    out = search.attach_metadata(hits, meta, "doc_id")
    got = sorted((r.doc_id, r.source) for r in out.collect())
    assert got == [(1, "src1"), (7, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the metadata side is cut to the hits before it meets them
    assert "LeftSemi" in plan and "LeftOuter, BuildRight" in plan and "BuildLeft" not in plan
