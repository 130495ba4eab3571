import pytest
from pyspark.sql import functions as F

from tessera.operators import curate, profile, sample


def test_comment_curation_edges(spark):
    data = [
        (1, None), (2, "[deleted]"), (3, " [removed] "), (4, "x" * 19), (5, "y" * 20),
        (6, "😀" * 20), (7, " " + "z" * 20 + " "), (8, "y" * 20), (9, "  " + "y" * 20),
        (10, 'quoted "line"\nwith newline inside'),
    ]
    df = spark.createDataFrame(data, "doc_id long, body string").withColumn("subreddit", F.lit("s"))
    out = {r.doc_id: r.body for r in curate.curate_comments(df).collect()}
    # null, tombstone, 19 code points and stripped copies go; first copy kept
    assert out == {5: "y" * 20, 6: "😀" * 20, 7: "z" * 20, 10: 'quoted "line"\nwith newline inside'}


def test_joke_curation(spark):
    data = [(1, None, "[removed]"), (2, "A title that is long", None), (3, None, None),
            (4, "A title that is long", "")]
    df = spark.createDataFrame(data, "doc_id long, title string, selftext string")
    out = {r.doc_id: r.text for r in curate.curate_jokes(df).collect()}
    assert out == {2: "A title that is long"}


def test_exact_sample_sizes_and_strict(spark):
    rows = [(i, f"g{i % 3}") for i in range(30)] + [(100, None)]
    df = spark.createDataFrame(rows, "doc_id long, k string")
    s = sample.sample_per_group(df, "k", 4, "doc_id", strict=True)
    sizes = {r.k: r["count"] for r in s.groupBy("k").count().collect()}
    assert sizes == {"g0": 4, "g1": 4, "g2": 4}
    # deterministic
    a = sorted(r.doc_id for r in s.collect())
    b = sorted(r.doc_id for r in sample.sample_per_group(df, "k", 4, "doc_id", strict=True).collect())
    assert a == b
    short = spark.createDataFrame(rows + [(200, "tiny")], "doc_id long, k string")
    with pytest.raises(Exception, match="fewer than 4"):
        sample.sample_per_group(short, "k", 4, "doc_id", strict=True).collect()
    capped = sample.sample_per_group(short, "k", 4, "doc_id")
    assert capped.filter("k = 'tiny'").count() == 1


def test_quantile_buckets(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 2, 5, 9, 9, 40])] + [(99, None)],
                               "i int, x double")
    out = {r.i: r.b for r in sample.quantile_buckets(df, "x", 5, "b").collect()}
    assert [out[i] for i in range(8)] == [0, 0, 0, 1, 1, 2, 2, 3]
    assert out[99] is None
    eq = spark.createDataFrame([(i, 5.0) for i in range(4)], "i int, x double")
    assert {r.b for r in sample.quantile_buckets(eq, "x", 5, "b").collect()} == {None}


def test_profile_and_alignment(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, s string")
    prof = {r.column: r.non_null for r in profile.column_profile(df).collect()}
    assert prof == {"id": 3, "s": 2}
    assert profile.distinct_count(df, "s").first()[0] == 1
    t = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    m = spark.createDataFrame([(2,), (3,)], "doc_id long")
    r = curate.alignment_report(t, m, "doc_id").first()
    assert (r.texts_without_metadata, r.metadata_without_text, r.duplicate_text_keys) == (1, 1, 1)


def test_order_statistics_exact(spark):
    import numpy as np
    rnd = np.random.default_rng(5)
    vals = np.concatenate([rnd.integers(0, 1000, 3000), np.full(2000, 17), rnd.normal(size=500) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    s = np.sort(vals)
    ranks = [0, 1, 2500, 2999, 3000, 4000, len(vals) - 1]
    got = sample.order_statistics(df, "x", ranks, buckets=8, final_rows=50)
    assert got == {r: float(s[r]) for r in ranks}
    q = sample.exact_quantiles(df, "x", [0, 0.2, 0.5, 0.8, 1])
    assert np.allclose(q, np.quantile(vals, [0, 0.2, 0.5, 0.8, 1]), rtol=0, atol=1e-9)


def test_bucketed_sample_equals_window(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, k string").repartition(5)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        big = sample.sample_per_group(df, "k", 300, "doc_id")
        got = sorted(r.doc_id for r in big.collect())
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    ref = sorted(r.doc_id for r in sample.sample_per_group(df, "k", 300, "doc_id").collect())
    assert got == ref
    assert len(got) == 300 + sum(min(300, sum(1 for i in range(5000) if i % 3 and i % 7 == g)) for g in range(7))


def test_stage_counts_come_from_the_run(spark):
    """The counts are those of the one action; without it nothing was computed."""
    from tessera.operators import curate, profile

    rows = [(1, None), (2, "[deleted]"), (3, "  short "), (4, "a text that is long enough"), (5, " a text that is long enough "), (6, "another text, also long enough")]
    df = spark.createDataFrame(rows, "doc_id long, body string").repartition(3)
    counts = profile.StageCounts()
    out = curate.curate_comments(df, watch=counts.watch)
    assert out.count() == 2
    assert [(r.stage, r.n_rows) for r in counts.report(spark).orderBy("stage_no").collect()] == [
        ("raw", 6), ("non_null", 5), ("no_tombstone", 4), ("min_length", 3), ("deduplicated", 2)]
    jokes = profile.StageCounts()
    j = spark.createDataFrame([(1, "t", "[removed]"), (2, "a title of length", "x" * 20), (3, "a title of length", "x" * 20)], "doc_id long, title string, selftext string")
    assert len(curate.curate_jokes(j, watch=jokes.watch).collect()) == 1
    assert [r.n_rows for r in jokes.report(spark).orderBy("stage_no").collect()] == [3, 2, 2, 1]
