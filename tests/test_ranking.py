import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import ranking as R

AS_OF = "2025-01-01 00:00:00"


def test_freshness_table(spark):
    hrs = [0, 12, 24, 48, 72, 168]
    df = spark.createDataFrame([(h,) for h in hrs] + [(None,)], "h int")
    df = df.withColumn("p", F.when(F.col("h").isNull(), None).otherwise(
        F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(F.lit(0), F.col("h"))))
    got = [r[0] for r in df.select(R.freshness("p", AS_OF)).collect()]
    assert [round(x, 2) for x in got[:5]] == [1.00, 0.84, 0.71, 0.50, 0.35]
    assert abs(got[5] - math.exp(-0.693 / 48 * 168)) < 1e-12      # 0.088, not 0.13
    assert got[6] == 0.5


def test_source_quality(spark):
    vals = ["BBC News India", "Ignite Blog", "!!!", None, "IGN.com", "reuters", ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(R.source_quality("s")).collect()]
    assert got == [0.98, 0.90, 0.50, 0.50, 0.90, 1.00, 0.50]


def test_title_relevance(spark):
    cases = [("ai", "officials said", 1.0), ("space rocket", "rocket news today", 0.6 * 0.5 + 0.15 * (2 / 3)),
             ("", "x", 0.0), ("x", "", 0.0), ("mars", "mars mission", 1.0), ("moon", "lunar base", 0.0)]
    df = spark.createDataFrame([(q, t) for q, t, _ in cases], "q string, t string")
    got = [r[0] for r in df.select(R.title_relevance(TX.normalize_text("q"), TX.normalize_text("t"))).collect()]
    assert [round(g, 9) for g in got] == [round(e, 9) for _, _, e in cases]


def test_newsworthiness_bands(spark):
    rows = [("Company announces deal and launches product", ""),
            ("What is the complete guide to everything you need to know?", ""),
            ("Why the 2018 analysis matters", ""),
            ("Top reasons to watch", "")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [r[0] for r in df.select(R.newsworthiness(F.col("t"), TX.normalize_text("t"),
                                                    TX.normalize_text("s"))).collect()]
    assert got[0] > 0.85 and got[1] == 0.0 and got[2] < 0.5 and 0 <= got[3] <= 1


def _brute_diverse(items, top_k, thr, cap):
    sel, counts = [], {}
    for score, order, vec, src, name in sorted(items, key=lambda x: (-round(x[0], 12), x[1])):
        if counts.get(src, 0) >= cap:
            continue
        if any(float(np.dot(vec, s[2])) >= thr for s in sel):
            continue
        sel.append((score, order, vec, src, name))
        counts[src] = counts.get(src, 0) + 1
        if len(sel) >= top_k:
            break
    return [x[4] for x in sel]


def test_diverse_select_equals_loop(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=8)
    items = []
    for i in range(40):
        v = base + rnd.normal(scale=0.6 if i % 3 else 0.1, size=8)
        v = v / np.linalg.norm(v)
        items.append((float(rnd.random()), i, v.tolist(), f"s{i % 4}", f"n{i}"))
    # a row skipped by the cap must not block a later near copy
    df = spark.createDataFrame([(1, *it) for it in items],
                               "g int, score double, ord int, vec array<double>, src string, name string")
    for thr, cap in [(0.8, 3), (0.95, 2), (2.0, 1)]:
        got = R.diverse_select(df, "g", "score", "ord", "vec", "src", 10, thr, cap, payload=["name"])
        got = [r.name for r in got.orderBy("rank").collect()]
        assert got == _brute_diverse(items, 10, thr, cap)
