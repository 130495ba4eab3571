"""Property tests: random text against Python's own string semantics, and
hot keys holding a third of all rows."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import curate, fold, sample

ALPHABET = (string.ascii_letters + string.digits + " \t\n'-_&;<>?!.,/"
            + "  　\x1c\x1féüßçøЖж语²½’—😀́")
TEXT = st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=30),
                          st.sampled_from(["&amp;", "&lt;b&gt;", "&quot;", "&#39;", "<p>", "</p>", "&nbsp;"])),
                max_size=6).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_text_functions_keep_their_alphabets(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = df.orderBy("i").select(TX.strip("s").alias("a"), TX.clean_text("s").alias("b"),
                                 TX.normalize("s").alias("c"), TX.normalize_text("s").alias("d")).collect()
    for v, r in zip(values, got):
        assert r.a == v.strip()
        # no white space at the ends or in runs, and only allowed characters
        assert r.b == " ".join(r.b.split()) and r.d == " ".join(r.d.split())
        assert set(r.c) <= set(string.ascii_lowercase + string.digits + " ") and r.c == " ".join(r.c.split())
        assert r.d == r.d.lower() and all(ch in "_'- " or ch.isalnum() for ch in r.d)
    again = spark.createDataFrame([(i, r.c, r.d) for i, r in enumerate(got)], "i int, c string, d string")
    for r in again.select("c", "d", TX.normalize("c").alias("c2"), TX.normalize_text("d").alias("d2")).collect():
        assert (r.c2, r.d2) == (r.c, r.d)


def test_hot_text_dedupe_and_sample(spark):
    n = 3000
    rows = [(i, "the same hot text repeated" if i % 3 == 0 else f"unique text number {i:06d}", f"g{i % 3}")
            for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, body string, subreddit string").repartition(6)
    d = curate.dedupe_first(df, ["body"], ["doc_id"])
    assert d.count() == 1 + 2 * n // 3
    assert d.filter(F.col("body") == "the same hot text repeated").first().doc_id == 0
    s = sample.sample_per_group(df, "subreddit", 50, "doc_id", strict=True)
    assert {r.subreddit: r["count"] for r in s.groupBy("subreddit").count().collect()} == \
        {"g0": 50, "g1": 50, "g2": 50}


def test_hot_url_greedy_rounds(spark):
    # a third of all rows share one url; titles chain conflicts across rows
    rows = []
    for i in range(600):
        u = "hot" if i % 3 == 0 else f"u{i}"
        rows.append((i, u, f"t{i // 2}", 1))
    df = spark.createDataFrame(rows, "pos long, u string, t string, g int")
    su, stt, expect = set(), set(), []
    for p, u, t, _ in rows:
        if u in su or t in stt:
            continue
        su.add(u); stt.add(t); expect.append(p)
    got = sorted(r.pos for r in fold.greedy_two_key_rounds(df, ["g"], "pos", "u", "t").collect())
    assert got == expect


def test_greedy_forms_agree_on_ties_and_nulls(spark):
    import random

    random.seed(11)
    rows = [(random.randint(0, 6), random.choice([None, "u1", "u2", "u3", "u4", "u5"]), random.choice([None, "t1", "t2", "t3", "t4", "t5"]), g)
            for g in list(range(25)) + [None] for _ in range(9)]
    rows += [(0, "u1", "t1", 99), (0, "u1", "t2", 99), (1, "u3", "t3", 99)]
    key = lambda r: tuple((x is not None, x) for x in r[:3])
    expect = []
    for g in {r[3] for r in rows}:
        us, ts = set(), set()
        for r in sorted((r for r in rows if r[3] == g), key=key):
            if (r[1] is not None and r[1] in us) or (r[2] is not None and r[2] in ts):
                continue
            us.add(r[1]); ts.add(r[2]); expect.append(r)
    df = spark.createDataFrame(rows, "pos long, u string, t string, g int")
    got = [sorted(map(tuple, fn(df, ["g"], "pos", "u", "t").collect()), key=repr) for fn in (fold.greedy_two_key_fold, fold.greedy_two_key_rounds)]
    assert got[0] == got[1] == sorted(expect, key=repr)
    assert sum(r[3] == 99 for r in got[0]) == 2
