"""Posting joins: texts by cosine, entries by query."""

import math
import random
from collections import Counter

import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

from tessera.operators import articles as A
from tessera.operators import postings as PO
from tessera.plans import catalog
from tessera.sources import tables as T


def plain_links(rows, t):
    """Class and number of linked classes by comparing every pair of vectors."""
    import re

    words = {d: tuple(sorted(re.sub(r"[^\w\s'-]", " ", (x or "").lower()).split())) for d, x in rows}
    cls = {d: min(e for e in words if words[e] == w) if w else d for d, w in words.items()}
    reps = {d: Counter(words[d]) for d in words if cls[d] == d and words[d]}
    df = Counter(w for c in reps.values() for w in c)
    vec = {}
    for d, c in reps.items():
        v = {w: n * math.log((len(reps) + 1) / df[w]) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[d] = {w: x / norm for w, x in v.items()}
    links = Counter()
    for a in vec:
        for b in vec:
            if a < b and round(sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items()), 12) >= t:
                links[a] += 1
                links[b] += 1
    return sorted((d, cls[d], links[cls[d]]) for d in words)


def family(n=160):
    random.seed(4)
    base = [[f"b{k}w{random.randrange(400)}" for _ in range(m)] for k, m in enumerate((6, 20, 60, 120))]
    rows = []
    for d in range(n):
        w = list(random.choice(base)) + ["the"] * random.randrange(20)
        for _ in range(random.randrange(len(w) // 3 + 1)):
            w[random.randrange(len(w))] = random.choice(["of", f"e{random.randrange(50)}"])
        random.shuffle(w)
        rows.append((d, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " .,! "), (903, rows[0][1]), (904, rows[0][1].upper())]


@pytest.mark.parametrize("t", [0.3, 0.8, 0.95])
@pytest.mark.parametrize("block", [1000, 5])
def test_similar_texts_brute_force(spark, monkeypatch, t, block):
    monkeypatch.setattr(PO, "LIST_BLOCK", block)
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine"))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in PO.link_counts(df, t).collect())
    assert got == plain_links(rows, t)
    assert PO.link_counts(df.limit(0), t).count() == 0


def test_prefix_filter_prunes(spark):
    """At 0.8 the candidates are few times the true pairs, far below all pairs."""
    texts = T.table(spark, SF01, "documents")
    classes = PO.word_classes(texts, "doc_id", "text")
    vectors = PO.weighted_words(classes)
    reps = classes.where("id = class_id").count()
    cand = PO.prefix_candidates(vectors, 0.8).count()
    true = PO.similar_texts(texts, 0.8)[1].count()
    assert true > 20 and cand < 60 * true and cand < 0.02 * reps * (reps - 1) / 2


def test_entry_match_whole_table(spark):
    """Every entry against every topic and benchmark text: equal to the rule on all pairs."""
    e = A.prepare_entries(T.articles(spark, SF001))
    tops = T.topics(spark).unionByName(T.table(spark, SF001, "benchmark").select((F.col("item_id") + 1000).alias("topic_id"), F.col("text").alias("topic")))
    odd = [(5000, "a"), (5001, "ai"), (5002, "or in"), (5003, "of the"), (5004, "!!"), (5005, ""), (5006, "news news"), (5007, "x y z")]
    q = A.prepare_queries(tops.unionByName(spark.createDataFrame(odd, "topic_id long, topic string")))
    got = sorted((r.query_id, r.article_id) for r in A.match_candidates(e, q).collect())
    want = sorted((r.query_id, r.article_id) for r in e.crossJoin(F.broadcast(q)).where(A.matches_query()).collect())
    assert got == want and len(got) > 20


def test_plan_does_not_hold_the_queries(spark):
    e = A.prepare_entries(T.articles(spark, SF001))
    size = []
    for n in (5, 500):
        q = A.prepare_queries(spark.range(n).select(F.col("id").alias("topic_id"), F.concat(F.lit("topic number "), "id").alias("topic")))
        size.append(len(A.match_candidates(e, q)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(size[0] - size[1]) < 200


def test_registered(spark):
    assert {"near_duplicate_texts", "topic_rounds", "topic_outcomes"} <= set(catalog.QUERIES)
