from pyspark.sql import functions as F

from tessera.operators import decisions as G


def test_classifier_replies(spark):
    replies = ['{"needs_news": true, "categories": ["tech","x","tech"]}', "not json",
               '{"needs_news": "false", "categories": ["gaming"]}', '{"needs_news": true, "categories": []}',
               "[1]", "{}", '{"needs_news": 1, "categories": ["nope"]}', '{"needs_news": 0, "categories": ["tech"]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [(x.d.reply_ok, x.d.needs_news, list(x.d.categories))
           for x in df.orderBy("i").select(G.parse_classifier("r").alias("d")).collect()]
    assert got == [(True, True, ["tech", "tech"]), (False, False, []), (True, True, ["gaming"]),
                   (True, False, []), (False, False, []), (True, False, []), (True, False, []),
                   (True, False, ["tech"])]


def test_critic_and_routing(spark):
    log = [(1, 1, '{"passed": true, "feedback": "ok"}'),                       # pass at 1
           (2, 1, '{"passed": false}'), (2, 2, "not json"), (2, 3, "{}"),      # fail x3
           (3, 1, '{"passed": false}'), (3, 2, '{"passed": 0}')]              # fail x2 -> open
    df = spark.createDataFrame(log, "topic_id long, attempt int, r string")
    df = df.withColumn("c", G.parse_critic("r")).select("topic_id", "attempt", "c.*")
    fb = {(r.topic_id, r.attempt): r.feedback for r in df.collect()}
    assert fb[(2, 2)].startswith("Critic returned invalid JSON")
    res = {r.topic_id: (r.attempt, r.status) for r in G.resolve_attempts(df).collect()}
    assert res == {1: (1, "end"), 2: (3, "end"), 3: (2, "open")}
    routes = [r[0] for r in df.orderBy("topic_id", "attempt").select(
        G.route(F.col("passed"), F.col("attempt"))).collect()]
    assert routes == ["end", "regenerate", "regenerate", "end", "regenerate", "regenerate"]


def test_context_blocks_sorted(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "q int, rank int, t string")
    out = G.join_blocks(df, "q", "rank", G.py_str(F.col("t")), "\n\n").first()
    assert out.context == "a\n\nb\n\nNone"
