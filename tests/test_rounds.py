"""Topic rounds with models that count what they are asked."""

from pyspark.sql import functions as F

from tessera.plans import rounds as RD
from tessera.session import materialize

TEMPLATES = RD.Templates(classify="C {topic}", generate="G {topic}|{context}|{news}|{critique}", critique="K {topic}|{draft}")
NEWS, QUIET = '{"needs_news": true, "categories": ["tech"]}', '{"needs_news": false, "categories": []}'


class Model:
    """Replies by a rule over (topic_id, attempt, stage); remembers every request."""

    def __init__(self, spark, rule):
        self.spark, self.rule, self.asked, self.calls = spark, rule, [], 0

    def __call__(self, requests):
        rows = [(r.topic_id, r.attempt, r.stage, r.prompt) for r in requests.collect()]
        self.calls += 1
        self.asked += rows
        out = [(t, a, s, self.rule(t, a, s)) for t, a, s, _ in rows]
        return self.spark.createDataFrame([x for x in out if x[3] is not None], "topic_id long, attempt long, stage string, reply string")


def gather(spark, seen, out):
    def work(texts):
        rows = [(r.topic_id, r.topic) for r in texts.collect()]
        seen.append(sorted(t for _, t in rows))
        return spark.createDataFrame([(i, f"{out} of {t}") for i, t in rows if t != "none"], f"query_id long, {out} string")
    return work


def run(spark, topics, rule, **kw):
    model, ctx, news = Model(spark, rule), [], []
    df = spark.createDataFrame(topics, "topic_id long, topic string")
    got = RD.run(df, model, TEMPLATES, gather(spark, ctx, "context"), gather(spark, news, "news"), **kw)
    return model, ctx, news, got


def test_rounds_end_at_pass_or_third_attempt(spark):
    def rule(t, a, s):
        if s == "classify":
            return NEWS if t in (1, 2) else QUIET
        if s == "generate":
            return f"draft {t}.{a}"
        return '{"passed": true, "feedback": "ok"}' if (t, a) in ((1, 1), (3, 2)) else '{"passed": false, "feedback": "try {draft}"}' if t != 4 else "not json"

    topics = [(1, "alpha"), (2, "alpha"), (3, "beta"), (4, "none"), (5, "  "), (6, None)]
    model, ctx, news, got = run(spark, topics, rule)
    ends = {r.topic_id: (r.attempt, r.status, r.passed, r.draft) for r in got.outcomes.collect()}
    assert ends == {1: (1, "end", True, "draft 1.1"), 2: (3, "end", False, "draft 2.3"), 3: (2, "end", True, "draft 3.2"), 4: (3, "end", False, "draft 4.3")}
    assert sorted((r.topic_id, r.reason) for r in got.rejected.collect()) == [(5, "blank topic"), (6, "blank topic")]
    # each request is asked once, one call a step; news only behind the gate, each text once
    assert len(model.asked) == len(set(model.asked)) == got.requests.count() == 4 + 2 * (4 + 3 + 2)
    assert model.calls == 7 and news == [["alpha"]] and ctx == [["alpha", "beta", "none"]]
    said = {(t, a): p for t, a, s, p in model.asked if s == "generate"}
    assert said[1, 1] == "G alpha|context of alpha|news of alpha|{}"
    assert said[3, 1] == "G beta|context of beta||{}" and said[4, 1] == "G none|||{}"
    # the earlier verdict goes into the next request, and a placeholder in it stays as it is
    assert said[2, 2] == 'G alpha|context of alpha|news of alpha|{"passed":false,"feedback":"try {draft}"}'
    assert "invalid JSON" in said[4, 3]
    routes = sorted((r.topic_id, r.attempt, r.route) for r in got.requests.where("stage = 'critique'").collect())
    assert routes == [(1, 1, "end"), (2, 1, "regenerate"), (2, 2, "regenerate"), (2, 3, "end"), (3, 1, "regenerate"), (3, 2, "end"),
                      (4, 1, "regenerate"), (4, 2, "regenerate"), (4, 3, "end")]


def test_missing_replies_wait(spark):
    def rule(t, a, s):
        if s == "classify":
            return None if t == 1 else QUIET
        if s == "generate":
            return None if t == 2 else "d"
        return None if t == 3 else "{}"

    model, _, news, got = run(spark, [(i, f"t{i}") for i in range(1, 5)], rule, max_attempts=2)
    ends = {r.topic_id: (r.attempt, r.status, r.draft) for r in got.outcomes.collect()}
    assert ends == {1: (0, "waiting", None), 2: (1, "waiting", None), 3: (1, "waiting", "d"), 4: (2, "end", "d")}
    assert news in ([], [[]]) and len(model.asked) == len(set(model.asked))


def test_empty_topics(spark):
    _, _, _, got = run(spark, [], lambda *a: None)
    assert got.requests.count() == 0 and got.outcomes.count() == 0 and got.rejected.count() == 0


def test_fill_is_one_pass(spark):
    r = spark.range(1).select(RD.fill("{a}-{b}-{c}-{a}", {"a": F.lit("{b}"), "b": F.lit(None).cast("string")}).alias("x")).first()
    assert r.x == "{b}-None-{c}-{b}"


def test_wide_rows_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Recurring texts make small files of large rows; by their files the joins broadcast them all."""
    plans = []

    def stored(df, name="table", compression=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name, compression)

    monkeypatch.setattr(RD, "materialize", stored)
    rule = lambda t, a, s: QUIET if t % 2 and s == "classify" else NEWS if s == "classify" else "draft " * 100 if s == "generate" else "{}"
    topics = [(i, f"topic {i % 3}") for i in range(60)]

    def rows():
        got = run(spark, topics, rule)[3]
        plans.append(("outcomes", got.outcomes._jdf.queryExecution().executedPlan().toString()))
        plans.append(("requests", got.requests._jdf.queryExecution().executedPlan().toString()))
        return sorted(map(tuple, got.outcomes.collect())), sorted(map(str, got.requests.collect()))

    sent = rows()
    # the few texts that were gathered may be sent, by their measured size; topics, requests and replies may not
    wide = [name for name, plan in plans if "Broadcast" in plan and "requests" not in name]
    assert not wide and len(sent[0]) == 60 and len(sent[1]) == 60 * 7
    plans.clear()
    monkeypatch.setattr(RD, "SENT_BYTES", -1)
    assert rows() == sent and not [name for name, plan in plans if "Broadcast" in plan]
