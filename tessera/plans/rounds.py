"""Topic rounds (G1-G13): classify, gather, generate, critique, route, repeat.

The loop runs over sets, not over topics: every step is one job for all topics
that are still open.  A step's requests are rows ``(topic_id, attempt, stage,
prompt)``; the model is any function from such rows to ``(topic_id, attempt,
stage, reply)``, for instance a batch inference job or, as in the registered
query, a join with logged replies.  It is called once a step, and requests and
replies are written to the checkpoint folder first: a lost executor never asks
a model twice, and the next step reads what was answered.

The gate stands before the work: news are gathered only for topics whose
decision wants them, and for each distinct topic text once.

Topics move as narrow rows with the key of their text; what was gathered is a
table by that key, met where a prompt is written.  Stored tables whose texts
recur are small files and large rows, and the planner sees the files: what a
join may send to all tasks is measured, the other joins sort.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as TX
from ..operators import decisions as G
from ..session import materialize

REQUEST = ["topic_id", "attempt", "stage", "prompt"]
#: Bytes of gathered texts that are sent to all tasks.
SENT_BYTES = 8_000_000


@dataclass(frozen=True)
class Templates:
    """User texts with placeholders in braces: classify {topic}; generate
    {topic} {context} {news} {critique}; critique {topic} {draft} {context} {news}."""
    classify: str
    generate: str
    critique: str


@dataclass(frozen=True)
class Rounds:
    """``requests``: every request with its reply, for critiques the route;
    ``outcomes``: one row a topic with its last draft and verdict;
    ``rejected``: topics that were not run, with the reason."""
    requests: DataFrame
    outcomes: DataFrame
    rejected: DataFrame


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with its ``{name}`` placeholders filled in one pass, so a
    value that holds a placeholder is left as it is; a null prints ``None``."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(*[G.py_str(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def critique_json(verdict: Column) -> Column:
    """The verdict that a rewrite is asked to heed; ``{}`` before the first one."""
    return F.when(verdict.isNull(), F.lit("{}")).otherwise(
        F.to_json(F.struct(verdict["passed"].alias("passed"), verdict["feedback"].alias("feedback")), {"ignoreNullFields": "false"}))


def per_text(topics: DataFrame, work: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """(text_key, ``out``), stored: ``work`` sees each distinct text once, as
    (topic_id, topic) with the key of the text as id, and answers (query_id, ``out``)."""
    texts = topics.select(F.col("text_key").alias("topic_id"), "topic").dropDuplicates(["topic_id"])
    return materialize(work(texts).select(F.col("query_id").alias("text_key"), out), out)


def _placed(made: DataFrame, out: str) -> DataFrame:
    """``made`` as one side of a join: sent to all tasks only if its texts are few bytes as they are."""
    size = made.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(out), F.lit(0)) + 64), F.lit(0))).first()[0]
    return F.broadcast(made) if size <= SENT_BYTES else made.hint("merge")


def _ask(requests: DataFrame, reply, name: str, *kept: str) -> tuple[DataFrame, DataFrame]:
    """(asked, answered), both stored: the requests with a number, and by that
    number the ``kept`` columns and the reply, null where there is none yet.
    Prompts stay where they are written."""
    asked = materialize(requests.select(*REQUEST, *kept, F.monotonically_increasing_id().alias("_row")), f"{name}-requests")
    answers = reply(asked.select(*REQUEST)).select("topic_id", "attempt", "stage", "reply")
    answered = asked.drop("prompt").join(answers.hint("merge"), ["topic_id", "attempt", "stage"], "left")
    return asked, materialize(answered, f"{name}-replies")


def _logged(asked: DataFrame, answered: DataFrame, route: Column) -> DataFrame:
    """Requests with their replies and ``route``."""
    said = answered.select("_row", "reply", route.cast("string").alias("route"))
    return asked.select("_row", *REQUEST).join(said.hint("merge"), "_row").drop("_row")


def run(topics: DataFrame, reply: Callable[[DataFrame], DataFrame], templates: Templates,
        contexts: Callable[[DataFrame], DataFrame], news: Callable[[DataFrame], DataFrame],
        max_attempts: int = L.MAX_ATTEMPTS) -> Rounds:
    """Run all ``topics`` (unique ``topic_id``, ``topic``) to their end.

    ``contexts`` and ``news`` map (topic_id, topic) rows of distinct texts to
    (query_id, context) and (query_id, news).  A topic ends when its draft
    passes or after ``max_attempts`` drafts; one whose request has no reply
    waits, and takes no part in later rounds.
    """
    blank = F.coalesce(TX.strip("topic"), F.lit("")) == ""
    rejected = topics.where(blank).select("topic_id", F.lit("blank topic").alias("reason"))
    first = topics.where(~blank).select("topic_id", F.col("topic"))
    number = lambda n: F.lit(n).cast("bigint").alias("attempt")

    # classify, then gather: news behind the gate, each distinct text once
    asked, classified = _ask(first.select("topic_id", number(0), F.lit("classify").alias("stage"),
                                          fill(templates.classify, {"topic": F.col("topic")}).alias("prompt"), "topic"), reply, "classify", "topic")
    decided = classified.where("reply is not null").withColumn("d", G.parse_classifier("reply"))
    state = materialize(decided.select("topic_id", "topic", F.xxhash64("topic").alias("text_key"), "d.needs_news", "d.categories"), "decided")
    found = _placed(per_text(state, contexts, "context"), "context")
    wanted = _placed(per_text(state.where("needs_news"), news, "news"), "news")

    def gathered(rows: DataFrame) -> DataFrame:
        """``rows`` of topics with the texts found for them, empty where there are none."""
        rows = rows.join(found, "text_key", "left").join(wanted, "text_key", "left")
        return rows.withColumns({"context": F.coalesce("context", F.lit("")),
                                 "news": F.when(F.col("needs_news"), F.coalesce("news", F.lit(""))).otherwise(F.lit(""))})

    log = [_logged(asked, classified, F.lit(None))]
    ends = []
    verdict_type = "struct<passed:boolean,feedback:string>"
    own = ["topic", "text_key", "needs_news"]
    still = state.select("topic_id", *own, F.lit(None).cast(verdict_type).alias("verdict"))
    given = {c: F.col(c) for c in ("topic", "context", "news")}
    for attempt in range(1, max_attempts + 1):
        asked, drafts = _ask(gathered(still).select(
            "topic_id", number(attempt), F.lit("generate").alias("stage"), *own,
            fill(templates.generate, given | {"critique": critique_json(F.col("verdict"))}).alias("prompt")), reply, "generate", *own)
        log.append(_logged(asked, drafts, F.when(F.col("reply").isNull(), F.lit("wait"))))
        written = drafts.where("reply is not null").select("topic_id", *own, F.col("reply").alias("draft"))
        asked, judged = _ask(gathered(written).select(
            "topic_id", number(attempt), F.lit("critique").alias("stage"), *own,
            fill(templates.critique, given | {"draft": F.col("draft")}).alias("prompt")), reply, "critique", *own)
        judged = judged.withColumn("verdict", F.when(F.col("reply").isNotNull(), G.parse_critic("reply")))
        judged = judged.withColumn("route", F.when(F.col("reply").isNull(), F.lit("wait")).otherwise(
            G.route(F.col("verdict.passed"), F.col("attempt"), max_attempts)))
        log.append(_logged(asked, judged, F.col("route")))
        result = judged.select("topic_id", "attempt", "route", F.col("verdict.passed").alias("passed"), F.col("verdict.feedback").alias("feedback"))
        ends.append(drafts.select("topic_id", F.col("reply").alias("draft")).join(result.hint("merge"), "topic_id", "left")
                    .where("route is null or route <> 'regenerate'")
                    .select("topic_id", number(attempt), F.when(F.col("route") == "end", F.lit("end")).otherwise(F.lit("waiting")).alias("status"),
                            "passed", "feedback", "draft"))
        still = materialize(judged.where("route = 'regenerate'").select(
            "topic_id", *own, F.struct(F.col("verdict.passed"), F.col("verdict.feedback")).cast(verdict_type).alias("verdict")), "open")
        if still.isEmpty():
            break
    undecided = classified.where("reply is null").select("topic_id", number(0), F.lit("waiting").alias("status"), F.lit(None).cast("boolean").alias("passed"),
                                                         F.lit(None).cast("string").alias("feedback"), F.lit(None).cast("string").alias("draft"))
    join = lambda parts: reduce(DataFrame.unionByName, parts)
    return Rounds(join(log), join([*ends, undecided]), rejected)
