"""Context assembly and decision tables.

Model replies arrive as a table of JSON text.  They are parsed with
``try_parse_json`` (VARIANT): invalid JSON is NULL, and a valid reply that
is not an object is told apart from ``{}`` by ``schema_of_variant``.
Contexts are string aggregates sorted inside the array (``collect_list``
order is not guaranteed), grouped by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(v: Column) -> Column:
    """Python truthiness of a VARIANT value; NULL (missing key) is False."""
    t = F.schema_of_variant(v)
    num = t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
    return (F.when(v.isNull(), F.lit(False))
             .when(t == "VOID", F.lit(False))
             .when(t == "BOOLEAN", F.variant_get(v, "$", "boolean"))
             .when(num, F.variant_get(v, "$", "double") != 0)
             .when(t == "STRING", F.length(F.variant_get(v, "$", "string")) > 0)
             .when(t.startswith("ARRAY"), F.size(F.variant_get(v, "$", "array<variant>")) > 0)
             .when(t.startswith("OBJECT"), t != "OBJECT<>")
             .otherwise(F.lit(False)))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parse_classifier(reply) -> Column:                                    # G5-G7
    """struct(reply_ok, needs_news, categories).  Invalid JSON or a non-object
    reply gives the default (False, []) with reply_ok = False."""
    v = F.try_parse_json(_c(reply))
    ok = _is_object(v)
    allowed = F.array(*[F.lit(c) for c in L.ALLOWED_CATEGORIES])
    cats = F.coalesce(F.try_variant_get(v, "$.categories", "array<string>"),
                      F.array().cast("array<string>"))
    cats = F.filter(cats, lambda c: F.array_contains(allowed, c))          # G6
    cats = F.when(ok, cats).otherwise(F.array().cast("array<string>"))
    nn = F.when(ok, truthy(F.variant_get(v, "$.needs_news", "variant"))).otherwise(F.lit(False))
    nn = F.when(F.size(cats) == 0, F.lit(False)).otherwise(nn)             # G7
    return F.struct(ok.alias("reply_ok"), nn.alias("needs_news"), cats.alias("categories"))


def parse_critic(reply) -> Column:                                        # G9
    """struct(reply_ok, passed, feedback); invalid JSON -> not passed with
    the fixed feedback text."""
    v = F.try_parse_json(_c(reply))
    ok = _is_object(v)
    passed = F.when(ok, truthy(F.variant_get(v, "$.passed", "variant"))).otherwise(F.lit(False))
    fb = F.when(v.isNull(), F.lit(L.INVALID_CRITIC_FEEDBACK)) \
          .otherwise(F.try_variant_get(v, "$.feedback", "string"))
    return F.struct(ok.alias("reply_ok"), passed.alias("passed"), fb.alias("feedback"))


def route(passed: Column, attempts: Column, max_attempts: int = L.MAX_ATTEMPTS) -> Column:  # G10
    return F.when(passed, F.lit("end")).when(attempts >= max_attempts, F.lit("end")) \
            .otherwise(F.lit("regenerate"))


def resolve_attempts(log: DataFrame, topic: str = "topic_id", attempt: str = "attempt",
                     max_attempts: int = L.MAX_ATTEMPTS) -> DataFrame:    # G11, G12
    """Per topic: the attempt at which routing ended (first pass, or the
    max-th attempt), or the last attempt with status 'open'.  Two partial
    aggregates and one join on the unique (topic, attempt) key."""
    x = log.filter(F.col(attempt) <= max_attempts) \
           .withColumn("route", route(F.col("passed"), F.col(attempt), max_attempts))
    fin = x.groupBy(topic).agg(
        F.min(F.when(F.col("route") == "end", F.col(attempt))).alias("__end"),
        F.max(attempt).alias("__last"))
    fin = fin.select(topic, F.coalesce("__end", "__last").alias(attempt),
                     F.when(F.col("__end").isNotNull(), F.lit("end")).otherwise(F.lit("open")).alias("status"))
    return fin.join(x, [topic, attempt], "inner")


def render(template: str, values: dict[str, Column]) -> Column:           # G4
    """Fill ``{name}`` placeholders of a user template with column values."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("None")))
    return out


def py_str(c: Column) -> Column:
    """How Python prints a value inside an f-string: NULL -> 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def join_blocks(df: DataFrame, group: str, order: str, block: Column, sep: str,
                out: str = "context") -> DataFrame:                       # G1-G3
    """Concatenate per-row blocks per group in ``order`` with ``sep``."""
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                   block.alias("b")))).alias("__a"))
    return g.select(group, F.array_join(F.transform("__a", lambda s: s["b"]), sep).alias(out))


def example_block(i: Column, source: Column, subreddit: Column, score: Column, text: Column) -> Column:
    """One retrieved example, as the RAG context renders it."""
    return F.concat(F.lit("\nExample "), i.cast("string"), F.lit("\nSource: "), py_str(source),
                    F.lit("\nSubreddit: "), py_str(subreddit), F.lit("\nScore: "), py_str(score),
                    F.lit("\n\n"), py_str(text), F.lit("\n"))


def news_block(rank: Column, title: Column, source: Column, published: Column,
               summary: Column, url: Column, score: Column) -> Column:
    pub = F.when(published.isNull(), F.lit("None")).otherwise(
        F.concat(F.date_format(published, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
    return F.concat(F.lit("News #"), rank.cast("string"), F.lit("\nTitle: "), py_str(title),
                    F.lit("\nSource: "), py_str(source), F.lit("\nPublished: "), pub,
                    F.lit("\nSummary: "), py_str(summary), F.lit("\nURL: "), py_str(url),
                    F.lit("\nRelevance Score: "), F.format_string("%.4f", score), F.lit("\n"))
