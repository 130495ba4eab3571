"""Multi-signal ranking.

Each signal is a column expression over already-normalized columns, so the
five signals and the weighted score are one projection inside whole-stage
codegen (lexicon lookups are literal arrays / maps, no joins).  Diversity
selection (R8-R10) is an in-group fold over each query's candidates, which
the retrieval step bounds to ``limit`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as TX
from ..functions import vectors as V
from . import fold


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def freshness(published: str, as_of: str) -> Column:                     # R1
    """exp(-(0.693/48) * max(0, age_hours)); unknown date -> 0.50."""
    p = F.col(published)
    age_s = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(p)) / F.lit(1e6)
    hours = F.greatest(F.lit(0.0), age_s / F.lit(3600.0))
    return F.when(p.isNull(), F.lit(L.FRESHNESS_DEFAULT)) \
            .otherwise(F.exp(F.lit(-L.FRESHNESS_DECAY) * hours))


def source_quality(source, table: dict | None = None, normalized: Column | None = None) -> Column:  # R2
    """Exact name, else the first known name that prefixes it, else 0.50.
    ``normalized`` may pass an already materialized ranking form of source."""
    table = table if table is not None else L.SOURCE_QUALITY
    s = F.col(source) if isinstance(source, str) else source
    n = normalized if normalized is not None else TX.normalize_text(s)
    exact = F.element_at(F.create_map(*[x for k, v in table.items()
                                        for x in (F.lit(k), F.lit(float(v)))]), n)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v"))
                        for k, v in table.items()])
    prefix = F.try_element_at(F.filter(entries, lambda e: F.startswith(n, e["k"])), F.lit(1))["v"]
    val = F.coalesce(exact, prefix, F.lit(L.UNKNOWN_SOURCE_QUALITY))
    return F.when(s.isNull() | (s == ""), F.lit(L.UNKNOWN_SOURCE_QUALITY)).otherwise(val)


def title_relevance(query_n: Column, title_n: Column) -> Column:         # R3
    """1.0 for the phrase inside the title; else .60 coverage + .25 ordered
    + .15 dominance, clamped.  An ordered window of query tokens in the title
    implies the phrase is a substring, so the ordered term is always 0 here."""
    qt = TX.split_words(query_n)
    tt = TX.split_words(title_n)
    nq = F.size(qt)
    coverage = F.size(F.filter(qt, lambda t: F.array_contains(tt, t))) / nq
    dominance = F.when(nq == 1, F.when(F.array_contains(tt, F.element_at(qt, 1)), 1.0).otherwise(0.0)) \
                 .otherwise(F.least(F.lit(1.0), nq / F.greatest(F.size(tt), F.lit(1))))
    mix = (F.lit(L.TITLE_COVERAGE_W) * coverage + F.lit(L.TITLE_ORDERED_W) * F.lit(0.0)
           + F.lit(L.TITLE_DOMINANCE_W) * dominance)
    score = F.when(F.contains(title_n, query_n), F.lit(1.0)).otherwise(mix)
    return F.when((query_n == "") | (title_n == "") | (nq == 0), F.lit(0.0)) \
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _hits(terms: list[str], title_n: Column, text_n: Column,
          title_words: Column, text_words: Column) -> Column:
    """Title occurrence counts 2, text-only occurrence 1 (title is inside text)."""
    single = [t for t in terms if " " not in t]
    multi = [t for t in terms if " " in t]
    h = F.lit(0)
    if single:
        a = _arr(single)
        h = h + F.size(F.array_intersect(a, title_words)) + F.size(F.array_intersect(a, text_words))
    if multi:
        b = _arr(multi)
        h = h + F.size(F.filter(b, lambda t: F.contains(title_n, t))) \
              + F.size(F.filter(b, lambda t: F.contains(text_n, t)))
    return h


def _substring_hits(terms: list[str], title_n: Column, text_n: Column) -> Column:
    a = _arr(terms)
    return F.size(F.filter(a, lambda t: F.contains(title_n, t))) + \
        F.size(F.filter(a, lambda t: F.contains(text_n, t)))


def newsworthiness(raw_title: Column, title_n: Column, summary_n: Column) -> Column:  # R4
    """Base .50, + current-event hits, - evergreen, - analysis, - headline
    shape penalties, clamped to [0, 1].  ``title_n``/``summary_n`` are the
    ranking-normalized title and summary; pass materialized columns: they are
    read inside the lexicon lambdas, once per term."""
    text_n = F.concat(title_n, F.lit(" "), summary_n)
    tw = F.array_distinct(F.split(title_n, " "))
    xw = F.array_distinct(F.split(text_n, " "))
    cur = F.least(_hits(L.CURRENT_EVENT_TERMS, title_n, text_n, tw, xw), F.lit(L.CURRENT_EVENT_CAP))
    ever = F.least(_substring_hits(L.EVERGREEN_TERMS, title_n, text_n), F.lit(L.EVERGREEN_CAP))
    ana = F.least(_hits(L.ANALYSIS_TERMS, title_n, text_n, tw, xw), F.lit(L.ANALYSIS_CAP))
    nw = rf"[^{TX.WORD}]"
    question = F.when(F.contains(F.coalesce(raw_title, F.lit("")), F.lit("?")), L.QUESTION_PENALTY).otherwise(0.0)
    explainer = F.when(title_n.rlike(rf"^(what|how|why)(?:{nw}|$)"), L.EXPLAINER_PENALTY).otherwise(0.0)
    year = F.when(title_n.rlike(rf"(?:^|{nw})(?:19|20)\p{{Nd}}{{2}}(?:{nw}|$)"), L.YEAR_PENALTY).otherwise(0.0)
    listicle = F.when(F.exists(_arr(L.LISTICLE_PHRASES), lambda p: F.contains(title_n, p)),
                      L.LISTICLE_PENALTY).otherwise(0.0)
    score = (F.lit(L.NEWS_BASE) + cur * F.lit(L.CURRENT_EVENT_STEP) - ever * F.lit(L.EVERGREEN_STEP)
             - ana * F.lit(L.ANALYSIS_STEP) - question - explainer - year - listicle)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def final_score(sem: Column, fresh: Column, src: Column, title: Column, news: Column,
                weights: dict | None = None) -> Column:                   # R5
    w = weights or L.WEIGHTS
    return (F.lit(w["semantic"]) * sem + F.lit(w["freshness"]) * fresh + F.lit(w["source"]) * src
            + F.lit(w["title"]) * title + F.lit(w["newsworthiness"]) * news)


def score_articles(df: DataFrame, as_of: str, weights: dict | None = None,
                   query_col: str = "query", title_col: str = "title",
                   summary_col: str = "summary", source_col: str = "source",
                   published_col: str = "published", semantic_col: str = "semantic") -> DataFrame:
    """R1-R6 as one projection; expects the semantic similarity column."""
    # Normalized forms are materialized first: the signals read them inside
    # higher-order-function lambdas, where an expression would be evaluated
    # again for every lexicon term.
    x = (df.withColumn("__tn", TX.normalize_text(title_col))
           .withColumn("__sn", TX.normalize_text(summary_col))
           .withColumn("__qn", TX.normalize_text(query_col))
           .withColumn("__srcn", TX.normalize_text(source_col)))
    tn, sn, qn = F.col("__tn"), F.col("__sn"), F.col("__qn")
    x = (x.withColumn("freshness", freshness(published_col, as_of))
          .withColumn("source_score", source_quality(source_col, normalized=F.col("__srcn")))
          .withColumn("title_score", title_relevance(qn, tn))
          .withColumn("newsworthiness", newsworthiness(F.col(title_col), tn, sn)))
    x = x.drop("__tn", "__sn", "__qn", "__srcn")
    x = x.withColumn("score", final_score(F.col(semantic_col), F.col("freshness"),
                                          F.col("source_score"), F.col("title_score"),
                                          F.col("newsworthiness"), weights))
    return x.withColumn("details", F.struct(
        F.col(semantic_col).alias("semantic"), F.col("freshness").alias("freshness"),
        F.col("source_score").alias("source"), F.col("title_score").alias("title"),
        F.col("newsworthiness").alias("newsworthiness")))                 # R6


def source_cap(df: DataFrame, group: str, score: str, input_order: str, source: str,
               max_per_source: int = L.MAX_PER_SOURCE) -> DataFrame:
    """R8 on its own (no duplicate rule): the best ``max_per_source`` rows of
    each source per group, by score (desc, stable).  Without the duplicate
    rule a skip cannot change later decisions, so this is an exact window;
    the ``<=`` filter is limited partially before the shuffle."""
    skey = TX.normalize_text(F.coalesce(F.col(source), F.lit("unknown")))
    w = Window.partitionBy(group, "__skey").orderBy(
        F.round(F.col(score), SCORE_ORDER_DECIMALS).desc(), F.col(input_order).asc())
    return (df.withColumn("__skey", skey).withColumn("__n", F.row_number().over(w))
              .filter(F.col("__n") <= max_per_source).drop("__n", "__skey"))


# Scores are compared after rounding to 12 decimals so that float noise from
# a different summation order cannot reorder exact ties; ties then keep the
# input order (stable sort, R7).
SCORE_ORDER_DECIMALS = 12


def diverse_select(df: DataFrame, group: str, score: str, input_order: str, vec: str,
                   source: str, top_k: int = 10,
                   threshold: float = L.SIMILARITY_THRESHOLD,
                   max_per_source: int = L.MAX_PER_SOURCE,
                   payload: list[str] | None = None) -> DataFrame:
    """Walk candidates by score (desc, stable); skip a row whose
    source already has ``max_per_source`` picks, or whose vector has inner
    product >= ``threshold`` with any pick; stop at ``top_k``.

    The per-group candidate list is bounded by the retrieval limit (N6), so
    the walk is a fold over the group's sorted array.
    """
    payload = payload or []
    skey = TX.normalize_text(F.coalesce(F.col(source), F.lit("unknown")))
    x = df.withColumn("__skey", skey) \
          .withColumn("__neg", -F.round(F.col(score), SCORE_ORDER_DECIMALS))
    cols = [score, vec, "__skey", *[p for p in payload if p not in (score, vec, input_order)]]
    g = x.groupBy(group).agg(fold.sorted_items(["__neg", input_order], cols).alias("items"))

    def reject(acc, c):
        n_src = F.size(F.filter(acc, lambda y: y["__skey"] == c["__skey"]))
        dup = F.exists(acc, lambda y: V.dot(y[vec], c[vec]) >= F.lit(threshold))
        return (n_src >= max_per_source) | dup

    picked = g.select(group, fold.fold_select(F.col("items"), reject, top_k).alias("acc"))
    out = fold.explode_selected(picked, [group], "acc", "__pick")
    out = out.withColumnRenamed(input_order, f"input_{input_order}")
    return out.withColumnRenamed("__pick", "rank").drop("__neg", "__skey")
