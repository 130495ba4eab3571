"""Feed entries: cleaning, article predicates (Q1-Q9) and retrieval.

Everything that depends on one entry only is a column expression and runs
first; the query match is an equi-join of posting keys (``postings``,
never a cross join); only then does the order-dependent dedupe run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as TX
from . import fold

# ---------------------------------------------------------------------------
# Cleaning and keys
# ---------------------------------------------------------------------------

# Evaluate-once barrier.  Catalyst pushes a filter below the projection that
# defines its columns by substituting their definitions; a predicate that
# reads ``summary`` three times then runs the whole cleaning chain three
# times per row.  The projection below carries a partition-id column (a
# nondeterministic expression, so the filter is not pushed through it) and
# ``keep`` references it, so the cleaned columns are computed once.
ONCE = "__once"


def keep(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on columns of ``prepare_entries`` without re-inlining them."""
    if ONCE not in df.columns:
        return df.filter(cond)
    return df.filter((F.col(ONCE) >= 0) & cond).drop(ONCE)



def prepare_entries(df: DataFrame, title: str = "raw_title", link: str = "url",
                    summary: str = "raw_summary", source: str | None = "source",
                    default_source: str | None = L.DEFAULT_SOURCE) -> DataFrame:
    """Clean raw entries (T1, T14) and derive the match and dedupe keys."""
    # withColumns in three batches: each call analyzes the plan once.
    first = {"title": TX.clean_text(title),
             "url": TX.strip(F.coalesce(F.col(link), F.lit(""))),
             "summary": TX.clean_text(summary)}
    if source is not None and default_source is not None:
        first["source"] = TX.source_or_default(source, default_source)
    x = df.withColumns(first)
    x = x.withColumns({"title_n": TX.normalize("title"), "summary_n": TX.normalize("summary"),
                       "url_key": F.lower("url"), "article_key": TX.article_key("url", "title")})
    x = x.withColumns({"text_n": F.trim(F.concat_ws(" ", "title_n", "summary_n")),
                       "title_key": F.col("title_n"), ONCE: F.spark_partition_id()})
    # tokens of text_n, computed once: the match rule reads them per term
    return x.withColumn("text_tokens", TX.split_words(F.col("text_n")))


def has_title_and_link() -> Column:                                       # Q1
    return (F.col("title") != "") & (F.col("url") != "")


def has_meaningful_content(title="title", summary="summary") -> Column:  # Q2
    t, s = TX.strip(title), TX.strip(summary)
    return (F.length(t) >= L.MIN_TITLE_CHARS) & ((s == "") | (F.length(s) >= L.MIN_SUMMARY_CHARS))


def is_recent(published: str, as_of: str, max_age_hours: int = L.MAX_AGE_HOURS) -> Column:  # Q3
    """NULL kept, future kept, else age <= max_age_hours (inclusive)."""
    p = F.col(published)
    bound = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    return p.isNull() | (p >= bound)


def looks_like_landing_page(title_n="title_n") -> Column:                # Q4
    t = F.col(title_n) if isinstance(title_n, str) else title_n
    return (t == "") | t.rlike(TX.alternation(L.LANDING_PAGE_PATTERNS))


def looks_evergreen(title_n="title_n") -> Column:                         # Q5
    return F.col(title_n).rlike(TX.alternation(L.EVERGREEN_PATTERNS))


def looks_like_listicle(title="title") -> Column:                         # Q6
    return F.col(title).rlike(rf"^[{TX.WS}]*\p{{Nd}}+[{TX.WS}]+")


def looks_like_analysis(title_n="title_n") -> Column:                     # Q7
    return F.col(title_n).rlike(TX.alternation(L.ANALYSIS_PATTERNS))


# ---------------------------------------------------------------------------
# Queries and the query match (Q8)
# ---------------------------------------------------------------------------


def prepare_queries(topics: DataFrame, id_col: str = "topic_id", text_col: str = "topic") -> DataFrame:
    """Guarded (T15) query table with its normalized forms."""
    q = topics.select(F.col(id_col).alias("query_id"), TX.strip(text_col).alias("query"))
    q = q.filter(F.col("query") != "")
    q = q.withColumn("qn", TX.normalize("query"))
    qn = F.col("qn")
    stop = F.array(*[F.lit(s) for s in L.STOPWORDS])
    return q.withColumns({
        "terms": F.filter(TX.split_words(qn), lambda t: ~F.array_contains(stop, t)),
        "aliases": F.coalesce(F.element_at(TX.alias_map(), qn), F.array(qn)),
        "is_entity": F.element_at(TX.alias_map(), qn).isNotNull()})


def matches_query() -> Column:
    """The full Q8 rule on a joined (entry, query) row (``text_tokens`` is
    the materialized token array of ``text_n``)."""
    text_tokens = F.col("text_tokens")
    return (F.when(F.col("qn") == "", F.lit(False))
             .when(F.col("is_entity"), TX.contains_alias(F.col("text_n"), F.col("aliases")))
             .when(F.size("terms") == 0, TX.contains_alias(F.col("text_n"), F.col("aliases")))
             .when(F.contains(F.col("title_n"), F.col("qn")), F.lit(True))
             .otherwise(F.forall("terms", lambda t: F.array_contains(text_tokens, t))))


def match_candidates(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(entry, query) rows that satisfy Q8, without a cross join: both sides
    meet in a posting table of tokens and short character sequences."""
    from . import postings

    out = postings.match_entries(entries, queries, matches_query())
    return out.select(*entries.columns, *queries.columns)


# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------


def news_for_query(entries: DataFrame, topics: DataFrame, as_of: str,
                   limit: int = L.QUERY_LIMIT, max_age_hours: int = L.MAX_AGE_HOURS,
                   inspect_cap: int | None = None, id_col: str = "topic_id",
                   text_col: str = "topic", method: str = "auto") -> DataFrame:
    """T15 -> N4 -> T1 -> Q1 -> T14 -> Q2 -> Q8 -> Q4 -> Q3 -> N5 -> N6 -> N7.

    ``entries`` are raw feed rows with ``position`` (feed order).  All
    stateless filters run before the match; the two-key dedupe (N5) and the
    first-``limit`` cut (N6) run per query through ``fold.greedy_two_key``
    (``method``: ``auto`` picks the in-group fold when groups are proven
    small, else the exact rounds; ``fold`` / ``rounds`` force one).
    ``inspect_cap`` = the reference's max(5*limit, 100) raw-entry window,
    which also bounds every group; ``None`` inspects the whole feed.
    """
    e = entries
    if inspect_cap is not None:
        e = e.filter(F.col("position") < inspect_cap)                   # N4
    e = prepare_entries(e)                                               # T1, T14
    e = keep(e, has_title_and_link()                                     # Q1
             & has_meaningful_content()                                  # Q2
             & ~looks_like_landing_page()                                # Q4
             & is_recent("published", as_of, max_age_hours))             # Q3
    q = prepare_queries(topics, id_col, text_col)                        # T15
    m = match_candidates(e, q)                                           # Q8
    keys = (["query_id"], "position", "url_key", "title_key")
    if method == "fold":
        picked = fold.greedy_two_key_fold(m, *keys, limit=limit)
    elif method == "rounds":
        picked = fold.greedy_two_key_rounds(m, *keys, limit=limit)
    else:
        picked = fold.greedy_two_key(m, *keys, limit=limit,
                                     known_max_group=inspect_cap)      # N5, N6
    w = Window.partitionBy("query_id").orderBy(F.col("published").desc_nulls_last(),
                                               F.col("position").asc())
    return picked.withColumn("rank", F.row_number().over(w).cast("long"))  # N7


def news_for_query_fold(entries: DataFrame, topics: DataFrame, as_of: str,
                        limit: int = L.QUERY_LIMIT, max_age_hours: int = L.MAX_AGE_HOURS,
                        inspect_cap: int | None = None) -> DataFrame:
    """``news_for_query`` with the in-group fold forced (bounded feeds)."""
    return news_for_query(entries, topics, as_of, limit, max_age_hours, inspect_cap, method="fold")


def category_feed(entries: DataFrame, categories: list[str] | None, as_of: str,
                  limit_per_source: int = L.LIMIT_PER_SOURCE,
                  max_age_hours: int = L.MAX_AGE_HOURS,
                  catalogue: DataFrame | None = None) -> DataFrame:
    """N1-N3 + S14: per-source head, clean, filter, dedupe across categories.

    ``entries``: (category, source, position, raw_title, url, raw_summary,
    published).  ``catalogue`` gives (category, source, source_order); when
    absent, sources are ordered by name within their category.  Requested
    categories keep their order; unknown ones join to nothing (Q9).
    """
    spark = entries.sparkSession
    if not categories:
        return spark.createDataFrame([], "category string, source string, title string, "
                                         "url string, summary string, published timestamp")
    req = spark.createDataFrame([(c, i) for i, c in enumerate(categories)],
                                "category string, category_pos int")
    if catalogue is None:
        catalogue = (entries.select("category", "source").distinct()
                     .withColumn("source_order", F.dense_rank().over(
                         Window.partitionBy("category").orderBy("source")) - 1))
    cat = catalogue.join(F.broadcast(req), "category")                   # S10, Q9
    e = entries.join(cat.select("category", "source", "source_order", "category_pos"),
                     ["category", "source"])
    w1 = Window.partitionBy("category", "source").orderBy("position")
    e = e.withColumn("__n", F.row_number().over(w1)).filter(F.col("__n") <= limit_per_source)  # N1
    e = prepare_entries(e, default_source=None)
    e = keep(e, has_title_and_link() & has_meaningful_content()
             & is_recent("published", as_of, max_age_hours))
    w2 = Window.partitionBy(F.xxhash64("article_key"), "article_key").orderBy(
        "category_pos", "source_order", "position")
    e = e.withColumn("__k", F.row_number().over(w2)).filter(F.col("__k") == 1)   # N2, N3
    return e.select("category", "source", "title", "url", "summary", "published",
                    "category_pos", "source_order", "position")
