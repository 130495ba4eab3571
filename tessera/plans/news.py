"""Query -> ranked news, as one Spark job over many queries at once.

entries ⋈ queries (equi-join on candidate ids) -> stateless filters ->
two-key greedy dedupe -> embeddings -> five signals (one projection) ->
diversity fold per query.  Every grouped step is keyed by ``query_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import articles as A
from ..operators import embed as EM
from ..operators import ranking as R
from ..session import materialize, scratch_path


def candidates(entries: DataFrame, topics: DataFrame, as_of: str,
               limit: int = L.QUERY_LIMIT, inspect_cap: int | None = None) -> DataFrame:
    """N8 result (per query, newest first) with the query text attached."""
    got = A.news_for_query(entries, topics, as_of, limit=limit, inspect_cap=inspect_cap)
    return got


def ranked(entries: DataFrame, topics: DataFrame, as_of: str, limit: int = L.QUERY_LIMIT,
           inspect_cap: int | None = None, embedding=EM.hashed_embedding,
           weights: dict | None = None) -> DataFrame:
    """R11 before diversity: every candidate with its score and details."""
    c = candidates(entries, topics, as_of, limit, inspect_cap)
    c = materialize(c.withColumn("article_text", TX.article_text("title", "summary")), "candidates")  # T6
    table = EM.VectorTable(c.sparkSession, scratch_path(c.sparkSession, "vectors"), embedding)
    table.fill(c.select("article_text").unionByName(c.select(F.col("query").alias("article_text"))))   # V1, V3
    c = table.attach(table.attach(c, "article_text", "vec"), "query", "qvec")
    c = c.withColumn("semantic", V.dot("vec", "qvec"))                         # V10
    return R.score_articles(c, as_of, weights)                                 # R1-R6


def diverse(entries: DataFrame, topics: DataFrame, as_of: str, top_k: int = 10,
            limit: int = L.QUERY_LIMIT, threshold: float = L.SIMILARITY_THRESHOLD,
            max_per_source: int = L.MAX_PER_SOURCE, inspect_cap: int | None = None,
            embedding=EM.hashed_embedding, payload_extra: list[str] | None = None) -> DataFrame:
    """Ranked, diversified top_k per query."""
    s = ranked(entries, topics, as_of, limit, inspect_cap, embedding)
    payload = ["article_id", "title", "url", "source", "published", "semantic", "freshness",
               "source_score", "title_score", "newsworthiness", "details", "query",
               *(payload_extra or [])]
    return R.diverse_select(s, "query_id", "score", "rank", "vec", "source", top_k,
                            threshold, max_per_source, payload)
