"""DuckDB statements equivalent to the registered queries (the oracle).

Tables region..conversations are views over the same parquet files.  CTEs
below rebuild the derived views (articles, topics, ...) in DuckDB SQL.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["vector_topk"] = """
WITH ex AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS x
            FROM embeddings),
mm AS (SELECT pos, avg(x) AS m FROM ex GROUP BY pos),
ca AS (SELECT list(m ORDER BY pos) AS a FROM mm),
cn AS (SELECT a, sqrt(list_sum(list_transform(a, lambda z: z * z))) AS nrm FROM ca),
q AS (SELECT 0::BIGINT AS query_id,
             list_transform(a, lambda z: CASE WHEN nrm = 0 THEN 0.0 ELSE z / nrm END) AS qv FROM cn),
s AS (SELECT q.query_id, e.vec_id, e.label,
             list_dot_product(e.embedding::DOUBLE[], q.qv) AS sim
      FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT r.query_id, r.rank, r.vec_id, round(r.sim, 6) AS similarity, r.label,
       d.source, substr(d.text, 1, 500) AS snippet
FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id
WHERE r.rank <= 5
"""

# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB), mirroring tessera.functions.text
# ---------------------------------------------------------------------------

from ..functions import lexicons as L  # noqa: E402
from ..functions.text import WORD, WS  # noqa: E402

# FIXED VALUES — HTML entities of the test pages.  ``&amp;`` must come last:
# replacing it first would decode ``&amp;lt;`` twice.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'),
    ("&#39;", "'"), ("&#039;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def unescape(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def clean_text(x: str) -> str:
    y = unescape(f"coalesce({x}, '')")
    y = f"regexp_replace({y}, '<[^>]+>', ' ', 'g')"
    y = f"regexp_replace({y}, '[{WS}]+', ' ', 'g')"
    return f"trim({y})"


def normalize(x: str) -> str:
    y = "lower(" + unescape(f"coalesce({x}, '')") + ")"
    return f"trim(regexp_replace({y}, '[^a-z0-9]+', ' ', 'g'))"


def normalize_text(x: str) -> str:
    y = f"lower(coalesce({x}, ''))"
    y = f"regexp_replace({y}, '[^{WORD}{WS}''-]', ' ', 'g')"
    y = f"regexp_replace({y}, '[{WS}]+', ' ', 'g')"
    return f"trim({y})"


def split_words(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def lit_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


# ---------------------------------------------------------------------------
# Curation
# ---------------------------------------------------------------------------

COMMENTS = "SELECT doc_id, text AS body, source AS subreddit, n_chars AS score FROM documents"
JOKES = ("SELECT doc_id, substring(text, 1, 40) AS title, substring(text, 41) AS selftext, "
         "n_chars AS score, source AS subreddit FROM documents")

CURATED_COMMENTS = f"""
cc_f AS (SELECT doc_id, subreddit, score, {strip('body')} AS body FROM ({COMMENTS})
         WHERE body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]')),
curated_comments AS (SELECT * FROM cc_f WHERE length(body) >= 20
         QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1)"""

CURATED_JOKES = f"""
cj_f AS (SELECT doc_id, subreddit, score,
                {strip("concat(coalesce(title, ''), chr(10), coalesce(selftext, ''))")} AS text
         FROM ({JOKES}) WHERE coalesce(selftext, '') NOT IN ('[deleted]', '[removed]')),
curated_jokes AS (SELECT * FROM cj_f WHERE length(text) >= 20
         QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"""

N_STRAT = 25

SAMPLED_COMMENTS = f"""
sampled_comments AS (SELECT * FROM curated_comments WHERE subreddit IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY subreddit
           ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= {N_STRAT})"""

BUCKETED_JOKES = """
edges AS (SELECT list_sort(list_distinct(quantile_cont(score::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e
          FROM curated_jokes WHERE score IS NOT NULL),
bucketed_jokes AS (SELECT j.*, CASE WHEN j.score IS NULL OR len(e) < 2 THEN NULL
          ELSE greatest(len(list_filter(e, lambda v: v < j.score::DOUBLE)) - 1, 0) END::INTEGER AS score_bucket
          FROM curated_jokes j, edges)"""

SAMPLED_JOKES = f"""
sampled_jokes AS (SELECT * FROM bucketed_jokes WHERE score_bucket IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY score_bucket
           ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= {L.JOKE_SAMPLE_CAP})"""

ORACLE["curate_comments"] = f"WITH {CURATED_COMMENTS} SELECT doc_id, subreddit, body, score FROM curated_comments"
ORACLE["curate_jokes"] = f"WITH {CURATED_JOKES} SELECT doc_id, subreddit, text, score FROM curated_jokes"
ORACLE["stratified_exact"] = (f"WITH {CURATED_COMMENTS}, {SAMPLED_COMMENTS} "
                              "SELECT doc_id, subreddit, body, score FROM sampled_comments")
ORACLE["stratified_capped"] = (f"WITH {CURATED_JOKES}, {BUCKETED_JOKES}, {SAMPLED_JOKES} "
                               "SELECT doc_id, text, score, score_bucket FROM sampled_jokes")
ORACLE["quantile_buckets"] = (f"WITH {CURATED_JOKES}, {BUCKETED_JOKES} SELECT score_bucket, count(*) AS n "
                              "FROM bucketed_jokes WHERE score_bucket IS NOT NULL GROUP BY score_bucket")
CORPUS = f"""{CURATED_COMMENTS}, {SAMPLED_COMMENTS}, {CURATED_JOKES}, {BUCKETED_JOKES}, {SAMPLED_JOKES},
corpus AS (
  SELECT (0::BIGINT << 48) | doc_id AS corpus_id, body AS text, 'reddit_comment' AS source, subreddit, score::BIGINT AS score
  FROM sampled_comments
  UNION ALL
  SELECT (1::BIGINT << 48) | doc_id, text, 'reddit_joke', subreddit, score::BIGINT FROM sampled_jokes)"""
ORACLE["corpus_union"] = f"WITH {CORPUS} SELECT corpus_id, source, subreddit, score, text FROM corpus"
ORACLE["corpus_counts"] = f"WITH {CORPUS} SELECT source, count(*) AS n FROM corpus GROUP BY source"
ORACLE["corpus_alignment"] = """
WITH t AS (SELECT doc_id, count(*) AS nt FROM documents GROUP BY doc_id),
     m AS (SELECT vec_id AS doc_id, count(*) AS nm FROM embeddings GROUP BY vec_id),
     j AS (SELECT t.nt, m.nm FROM t FULL OUTER JOIN m ON t.doc_id = m.doc_id)
SELECT coalesce(sum(CASE WHEN nm IS NULL THEN nt END), 0)::BIGINT AS texts_without_metadata,
       coalesce(sum(CASE WHEN nt IS NULL THEN nm END), 0)::BIGINT AS metadata_without_text,
       count(CASE WHEN nt > 1 THEN 1 END) AS duplicate_text_keys
FROM j"""
ORACLE["profile_shape"] = """
SELECT count(*) AS n_rows, 5 AS n_columns, ['doc_id', 'text', 'lang', 'source', 'n_chars'] AS columns FROM documents"""
ORACLE["profile_columns"] = """
WITH j AS (SELECT d.doc_id, l.quality, l.toxic, d.text, d.lang, d.source, d.n_chars
           FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id),
a AS (SELECT count(doc_id) c0, count(quality) c1, count(toxic) c2, count(text) c3,
             count(lang) c4, count(source) c5, count(n_chars) c6 FROM j)
SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'quality', 'int'), (2, 'toxic', 'int'),
   (3, 'text', 'string'), (4, 'lang', 'string'), (5, 'source', 'string'), (6, 'n_chars', 'bigint'))
   v(position, "column", dtype)
CROSS JOIN LATERAL (SELECT [c0, c1, c2, c3, c4, c5, c6][position + 1] AS non_null FROM a)"""
ORACLE["group_sizes"] = (f"WITH {CURATED_COMMENTS} SELECT subreddit, count(*) AS size FROM curated_comments "
                         "WHERE subreddit IS NOT NULL GROUP BY subreddit ORDER BY subreddit LIMIT 5")
ORACLE["distinct_subreddits"] = (f"WITH {CURATED_COMMENTS}, {SAMPLED_COMMENTS} "
                                 "SELECT count(DISTINCT subreddit) AS n_distinct FROM sampled_comments")
ORACLE["seeded_peek"] = (f"WITH {CURATED_COMMENTS} SELECT doc_id, subreddit, body, score FROM curated_comments "
                         "ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 10")


# ---------------------------------------------------------------------------
# Articles, queries, retrieval, ranking
# ---------------------------------------------------------------------------

from ..sources.tables import TOPICS  # noqa: E402


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def alternation(patterns) -> str:
    return q("(?:" + "|".join(patterns) + ")")


ARTICLES = """
articles AS (SELECT page_id AS article_id,
  concat(CASE page_id % 14 WHEN 0 THEN 'Breaking news: ' WHEN 1 THEN 'What is ' WHEN 2 THEN '10 '
    WHEN 3 THEN 'Opinion: ' WHEN 4 THEN 'Company announces AI deal, ' WHEN 5 THEN 'Why the 2018 '
    WHEN 6 THEN 'GTA VI trailer leaked: ' WHEN 7 THEN 'Complete guide to ' WHEN 8 THEN 'Hands-on review: '
    WHEN 9 THEN 'Is it over? ' WHEN 10 THEN 'Top reasons ' WHEN 11 THEN 'Trump said ' ELSE '' END,
    regexp_extract(html, '<title>(.*?)</title>', 1)) AS raw_title,
  CASE WHEN page_id % 17 = 0 THEN 'short' ELSE regexp_extract(html, '<p>(.*?)</p>', 1) END AS raw_summary,
  CASE WHEN page_id % 25 = 3 THEN 'http://dup.example.com/A'
       WHEN page_id % 25 = 4 THEN ' HTTP://DUP.example.com/a' ELSE url END AS url,
  CASE page_id % 9 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'BBC News'
    WHEN 2 THEN 'ABC News - Breaking News, Latest News and Videos' WHEN 3 THEN 'Ignite Blog'
    WHEN 4 THEN NULL WHEN 5 THEN 'The Hindu' WHEN 6 THEN '!!!'
    ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS source,
  regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS category,
  CASE WHEN page_id % 7 = 0 THEN NULL
       ELSE TIMESTAMP '2025-01-01 00:00:00' - to_hours(CAST(page_id % 120 AS INTEGER)) END AS published,
  page_id AS position
FROM pages)"""

AS_OF_SQL = "TIMESTAMP '2025-01-01 00:00:00'"

ENTRIES = f"""
e1 AS (SELECT article_id, position, published, category,
   {clean_text('raw_title')} AS title,
   {strip("coalesce(url, '')")} AS url,
   {clean_text('raw_summary')} AS summary,
   {strip("coalesce(nullif(source, ''), 'Google News')")} AS source
 FROM articles),
entries AS (SELECT *, {normalize('title')} AS title_n, {normalize('summary')} AS summary_n,
   lower(url) AS url_key,
   CASE WHEN url <> '' THEN lower({strip('url')}) ELSE {normalize('title')} END AS article_key
 FROM e1),
ent AS (SELECT *, trim(concat_ws(' ', title_n, summary_n)) AS text_n, title_n AS title_key FROM entries)"""

FLAG_EXPR = {
    "has_title_link": "(title <> '' AND url <> '')",
    "meaningful": (f"(length({strip('title')}) >= 10 AND ({strip('summary')} = '' "
                   f"OR length({strip('summary')}) >= 20))"),
    "recent": f"(published IS NULL OR published >= {AS_OF_SQL} - INTERVAL 72 HOUR)",
    "landing": f"(title_n = '' OR regexp_matches(title_n, {alternation(L.LANDING_PAGE_PATTERNS)}))",
    "evergreen": f"regexp_matches(title_n, {alternation(L.EVERGREEN_PATTERNS)})",
    "listicle": f"regexp_matches(title, '^[{WS}]*\\p{{Nd}}+[{WS}]+')",
    "analysis": f"regexp_matches(title_n, {alternation(L.ANALYSIS_PATTERNS)})",
}

ORACLE["clean_articles"] = f"""WITH {ARTICLES}, {ENTRIES}
SELECT article_id, title, summary, url, source, title_n, url_key, article_key,
  concat_ws(' ', nullif({strip('title')}, ''), nullif({strip('summary')}, '')) AS article_text,
  {normalize_text('title')} AS title_rank_form,
  {split_words(normalize_text('title'))} AS title_tokens
FROM ent"""

ORACLE["article_flags"] = f"""WITH {ARTICLES}, {ENTRIES}
SELECT article_id, {', '.join(f'{v} AS {k}' for k, v in FLAG_EXPR.items())} FROM ent"""

_topic_rows = ", ".join(f"({i}, {q(t)})" for i, t in TOPICS)
TOPICS_SQL = (f"topics AS (SELECT topic_id::BIGINT AS topic_id, topic "
              f"FROM (VALUES {_topic_rows}) v(topic_id, topic))")
ALL_TOPICS_SQL = (f"{TOPICS_SQL}, all_topics AS (SELECT topic_id::BIGINT AS topic_id, topic FROM topics "
                  "UNION ALL SELECT item_id + 1000, text FROM benchmark)")

_alias_case = " ".join(f"WHEN {q(k)} THEN {lit_list(v)}" for k, v in L.QUERY_ALIASES.items())
_alias_keys = ", ".join(q(k) for k in L.QUERY_ALIASES)


def queries_sql(src: str) -> str:
    return f"""
q0 AS (SELECT topic_id AS query_id, {strip('topic')} AS query FROM {src}),
q1 AS (SELECT query_id, query, {normalize('query')} AS qn FROM q0 WHERE query <> ''),
qs AS (SELECT query_id, query, qn,
   list_filter({split_words('qn')}, lambda t: NOT list_contains({lit_list(L.STOPWORDS)}, t)) AS terms,
   CASE qn {_alias_case} ELSE [qn] END AS aliases,
   qn IN ({_alias_keys}) AS is_entity
 FROM q1)"""


Q8_SQL = f"""(CASE WHEN qn = '' THEN false
  WHEN is_entity THEN len(list_filter(aliases, lambda a: contains(text_n, a))) > 0
  WHEN len(terms) = 0 THEN len(list_filter(aliases, lambda a: contains(text_n, a))) > 0
  WHEN contains(title_n, qn) THEN true
  ELSE len(list_filter(terms, lambda t: NOT list_contains({split_words('text_n')}, t))) = 0 END)"""

ORACLE["query_terms"] = f"""WITH {ALL_TOPICS_SQL}, {queries_sql('all_topics')}
SELECT query_id, query, qn, terms, aliases, is_entity FROM qs"""

ORACLE["query_match"] = f"""WITH {ARTICLES}, {ENTRIES}, {ALL_TOPICS_SQL}, {queries_sql('all_topics')}
SELECT qs.query_id, ent.article_id FROM ent, qs WHERE {Q8_SQL}"""

ORACLE["category_feed"] = f"""WITH {ARTICLES},
a2 AS (SELECT * REPLACE ({strip("coalesce(nullif(source, ''), 'Google News')")} AS source) FROM articles),
cat AS (SELECT category, source, dense_rank() OVER (PARTITION BY category ORDER BY source) - 1 AS source_order
        FROM (SELECT DISTINCT category, source FROM a2)),
req AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS category_pos
        FROM (SELECT DISTINCT category FROM a2)),
n1 AS (SELECT a2.*, cat.source_order, req.category_pos FROM a2
       JOIN cat ON a2.category = cat.category AND a2.source = cat.source
       JOIN req ON a2.category = req.category
       QUALIFY row_number() OVER (PARTITION BY a2.category, a2.source ORDER BY position) <= 10),
c1 AS (SELECT category, source, position, published, source_order, category_pos,
          {clean_text('raw_title')} AS title, {strip("coalesce(url, '')")} AS url,
          {clean_text('raw_summary')} AS summary FROM n1),
c2 AS (SELECT *, CASE WHEN url <> '' THEN lower({strip('url')}) ELSE {normalize('title')} END AS article_key
       FROM c1
       WHERE {FLAG_EXPR['has_title_link']} AND {FLAG_EXPR['meaningful']} AND {FLAG_EXPR['recent']})
SELECT category, source, title, url, summary, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, position
FROM c2 QUALIFY row_number() OVER (PARTITION BY article_key ORDER BY category_pos, source_order, position) = 1"""

PICKED = f"""{ARTICLES}, {ENTRIES}, {TOPICS_SQL}, {queries_sql('topics')},
f AS (SELECT * FROM ent WHERE {FLAG_EXPR['has_title_link']} AND {FLAG_EXPR['meaningful']}
        AND NOT {FLAG_EXPR['landing']} AND {FLAG_EXPR['recent']}),
m AS (SELECT qs.query_id, qs.query, f.* FROM f, qs WHERE {Q8_SQL}),
g AS (SELECT query_id, list(struct_pack(position := position, u := url_key, t := title_key,
          article_id := article_id, title := title, summary := summary, url := url, source := source,
          published := published, query := query) ORDER BY position) AS items FROM m GROUP BY query_id),
acc AS (SELECT query_id, list_reduce(items, lambda acc, x: CASE WHEN len(acc) >= {L.QUERY_LIMIT}
          OR len(list_filter(acc, lambda y: y.u = x.u OR y.t = x.t)) > 0 THEN acc
          ELSE list_append(acc, x) END, list_filter(items, lambda x: false)) AS acc FROM g),
p0 AS (SELECT query_id, unnest(acc, recursive := true) FROM acc),
picked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY published DESC NULLS LAST, position) AS rank
           FROM p0)"""

ORACLE["news_for_query"] = f"""WITH {PICKED}
SELECT query_id, rank, article_id, title, url, source,
       strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM picked"""

_sq = "[" + ", ".join(f"{{'k': {q(k)}, 'v': {d(v)}}}" for k, v in L.SOURCE_QUALITY.items()) + "]"


def freshness_sql(p: str) -> str:
    age = f"((epoch_us({AS_OF_SQL}) - epoch_us({p})) / {d(1e6)}) / {d(3600.0)}"
    return (f"(CASE WHEN {p} IS NULL THEN {d(L.FRESHNESS_DEFAULT)} "
            f"ELSE exp({d(-L.FRESHNESS_DECAY)} * greatest({d(0.0)}, {age})) END)")


def source_sql(s: str) -> str:
    n = normalize_text(s)
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {d(0.5)} ELSE coalesce("
            f"list_filter({_sq}, lambda e: e.k = {n})[1].v, "
            f"list_filter({_sq}, lambda e: starts_with({n}, e.k))[1].v, {d(0.5)}) END)")


def _hits_sql(terms, tn, xn, tw, xw):
    single = [t for t in terms if " " not in t]
    multi = [t for t in terms if " " in t]
    parts = []
    if single:
        a = lit_list(single)
        parts.append(f"len(list_filter({a}, lambda t: list_contains({tw}, t)))")
        parts.append(f"len(list_filter({a}, lambda t: list_contains({xw}, t)))")
    if multi:
        b = lit_list(multi)
        parts.append(f"len(list_filter({b}, lambda t: contains({tn}, t)))")
        parts.append(f"len(list_filter({b}, lambda t: contains({xn}, t)))")
    return "(" + " + ".join(parts) + ")"


def news_sql(title: str) -> str:
    """Newsworthiness; expects columns tn, sn (ranking-normalized title/summary)."""
    tn, xn = "tn", "(tn || ' ' || sn)"
    tw, xw = "string_split(tn, ' ')", f"string_split({xn}, ' ')"
    cur = f"least({_hits_sql(L.CURRENT_EVENT_TERMS, tn, xn, tw, xw)}, {L.CURRENT_EVENT_CAP})"
    ev = lit_list(L.EVERGREEN_TERMS)
    ever = (f"least(len(list_filter({ev}, lambda t: contains({tn}, t))) + "
            f"len(list_filter({ev}, lambda t: contains({xn}, t))), {L.EVERGREEN_CAP})")
    ana = f"least({_hits_sql(L.ANALYSIS_TERMS, tn, xn, tw, xw)}, {L.ANALYSIS_CAP})"
    nw = f"[^{WORD}]"
    qst = f"(CASE WHEN contains(coalesce({title}, ''), '?') THEN {d(L.QUESTION_PENALTY)} ELSE {d(0)} END)"
    expl = (f"(CASE WHEN regexp_matches({tn}, '^(what|how|why)(?:{nw}|$)') "
            f"THEN {d(L.EXPLAINER_PENALTY)} ELSE {d(0)} END)")
    year = (f"(CASE WHEN regexp_matches({tn}, '(?:^|{nw})(?:19|20)\\p{{Nd}}{{2}}(?:{nw}|$)') "
            f"THEN {d(L.YEAR_PENALTY)} ELSE {d(0)} END)")
    lst = (f"(CASE WHEN len(list_filter({lit_list(L.LISTICLE_PHRASES)}, lambda p: contains({tn}, p))) > 0 "
           f"THEN {d(L.LISTICLE_PENALTY)} ELSE {d(0)} END)")
    s = (f"{d(L.NEWS_BASE)} + {cur} * {d(L.CURRENT_EVENT_STEP)} - {ever} * {d(L.EVERGREEN_STEP)} "
         f"- {ana} * {d(L.ANALYSIS_STEP)} - {qst} - {expl} - {year} - {lst}")
    return f"greatest({d(0)}, least({d(1)}, {s}))"


def title_sql(query: str, title: str) -> str:
    qn, tn = normalize_text(query), normalize_text(title)
    qt, tt = split_words(qn), split_words(tn)
    nq = f"len({qt})"
    cov = f"(len(list_filter({qt}, lambda t: list_contains({tt}, t)))::DOUBLE / {nq})"
    dom = (f"(CASE WHEN {nq} = 1 THEN (CASE WHEN list_contains({tt}, {qt}[1]) THEN {d(1)} ELSE {d(0)} END) "
           f"ELSE least({d(1)}, {nq}::DOUBLE / greatest(len({tt}), 1)) END)")
    mix = f"{d(L.TITLE_COVERAGE_W)} * {cov} + {d(L.TITLE_ORDERED_W)} * {d(0)} + {d(L.TITLE_DOMINANCE_W)} * {dom}"
    return (f"(CASE WHEN {qn} = '' OR {tn} = '' OR {nq} = 0 THEN {d(0)} ELSE greatest({d(0)}, least({d(1)}, "
            f"CASE WHEN contains({tn}, {qn}) THEN {d(1)} ELSE {mix} END)) END)")


ORACLE["article_signals"] = f"""WITH {ARTICLES}, {ENTRIES},
s AS (SELECT *, {normalize_text('title')} AS tn, {normalize_text('summary')} AS sn FROM ent)
SELECT article_id, round({freshness_sql('published')}, 6) AS freshness,
       round({source_sql('source')}, 6) AS source_score,
       round({news_sql('title')}, 6) AS newsworthiness FROM s"""

ORACLE["title_relevance"] = f"""WITH {ARTICLES}, {ENTRIES}, {ALL_TOPICS_SQL}, {queries_sql('all_topics')}
SELECT qs.query_id, ent.article_id, round({title_sql('qs.query', 'ent.title')}, 6) AS title_score
FROM ent, qs WHERE {Q8_SQL}"""


def hashed_vectors(src: str, id_col: str, text_col: str, name: str, dim: int = 256) -> str:
    """Dense hashed bag-of-words vectors (id, vec DOUBLE[dim]) for rows of src."""
    toks = split_words(normalize_text(text_col))
    return f"""
{name}_t AS (SELECT {id_col} AS id, unnest({toks}) AS tok FROM {src}),
{name}_c AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim}) AS dm, count(*)::DOUBLE AS c
             FROM {name}_t GROUP BY id, dm),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {name}_c GROUP BY id),
{name}_ids AS (SELECT DISTINCT {id_col} AS id FROM {src}),
{name} AS (SELECT i.id, list(coalesce(c.c / n.nrm, {d(0)}) ORDER BY g.dm) AS vec
           FROM {name}_ids i CROSS JOIN range({dim}) g(dm)
           LEFT JOIN {name}_c c ON c.id = i.id AND c.dm = g.dm
           LEFT JOIN {name}_n n ON n.id = i.id
           GROUP BY i.id)"""


RANKED = f"""{PICKED},
arts AS (SELECT DISTINCT article_id, concat_ws(' ', nullif({strip('title')}, ''), nullif({strip('summary')}, '')) AS atext
         FROM picked),
qtexts AS (SELECT DISTINCT query_id, query FROM picked),
{hashed_vectors('arts', 'article_id', 'atext', 'av')},
{hashed_vectors('qtexts', 'query_id', 'query', 'qv')},
sc0 AS (SELECT p.*, av.vec AS vec, list_dot_product(av.vec, qv.vec) AS semantic,
          {normalize_text('p.title')} AS tn, {normalize_text('p.summary')} AS sn
        FROM picked p JOIN av ON av.id = p.article_id JOIN qv ON qv.id = p.query_id),
sc AS (SELECT *, {freshness_sql('published')} AS freshness, {source_sql('source')} AS source_score,
          {title_sql('query', 'title')} AS title_score, {news_sql('title')} AS newsworthiness FROM sc0),
scored AS (SELECT *, {d(L.WEIGHTS['semantic'])} * semantic + {d(L.WEIGHTS['freshness'])} * freshness
          + {d(L.WEIGHTS['source'])} * source_score + {d(L.WEIGHTS['title'])} * title_score
          + {d(L.WEIGHTS['newsworthiness'])} * newsworthiness AS score FROM sc)"""

ORACLE["ranked_scores"] = f"""WITH {RANKED}
SELECT query_id, rank AS input_rank, article_id, round(semantic, 6) AS semantic, round(freshness, 6) AS freshness,
  round(source_score, 6) AS source_score, round(title_score, 6) AS title_score,
  round(newsworthiness, 6) AS newsworthiness, round(score, 6) AS score FROM scored"""


def diverse_sql(threshold: float, top_k: int = 10) -> str:
    return f"""WITH {RANKED},
g2 AS (SELECT query_id, list(struct_pack(score := score, input_rank := rank, vec := vec,
          skey := {normalize_text("coalesce(source, 'unknown')")}, article_id := article_id,
          title := title, source := source) ORDER BY round(score, 12) DESC, rank) AS items
       FROM scored GROUP BY query_id),
sel AS (SELECT query_id, list_reduce(items, lambda acc, x: CASE WHEN len(acc) >= {top_k}
          OR len(list_filter(acc, lambda y: y.skey = x.skey)) >= {L.MAX_PER_SOURCE}
          OR len(list_filter(acc, lambda y: list_dot_product(y.vec, x.vec) >= {d(threshold)})) > 0
          THEN acc ELSE list_append(acc, x) END, list_filter(items, lambda x: false)) AS acc FROM g2),
o AS (SELECT query_id, unnest(generate_series(1, len(acc))) AS rank, unnest(acc) AS it FROM sel)
SELECT query_id, rank, it.article_id AS article_id, it.title AS title, it.source AS source,
       round(it.score, 6) AS score FROM o"""


ORACLE["diverse_news"] = diverse_sql(0.30)


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------

ORACLE["vector_topk"] = ORACLE["vector_topk"].replace(
    "ORDER BY sim DESC, vec_id", "ORDER BY round(sim, 12) DESC, vec_id")

_DOC_TOK = f"""
dt AS (SELECT doc_id AS id, unnest({split_words(normalize_text('text'))}) AS tok FROM documents),
dc AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 256) AS dm, count(*)::DOUBLE AS c
       FROM dt GROUP BY id, dm),
dn AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM dc GROUP BY id)"""

ORACLE["hash_embedding"] = f"""WITH {_DOC_TOK}
SELECT dc.id AS doc_id, dc.dm AS dim, round(dc.c / dn.nrm, 6) AS weight FROM dc JOIN dn USING (id)"""

ORACLE["hash_search"] = f"""WITH {hashed_vectors('documents', 'doc_id', 'text', 'dv')},
{hashed_vectors('benchmark', 'item_id', 'text', 'bv')},
s AS (SELECT bv.id AS query_id, dv.id AS doc_id, list_dot_product(dv.vec, bv.vec) AS sim FROM dv, bv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5"""

ORACLE["near_duplicate_texts"] = f"""
WITH tk AS (SELECT doc_id, list_sort({split_words(normalize_text('text'))}) AS words FROM documents),
cl AS (SELECT doc_id, words, CASE WHEN len(words) > 0 THEN min(doc_id) OVER (PARTITION BY words) ELSE doc_id END AS class_id FROM tk),
tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM cl WHERE doc_id = class_id) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), tot AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
raw AS (SELECT doc_id, tf.word, tf * ln((n + 1.0::DOUBLE) / df) AS w FROM tf JOIN df ON df.word = tf.word, tot),
nv AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
pr AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM nv a JOIN nv b ON a.word = b.word AND a.doc_id < b.doc_id
       GROUP BY a.doc_id, b.doc_id HAVING round(sum(a.w * b.w), 12) >= 0.8),
ends AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM pr UNION ALL SELECT id_b FROM pr) GROUP BY id)
SELECT cl.doc_id, cl.class_id, coalesce(ends.n, 0) AS n_links FROM cl LEFT JOIN ends ON ends.id = cl.class_id"""

CENTROIDS = """
ex AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS pos,
              unnest(embedding)::DOUBLE AS x FROM embeddings),
mm AS (SELECT label, pos, avg(x) AS m FROM ex GROUP BY label, pos),
ca AS (SELECT label, list(m ORDER BY pos) AS a FROM mm GROUP BY label),
cn AS (SELECT label, a, sqrt(list_sum(list_transform(a, lambda z: z * z))) AS nrm FROM ca),
cent AS (SELECT label::BIGINT AS query_id,
                list_transform(a, lambda z: CASE WHEN nrm = 0 THEN 0.0 ELSE z / nrm END) AS qv FROM cn)"""

ORACLE["vector_topk_batch"] = f"""WITH {CENTROIDS},
s AS (SELECT cent.query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], cent.qv) AS sim
      FROM embeddings e, cent),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5"""

ORACLE["similarity_knn"] = """
WITH s AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
                  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, neighbor_id) AS rank FROM s)
SELECT vec_id, rank, neighbor_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5"""

ORACLE["store_knn"] = ORACLE["similarity_knn"].replace("a.vec_id <> b.vec_id)", "a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)") \
    .replace("SELECT vec_id, rank,", "SELECT vec_id, rank::INTEGER AS rank,")

ORACLE["near_duplicate_pairs"] = """
SELECT a.vec_id AS id_a, b.vec_id AS id_b,
       round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"""

ORACLE["diverse_topk"] = f"""WITH {CENTROIDS},
s AS (SELECT cent.query_id, e.vec_id, e.label, e.embedding::DOUBLE[] AS v,
             list_dot_product(e.embedding::DOUBLE[], cent.qv) AS sim FROM embeddings e, cent),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s
      QUALIFY rank <= 50),
g AS (SELECT query_id, list(struct_pack(sim := sim, vec_id := vec_id, label := label, v := v,
          skey := CAST(label AS VARCHAR)) ORDER BY round(sim, 12) DESC, rank) AS items FROM r GROUP BY query_id),
sel AS (SELECT query_id, list_reduce(items, lambda acc, x: CASE WHEN len(acc) >= 10
          OR len(list_filter(acc, lambda y: y.skey = x.skey)) >= 3
          OR len(list_filter(acc, lambda y: list_dot_product(y.v, x.v) >= 0.3)) > 0
          THEN acc ELSE list_append(acc, x) END, list_filter(items, lambda x: false)) AS acc FROM g),
o AS (SELECT query_id, unnest(generate_series(1, len(acc))) AS rank, unnest(acc) AS it FROM sel)
SELECT query_id, rank, it.vec_id AS vec_id, it.label AS label, round(it.sim, 6) AS similarity FROM o"""


# ---------------------------------------------------------------------------
# Decisions, contexts, prompts
# ---------------------------------------------------------------------------

CLASSIFIER_REPLIES = [
    '{"needs_news": true, "categories": ["tech","x","tech"]}',
    'not json',
    '{"needs_news": "false", "categories": ["gaming"]}',
    '{"needs_news": true, "categories": []}',
    '[1]',
    '{}',
]
CRITIC_REPLIES = [
    '{"passed": true, "feedback": "ok"}',
    '{"passed": false, "feedback": "weak"}',
    'not json',
    '{}',
]


def pick_sql(arr, idx: str) -> str:
    return f"({lit_list(arr)})[(({idx}) % {len(arr)}) + 1]"


def truthy_sql(j: str) -> str:
    t = f"json_type({j})"
    return (f"(CASE WHEN {j} IS NULL THEN false WHEN {t} = 'NULL' THEN false "
            f"WHEN {t} = 'BOOLEAN' THEN CAST({j} AS BOOLEAN) "
            f"WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({j} AS DOUBLE) <> 0 "
            f"WHEN {t} = 'VARCHAR' THEN length(json_extract_string({j}, '$')) > 0 "
            f"WHEN {t} = 'ARRAY' THEN json_array_length({j}) > 0 "
            f"WHEN {t} = 'OBJECT' THEN len(json_keys({j})) > 0 ELSE false END)")


def ok_sql(r: str) -> str:
    return f"(CASE WHEN json_valid({r}) THEN json_type({r}) = 'OBJECT' ELSE false END)"


def classifier_cols(r: str) -> str:
    ok, nn, cats = classifier_parts(r)
    return f"{ok} AS reply_ok, {nn} AS needs_news, {cats} AS categories"


def classifier_parts(r: str) -> tuple[str, str, str]:
    cj = f"json_extract({r}, '$.categories')"
    cats0 = (f"(CASE WHEN {ok_sql(r)} AND json_type({cj}) = 'ARRAY' "
             f"THEN from_json({cj}, '[\"VARCHAR\"]') ELSE []::VARCHAR[] END)")
    cats = f"list_filter({cats0}, lambda c: list_contains({lit_list(L.ALLOWED_CATEGORIES)}, c))"
    nn = (f"(CASE WHEN len({cats}) = 0 THEN false WHEN {ok_sql(r)} "
          f"THEN {truthy_sql(f'json_extract({r}, {q(chr(36) + '.needs_news')})')} ELSE false END)")
    return ok_sql(r), nn, cats


ATTEMPTS = f"""
att0 AS (SELECT conv_id AS topic_id, text AS draft,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt
         FROM conversations WHERE role = 'assistant'),
att1 AS (SELECT *, {pick_sql(CRITIC_REPLIES, 'topic_id + attempt')} AS reply FROM att0 WHERE attempt <= 3),
att AS (SELECT topic_id, attempt, draft, {ok_sql('reply')} AS reply_ok,
          (CASE WHEN {ok_sql('reply')} THEN {truthy_sql("json_extract(reply, '$.passed')")} ELSE false END) AS passed,
          (CASE WHEN NOT json_valid(reply) THEN {q(L.INVALID_CRITIC_FEEDBACK)}
                ELSE json_extract_string(reply, '$.feedback') END) AS feedback
        FROM att1)"""

ROUTE = "(CASE WHEN passed THEN 'end' WHEN attempt >= 3 THEN 'end' ELSE 'regenerate' END)"

ORACLE["classifier_decisions"] = f"""
SELECT conv_id AS topic_id, count(*) AS turns,
       {classifier_cols(pick_sql(CLASSIFIER_REPLIES, 'conv_id'))}
FROM conversations GROUP BY conv_id"""

ORACLE["critic_decisions"] = f"""WITH {ATTEMPTS}
SELECT topic_id, attempt, reply_ok, passed, feedback, {ROUTE} AS route FROM att"""

ORACLE["attempt_resolution"] = f"""WITH {ATTEMPTS},
x AS (SELECT *, {ROUTE} AS route FROM att),
fin AS (SELECT topic_id, coalesce(min(CASE WHEN route = 'end' THEN attempt END), max(attempt)) AS attempt,
               CASE WHEN min(CASE WHEN route = 'end' THEN attempt END) IS NOT NULL THEN 'end' ELSE 'open' END AS status
        FROM x GROUP BY topic_id)
SELECT fin.topic_id, fin.attempt, fin.status, x.passed, x.feedback, x.draft
FROM fin JOIN x ON fin.topic_id = x.topic_id AND fin.attempt = x.attempt"""

RAG_HITS = f"""{CORPUS},
{hashed_vectors('corpus', 'corpus_id', 'text', 'cv')},
{hashed_vectors('benchmark', 'item_id', 'text', 'bq')},
s AS (SELECT bq.id AS query_id, cv.id AS doc_id, list_dot_product(cv.vec, bq.vec) AS sim FROM cv, bq),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM s
      QUALIFY rank <= 5),
hits AS (SELECT r.query_id, r.rank, c.source, c.subreddit, c.score, c.text
         FROM r JOIN corpus c ON c.corpus_id = r.doc_id)"""


def py_str_sql(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


_NL = "chr(10)"
ORACLE["rag_context"] = f"""WITH {RAG_HITS}
SELECT query_id, string_agg(concat({_NL}, 'Example ', rank, {_NL}, 'Source: ', {py_str_sql('source')}, {_NL},
   'Subreddit: ', {py_str_sql('subreddit')}, {_NL}, 'Score: ', {py_str_sql('score')}, {_NL}, {_NL},
   {py_str_sql('text')}, {_NL}), {_NL} ORDER BY rank) AS context
FROM hits GROUP BY query_id"""

ORACLE["plain_context"] = f"""WITH {RAG_HITS}
SELECT query_id, string_agg({py_str_sql('text')}, {_NL} || {_NL} ORDER BY rank) AS context
FROM hits GROUP BY query_id"""

_diverse_news_rows = diverse_sql(0.30).replace(
    "title := title, source := source)", "title := title, source := source, summary := summary, "
    "url := url, published := published)")
_NEWS_SELECT = """SELECT query_id, rank, it.article_id AS article_id, it.title AS title, it.source AS source,
       round(it.score, 6) AS score FROM o"""
NEWS_CONTEXT = _diverse_news_rows.replace(_NEWS_SELECT, "") + f""",
nb AS (SELECT query_id, rank, concat('News #', rank, {_NL}, 'Title: ', {py_str_sql('it.title')}, {_NL},
    'Source: ', {py_str_sql('it.source')}, {_NL}, 'Published: ',
    CASE WHEN it.published IS NULL THEN 'None' ELSE strftime(it.published, '%Y-%m-%d %H:%M:%S') || '+00:00' END,
    {_NL}, 'Summary: ', {py_str_sql('it.summary')}, {_NL}, 'URL: ', {py_str_sql('it.url')}, {_NL},
    'Relevance Score: ', printf('%.4f', it.score), {_NL}) AS b FROM o),
news_ctx AS (SELECT query_id, string_agg(b, {_NL} || {_NL} ORDER BY rank) AS news FROM nb GROUP BY query_id)"""

ORACLE["news_context"] = NEWS_CONTEXT + "\nSELECT query_id, news FROM news_ctx"

ORACLE["news_gate"] = NEWS_CONTEXT + f""",
tg AS (SELECT topic_id, {classifier_cols(pick_sql(CLASSIFIER_REPLIES, 'topic_id'))} FROM topics)
SELECT tg.topic_id, tg.needs_news,
       CASE WHEN tg.needs_news THEN coalesce(n.news, '') ELSE '' END AS news
FROM tg LEFT JOIN news_ctx n ON n.query_id = tg.topic_id"""

CLASSIFY_TEMPLATE = "Topic: {topic}\nDoes this topic need current news? Answer in JSON."
CRITIC_TEMPLATE = "Topic: {topic}\nDraft:\n{draft}\nPrevious feedback: {feedback}\nReview the draft."

ORACLE["prompt_requests"] = f"""WITH {ATTEMPTS},
first AS (SELECT conv_id AS topic_id, text AS topic FROM conversations WHERE turn = 0),
a AS (SELECT att.*, first.topic,
         lag(feedback) OVER (PARTITION BY att.topic_id ORDER BY attempt) AS prev_feedback
      FROM att JOIN first ON att.topic_id = first.topic_id)
SELECT topic_id, 0 AS attempt, 'classify' AS stage,
       replace({q(CLASSIFY_TEMPLATE)}, '{{topic}}', {py_str_sql('topic')}) AS prompt FROM first
UNION ALL
SELECT topic_id, attempt, 'critique' AS stage,
       replace(replace(replace({q(CRITIC_TEMPLATE)}, '{{topic}}', {py_str_sql('topic')}),
               '{{draft}}', {py_str_sql('draft')}), '{{feedback}}', {py_str_sql('prev_feedback')}) AS prompt
FROM a"""


# Topic rounds: the loop is unrolled over the logged replies.
def _fill_sql(template: str, values: dict[str, str]) -> str:
    import re

    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return "concat(" + ", ".join(py_str_sql(values[p]) if i % 2 else q(p) for i, p in enumerate(parts)) + ")"


ROUND_CLASSIFY = "Topic: {topic}\nDoes this topic need current news? Answer in JSON."
ROUND_GENERATE = "Topic: {topic}\nExamples:\n{context}\nNews:\n{news}\nEarlier verdict: {critique}\nWrite one post."
ROUND_CRITIQUE = "Topic: {topic}\nExamples:\n{context}\nNews:\n{news}\nDraft:\n{draft}\nAnswer in JSON."

_ROUNDS = NEWS_CONTEXT + f""",
{hashed_vectors('documents', 'doc_id', 'text', 'rdv')},
{hashed_vectors('topics', 'topic_id', 'topic', 'rtv')},
rs AS (SELECT rtv.id AS query_id, rdv.id AS doc_id, list_dot_product(rdv.vec, rtv.vec) AS sim FROM rdv, rtv),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM rs QUALIFY rank <= 5),
rctx AS (SELECT rr.query_id, string_agg(concat({_NL}, 'Example ', rank, {_NL}, 'Source: document', {_NL}, 'Subreddit: ', {py_str_sql('source')}, {_NL},
   'Score: ', {py_str_sql('n_chars')}, {_NL}, {_NL}, {py_str_sql('left(text, 500)')}, {_NL}), {_NL} ORDER BY rank) AS context
   FROM rr JOIN documents dd ON dd.doc_id = rr.doc_id GROUP BY rr.query_id),
rt AS (SELECT DISTINCT conv_id AS topic_id, {pick_sql([t for _, t in TOPICS], 'conv_id')} AS topic, {pick_sql(CLASSIFIER_REPLIES, 'conv_id')} AS creply FROM conversations),
live AS (SELECT rt.topic_id, rt.topic, creply, coalesce(c.context, '') AS context,
     CASE WHEN {classifier_parts('creply')[1]} THEN coalesce(n.news, '') ELSE '' END AS news
   FROM rt JOIN topics t ON t.topic = rt.topic LEFT JOIN rctx c ON c.query_id = t.topic_id LEFT JOIN news_ctx n ON n.query_id = t.topic_id
   WHERE {strip('rt.topic')} <> ''),
{ATTEMPTS},
stop AS (SELECT topic_id, min(CASE WHEN passed OR attempt >= 3 THEN attempt END) AS ended, max(attempt) AS logged FROM att GROUP BY topic_id),
tries AS (SELECT live.*, a.attempt, a.draft, a.passed, a.feedback, lag(a.passed) OVER w AS was, lag(a.feedback) OVER w AS said
   FROM live JOIN att a ON a.topic_id = live.topic_id WINDOW w AS (PARTITION BY a.topic_id ORDER BY a.attempt)),
kept AS (SELECT tries.*, att1.reply FROM tries JOIN att1 ON att1.topic_id = tries.topic_id AND att1.attempt = tries.attempt
   JOIN stop ON stop.topic_id = tries.topic_id WHERE tries.attempt <= coalesce(stop.ended, stop.logged)),
due AS (SELECT live.*, coalesce(stop.logged, 0) + 1 AS attempt, p.passed AS was, p.feedback AS said FROM live
   LEFT JOIN stop ON stop.topic_id = live.topic_id LEFT JOIN att p ON p.topic_id = live.topic_id AND p.attempt = stop.logged WHERE stop.ended IS NULL)"""
_CRITIQUE_JSON = "(CASE WHEN was IS NULL THEN '{}' ELSE to_json({'passed': was, 'feedback': said})::VARCHAR END)"
_GEN = _fill_sql(ROUND_GENERATE, {"topic": "topic", "context": "context", "news": "news", "critique": _CRITIQUE_JSON})

ORACLE["topic_rounds"] = _ROUNDS + f"""
SELECT topic_id, 0::BIGINT AS attempt, 'classify' AS stage, {_fill_sql(ROUND_CLASSIFY, {"topic": "topic"})} AS prompt, creply AS reply, NULL::VARCHAR AS route FROM live
UNION ALL SELECT topic_id, attempt, 'generate', {_GEN}, draft, NULL FROM kept
UNION ALL SELECT topic_id, attempt, 'generate', {_GEN}, NULL, 'wait' FROM due
UNION ALL SELECT topic_id, attempt, 'critique', {_fill_sql(ROUND_CRITIQUE, {"topic": "topic", "context": "context", "news": "news", "draft": "draft"})},
  reply, {ROUTE} FROM kept"""

ORACLE["topic_outcomes"] = _ROUNDS + f"""
SELECT topic_id, attempt, 'end' AS status, passed, feedback, draft FROM kept WHERE {ROUTE} = 'end'
UNION ALL SELECT topic_id, attempt, 'waiting', NULL, NULL, NULL FROM due
UNION ALL SELECT topic_id, 0, 'rejected', NULL, 'blank topic', NULL FROM rt WHERE {strip('topic')} = ''"""


# ---------------------------------------------------------------------------
# Dates, manifests, streaming
# ---------------------------------------------------------------------------

_RAW_TIMES = """
ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
rt AS (SELECT event_id, CASE event_id % 4
   WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
   WHEN 1 THEN strftime(ts + INTERVAL 330 MINUTE, '%a, %d %b %Y %H:%M:%S') || ' +0530'
   WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
   ELSE strftime(ts, '%d %b %Y %H:%M:%S') END AS raw FROM ev)"""

ORACLE["parse_dates"] = f"""WITH {_RAW_TIMES},
p AS (SELECT event_id, raw, regexp_replace(trim(raw), '^[A-Za-z]{{3}},[{WS}]*', '') AS s FROM rt)
SELECT event_id, raw, strftime(coalesce(
    CAST(try_strptime(s, '%d %b %Y %H:%M:%S %z') AS TIMESTAMP),
    try_strptime(s, '%d %b %Y %H:%M:%S GMT'),
    try_strptime(trim(raw), '%Y-%m-%dT%H:%M:%SZ'),
    try_strptime(s, '%d %b %Y %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS published
FROM p"""

ORACLE["search_manifest"] = f"""WITH {ALL_TOPICS_SQL}, {queries_sql('all_topics')}
SELECT query_id, {q(L.SEARCH_URL_PREFIX)} || replace(url_encode(query), '%20', '+')
       || {q(L.SEARCH_URL_SUFFIX)} AS request_url FROM qs"""

ORACLE["stream_feed_keys"] = f"""WITH {ARTICLES}, {ENTRIES}
SELECT DISTINCT article_key FROM ent
WHERE {FLAG_EXPR['has_title_link']} AND {FLAG_EXPR['meaningful']} AND NOT {FLAG_EXPR['landing']}
  AND {FLAG_EXPR['recent']}"""

ORACLE["stream_source_counts"] = f"""WITH {ARTICLES},
a AS (SELECT {strip("coalesce(nullif(source, ''), 'Google News')")} AS source,
      coalesce(published, TIMESTAMP '2025-01-01 00:00:00') AS published FROM articles),
w AS (SELECT source, time_bucket(INTERVAL 24 HOUR, published) - to_hours(24 * i) AS ws
      FROM a, (SELECT unnest([0, 1, 2]) AS i) k)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 72 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, source, count(*) AS n
FROM w GROUP BY ws, source"""


ORACLE["stream_closed_counts"] = ORACLE["stream_source_counts"].replace(
    "FROM w GROUP BY ws, source", "FROM w WHERE ws + INTERVAL 72 HOUR <= (SELECT max(published) - INTERVAL 24 HOUR FROM a) GROUP BY ws, source")


# ---------------------------------------------------------------------------
# Round trips and reports
# ---------------------------------------------------------------------------

ORACLE["csv_roundtrip_curation"] = ORACLE["curate_comments"]

ORACLE["vector_store_search"] = """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v,
                  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))) AS nrm FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda z: CASE WHEN nrm = 0 THEN 0.0 ELSE z / nrm END)::FLOAT[]::DOUBLE[] AS v
      FROM n),
ux AS (SELECT unnest(generate_series(0, len(v) - 1)) AS pos, unnest(v) AS x FROM u),
um AS (SELECT pos, avg(x) AS m FROM ux GROUP BY pos),
ua AS (SELECT list(m ORDER BY pos) AS a FROM um),
un AS (SELECT a, sqrt(list_sum(list_transform(a, lambda z: z * z))) AS nrm FROM ua),
q AS (SELECT 0::BIGINT AS query_id,
             list_transform(a, lambda z: CASE WHEN nrm = 0 THEN 0.0 ELSE z / nrm END) AS qv FROM un),
s AS (SELECT q.query_id, u.vec_id, list_dot_product(u.v, q.qv) AS sim FROM u, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 10"""

ORACLE["vectors_report"] = """
WITH n AS (SELECT embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))) AS nrm
           FROM embeddings)
SELECT count(*) AS ntotal, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
       round(min(nrm), 4) AS min_norm, round(max(nrm), 4) AS max_norm, 'float' AS dtype FROM n"""

ORACLE["curation_report"] = f"""
WITH c AS ({COMMENTS}),
f AS (SELECT body, body IS NOT NULL AS nn,
             body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]') AS nt, {strip('body')} AS s FROM c),
a AS (SELECT count(*) AS c0, count(CASE WHEN nn THEN 1 END) AS c1, count(CASE WHEN nt THEN 1 END) AS c2,
             count(CASE WHEN nt AND length(s) >= 20 THEN 1 END) AS c3,
             count(DISTINCT CASE WHEN nt AND length(s) >= 20 THEN s END) AS c4 FROM f)
SELECT * FROM (VALUES (0, 'raw'), (1, 'non_null'), (2, 'no_tombstone'), (3, 'min_length'), (4, 'deduplicated'))
  v(stage_no, stage)
CROSS JOIN LATERAL (SELECT [c0, c1, c2, c3, c4][stage_no + 1] AS n_rows FROM a)"""

ORACLE["head_rows"] = (f"WITH {CURATED_COMMENTS} SELECT doc_id, subreddit, body, score FROM curated_comments "
                       "ORDER BY doc_id LIMIT 5")

ORACLE["feed_files_roundtrip"] = f"""WITH {ARTICLES}, {ENTRIES}
SELECT article_id, title, summary, source, article_key,
       strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM ent"""

ORACLE["corpus_metadata"] = f"""WITH {CORPUS}
SELECT c.corpus_id, c.source, c.subreddit, c.score, l.quality, l.toxic = 1 AS nsfw
FROM corpus c LEFT JOIN labels l ON l.doc_id = (c.corpus_id & ((1::BIGINT << 48) - 1))"""

ORACLE["source_capped"] = f"""WITH {RANKED}
SELECT query_id, rank AS input_rank, article_id, source, round(score, 6) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id, {normalize_text("coalesce(source, 'unknown')")}
                           ORDER BY round(score, 12) DESC, rank) <= {L.MAX_PER_SOURCE}"""

ORACLE["metadata_json_roundtrip"] = ORACLE["corpus_metadata"]

ORACLE["corpus_metadata_files"] = f"""WITH {CURATED_COMMENTS}, {CURATED_JOKES}
SELECT c.doc_id AS corpus_id, c.body AS text, 'reddit_comment' AS source, c.subreddit, c.score::BIGINT AS score,
       CASE WHEN l.quality = 0 THEN 1 ELSE 0 END::INTEGER AS controversiality, NULL::BOOLEAN AS nsfw, NULL::BIGINT AS created_utc
FROM curated_comments c LEFT JOIN labels l ON l.doc_id = c.doc_id
UNION ALL
SELECT (1::BIGINT << 48) | j.doc_id, j.text, 'reddit_joke', j.subreddit, j.score::BIGINT, NULL,
       coalesce(l.toxic = 1, false), coalesce(floor(epoch(e.ts))::BIGINT, 0)
FROM curated_jokes j LEFT JOIN labels l ON l.doc_id = j.doc_id LEFT JOIN events e ON e.event_id = j.doc_id"""

ORACLE["near_duplicate_dedupe"] = """
WITH items AS (SELECT list(struct_pack(vec_id := vec_id, v := embedding::DOUBLE[]) ORDER BY vec_id) AS it
               FROM embeddings WHERE embedding IS NOT NULL),
sel AS (SELECT list_reduce(it, lambda acc, x: CASE
          WHEN len(list_filter(acc, lambda y: list_dot_product(y.v, x.v) >= 0.3)) > 0 THEN acc
          ELSE list_append(acc, x) END, list_filter(it, lambda x: false)) AS acc FROM items)
SELECT unnest(acc).vec_id AS vec_id FROM sel"""

_ev_ok, _ev_nn, _ = classifier_parts("props")
ORACLE["event_props_decisions"] = f"""
SELECT event_id, {_ev_ok} AS reply_ok, {_ev_nn} AS needs_news,
       CASE WHEN json_valid(props) THEN {truthy_sql("json_extract(props, '$.k')")} ELSE false END AS k_truthy
FROM events"""

_FEEDS = [(c, s, i, j) for i, c in enumerate(sorted(L.FEED_CATALOGUE)) for j, (s, _) in enumerate(L.FEED_CATALOGUE[c])]
_LANDED = [(c, s) for c, f in L.FEED_CATALOGUE.items() for s, _ in f] + [("tech", "Unknown Blog"), ("weather", "BBC News")]
_INTAKE = f"""WITH {ARTICLES}, {ENTRIES},
fd AS (SELECT * FROM (VALUES {", ".join(f"({q(c)}, {q(s)}, {i}, {j})" for c, s, i, j in _FEEDS)}) v(category, source, category_order, source_order)),
ld AS (SELECT ent.* EXCLUDE (source, category), {pick_sql([c for c, _ in _LANDED], 'article_id')} AS category, {pick_sql([s for _, s in _LANDED], 'article_id')} AS source FROM ent),
jd AS (SELECT ld.*, category_order, source_order, CASE WHEN source_order IS NULL THEN 'unknown feed' WHEN NOT {FLAG_EXPR['has_title_link']} THEN 'no title or link'
   WHEN NOT {FLAG_EXPR['meaningful']} THEN 'too short' WHEN NOT {FLAG_EXPR['recent']} THEN 'too old' END AS r0
  FROM ld LEFT JOIN fd ON fd.category = ld.category AND fd.source = ld.source),
rk AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY article_key, r0 IS NULL ORDER BY category_order, source_order, article_id) > 1
   THEN 'duplicate' ELSE r0 END AS reason FROM jd)"""

ORACLE["intake_accepted"] = _INTAKE + """
SELECT article_id, category, source, title, summary, article_key, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM rk WHERE reason IS NULL"""

ORACLE["intake_rejected"] = _INTAKE + """
SELECT article_id, category, lower(regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g')) AS feed, reason FROM rk WHERE reason IS NOT NULL"""
