"""Quality rules: a threshold table compiled into one Spark projection.

``FEATURES`` computes per-document counts and ratios with built-in functions
only.  ``RULES`` is the threshold table: (rule, feature, comparison, bound,
fewest words the rule looks at).  ``evaluate`` compiles both into one
projection: no shuffle, no user function, each text is read once.

Defined results: a null text has no words and fails; an empty text likewise.
Repeated rows are judged one by one.  Extra columns pass through; a column
that has the name of an output is replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, words

# FIXED VALUES: frequent function words of English, German, French, Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by",
    "on", "not", "he", "his", "but", "at", "are", "this", "have", "from", "or", "an", "they", "which",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
    "dem", "nicht", "ein", "eine", "als", "auch", "es", "er", "sie",
    "de", "la", "le", "et", "les", "du", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur",
    "au", "ce", "il", "ne", "se", "pas", "plus",
    "el", "los", "las", "y", "del", "por", "con", "una", "su", "para", "al", "lo", "como", "más", "no", "si",
]

SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

#: (rule, feature, comparison, bound, fewest words)
RULES = [
    ("too_short", "n_words", ">=", 10, 0),
    ("repeated_windows", "repeat_ratio", "<=", 0.20, 0),
    ("word_length_low", "mean_word_chars", ">=", 2.0, 0),
    ("word_length_high", "mean_word_chars", "<=", 12.0, 0),
    ("symbols", "symbol_ratio", "<=", 0.10, 0),
    ("shouting", "exclaim_ratio", "<=", 0.30, 0),
    ("stop_words", "stop_ratio", ">=", 0.02, 40),
    ("duplicate_lines", "dup_line_ratio", "<=", 0.50, 0),
    ("bullet_lines", "bullet_line_ratio", "<=", 0.90, 0),
    ("ellipsis_lines", "ellipsis_line_ratio", "<=", 0.30, 0),
]


def _repeated_words(w: Column) -> Column:
    """Words inside five-word windows that the text holds twice or more.
    Windows are compared by 64-bit hashes of their word hashes."""
    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return bind(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def over(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bind(pairs, repeated))

    def windows(h: Column) -> Column:
        heads = F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1))
        return bind(F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])), over)

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(
        bind(F.transform(w, lambda x: F.xxhash64(x)), windows))


def _counts(text: Column) -> Column:
    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            # one more piece than separators: splitting beats translating char by char
            (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
            (F.size(F.split(text, "!")) - 1).cast("long").alias("n_exclaims"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "–"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return bind(words(text), lambda w: bind(lines, lambda x: of(w, x)))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "exclaim_ratio": ("n_exclaims", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_bullet_lines",
          "n_ellipsis_lines", "n_stop_words", "n_repeat_words"]


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one expression: the array of failed rules."""
    def failed(name, feature, comparison, bound, least):
        value = F.col(feature)
        good = {">=": value >= bound, "<=": value <= bound, ">": value > bound, "<": value < bound}[comparison]
        return F.when((F.col("n_words") >= least) & ~good, F.lit(name))

    return F.array_compact(F.array(*[failed(*r) for r in rules]))


def evaluate(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, the ratios, ``failed_rules`` and ``kept``."""
    new = {*COUNTS, *RATIOS, "failed_rules", "kept", "base_failed", "_q", "_once"}
    carried = [c for c in docs.columns if c not in new]
    # a filter on the verdict is not pushed below a partition number, so the counts are taken once
    out = docs.select(*carried, _counts(F.coalesce(F.col(text), F.lit(""))).alias("_q"), F.spark_partition_id().alias("_once"))
    out = out.select(*carried, "_q.*", "_once")
    out = out.select("*", *[_ratio(*v).alias(k) for k, v in RATIOS.items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.select("*", base.alias("base_failed"), compile_rules(rules).alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.col("_once") >= 0)).drop("_once")


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    from .common import table

    return evaluate(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL_FEATURES = rf"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {{docs}}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM src),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT rid, i, list_slice(w, i, i + 4) AS win FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM k) WHERE c > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
f AS (SELECT doc_id, w.rid, text, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•–]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipsis_lines,
  len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.rid = c.rid),
q AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f),
verdicts AS (SELECT *, NOT base_failed
  AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words AND 10 * n_exclaims <= 3 * n_words
  AND (n_words < 40 OR 100 * n_stop_words >= 2 * n_words) AND 10 * n_dup_lines <= 5 * n_lines
  AND 10 * n_bullet_lines <= 9 * n_lines AND 10 * n_ellipsis_lines <= 3 * n_lines AS kept FROM q)
"""

ORACLE = {
    "op6_quality_rules": SQL_FEATURES.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"""}
QUERIES = {"op6_quality_rules": op6_quality_rules}
