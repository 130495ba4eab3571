"""Hand rows with the awkward cases that every operator must define."""

from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
NOISE = "a" * 9_000
PASSAGE = " ".join(f"shared{i}" for i in range(70))

ROWS = [
    (1, None, "en", None, None), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3), (4, "one two", "en", "s", 7),
    (5, LONG, "en", "hot", len(LONG)), (6, LONG, "de", "hot", len(LONG)), (7, NOISE, "en", "hot", 9000),
    (8, f"alpha beta {PASSAGE} gamma", "en", "hot", 1), (9, f"delta {PASSAGE} epsilon zeta", "en", "hot", 1),
    (10, "É Ünï 中文 <|endoftext|> the end x <|im_end|>", "fr", "s", 1),
    (11, "line one\n\nline two\nline three\nline four", "en", "s", 1), (12, "x\nline one\nline two\n line three\nline four", "en", "s", 1),
    (4, "one two", "en", "s", 7), (None, "one two", "en", "s", 7), (13, "one two", "en", "s", 7),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, clash=()):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf=SF001):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def against_sql(spark, query, sql, sf=SF001, tables=("documents", "benchmark", "conversations", "pages", "labels")):
    """Rows of a query and of its DuckDB statement, sorted."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)
    return sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr), want


BLANKS = " \t\n\x0b\x0c\r"


def plain_kept_lines(docs):
    """Text of every document without the later occurrences of its three-line windows, and how many lines went."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
        gone = set()
        for k in range(len(at) - 2):
            window = tuple(lines[i].strip(BLANKS) for i in at[k:k + 3])
            gone |= set(at[k:k + 3]) if window in seen else set()
            seen.add(window)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc] = ("" if gone and not kept.strip(BLANKS) else kept, len(gone))
    return out
