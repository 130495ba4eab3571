"""Text embedding (V1-V3) with a pluggable encoder.

The built-in encoder is a hashed bag of words run like any model encoder:
an iterator Arrow UDF tokenizes with the ranking normalizer, maps each token
to ``md5(token)[0:8] mod D`` (short frequent tokens are memoized) and returns
the L2-normalized count vector (``numpy.bincount``).  A batch is encoded in
slices of texts and its vectors are built as flat Arrow arrays, so a worker's
memory follows the batch as it came, not its vectors or tokens.  Any other encoder — e.g. a
sentence-embedding model loaded once per Python worker — plugs in through
``encoder_udf``: it receives a batch of texts and returns one vector each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULT_DIM = 256


# Ranking normalizer, as Python's re sees it (the definition the JVM and SQL
# forms mirror): lower; [^\w\s'-] -> ' '; split on whitespace.
_NON_TOKEN = re.compile(r"[^\w\s'-]")


#: Tokens that a task remembers, and the code points of the longest.
CACHE_TOKENS, CACHE_LENGTH = 50_000, 32
#: Bytes of text and texts that a task holds as Python objects at a time.
SLICE_BYTES, SLICE_TEXTS = 1_000_000, 1_000


def _dims_of(text: str, dim: int, cache: dict) -> np.ndarray:
    toks = _NON_TOKEN.sub(" ", text.lower()).split()
    out = np.empty(len(toks), dtype=np.int64)
    for i, t in enumerate(toks):
        d = cache.get(t)
        if d is None:
            d = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dim
            if len(cache) < CACHE_TOKENS and len(t) <= CACHE_LENGTH:
                cache[t] = d
        out[i] = d
    return out


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of at most ``SLICE_TEXTS`` and about ``SLICE_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right"))
        stop = min(max(full, start + 1), start + SLICE_TEXTS)
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def _vectors(texts: list[str | None], dim: int, cache: dict) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(positions, weights) of each text's unit vector, None of a null."""
    for t in texts:
        if t is None:
            yield None
            continue
        v = np.bincount(_dims_of(t, dim, cache), minlength=dim).astype(np.float64)
        nz = np.nonzero(v)[0]
        n = np.sqrt((v * v).sum())
        yield nz, v[nz] / n if n > 0 else v[nz]


def _lists(sizes: list[int | None], values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``values`` cut by ``sizes``; None is a null list."""
    ends = np.cumsum([0, *[n or 0 for n in sizes]])
    offsets = pa.array(ends, pa.int32(), mask=np.array([n is None for n in sizes] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _hashed_udf(dim: int, dtype: str):
    kind = pa.float64() if dtype == "double" else pa.float32()

    @F.arrow_udf(f"array<{dtype}>")
    def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in batches:
            for texts in _slices(batch):
                flat, sizes = np.zeros((len(texts), dim), kind.to_pandas_dtype()), []
                for row in _vectors(texts, dim, cache):
                    if row is not None:
                        flat[len(sizes), row[0]] = row[1]
                    sizes.append(dim if row is not None else None)
                yield _lists(sizes, flat[[n is not None for n in sizes]].ravel(), kind)
    return enc


def _hashed_sparse_udf(dim: int):
    @F.arrow_udf("struct<dims:array<int>, weights:array<double>>")
    def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in batches:
            for texts in _slices(batch):
                rows = list(_vectors(texts, dim, cache))
                sizes = [None if r is None else len(r[0]) for r in rows]
                some = [r for r in rows if r is not None]
                join = lambda k, t: np.concatenate([np.zeros(0, t), *[r[k] for r in some]])  # noqa: B023, E731
                yield pa.StructArray.from_arrays([_lists(sizes, join(0, np.int64), pa.int32()), _lists(sizes, join(1, np.float64), pa.float64())],
                                                 names=["dims", "weights"])
    return enc


def hashed_sparse(text, dim: int = DEFAULT_DIM) -> Column:
    """The same vector as ``hashed_embedding`` in sparse form:
    struct(dims ascending, weights) of the non-zero entries."""
    c = F.col(text) if isinstance(text, str) else text
    return _hashed_sparse_udf(dim)(c)


def hashed_embedding(text, dim: int = DEFAULT_DIM, dtype: str = "double") -> Column:
    """L2-normalized hashed bag-of-words vector of a text column (V1 + V2):
    token -> int(md5(token)[0:8], 16) mod dim, counted, L2-normalized."""
    c = F.col(text) if isinstance(text, str) else text
    return _hashed_udf(dim, dtype)(c)


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]],
                dtype: str = "float", batch_size: int = 32):
    """Wrap a model loader as an iterator pandas UDF (model loaded once per
    worker process, texts encoded in batches of ``batch_size``).  Vectors are
    L2-normalized."""
    np_t = np.float64 if dtype == "double" else np.float32

    @F.pandas_udf(f"array<{dtype}>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts = s.fillna("").tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                m = np.asarray(model(texts[i:i + batch_size]), dtype=np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                n[n == 0] = 1.0
                vecs.extend((m / n).astype(np_t))
            yield pd.Series(vecs)
    return enc


# ---------------------------------------------------------------------------
# Encode once
# ---------------------------------------------------------------------------

TEXT_KEY = "text_key"


def text_key(text) -> Column:
    """128 bits that stand for a text in the vector table."""
    c = F.col(text) if isinstance(text, str) else text
    return F.md5(c.cast("binary"))


class VectorTable:
    """Vectors by text (V1, V3, V10): a parquet table (text_key, vec) below
    ``path``.  ``fill`` encodes the distinct texts that the table does not
    hold yet and appends them; ``attach`` joins vectors to rows.  A text is
    encoded once, however many rows, queries or jobs mention it."""

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[str], Column] = hashed_embedding, vec_type: str = "array<double>"):
        self.spark, self.path, self.encoder, self.schema = spark, path, encoder, f"{TEXT_KEY} string, vec {vec_type}"
        # makes the folder, so that the first anti-join has something to read
        spark.createDataFrame([], self.schema).write.mode("append").parquet(path)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def fill(self, *texts: DataFrame) -> VectorTable:
        """Encode what is new in the first columns of ``texts``; null texts have no vector."""
        for t in texts:
            rows = t.select(F.col(t.columns[0]).alias("text")).where("text is not null").withColumn(TEXT_KEY, text_key("text"))
            # one row a text before the anti-join; hot texts are combined in the tasks
            new = rows.groupBy(TEXT_KEY).agg(F.first("text").alias("text")).join(self.vectors().select(TEXT_KEY), TEXT_KEY, "left_anti")
            new.select(TEXT_KEY, self.encoder("text").alias("vec")).write.mode("append").parquet(self.path)
        return self

    def attach(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        """``df`` with ``out``, the vector of column ``text`` (null where there is none)."""
        found = self.vectors().select(F.col(TEXT_KEY).alias("_text_key"), F.col("vec").alias(out))
        return df.withColumn("_text_key", text_key(text)).join(found, "_text_key", "left").drop("_text_key")
