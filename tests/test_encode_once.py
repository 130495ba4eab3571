"""The vector table: every distinct text is encoded once."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.operators import embed as EM
from tessera.sources import tables as T


def counting(folder):
    """An encoder that writes each text it is given to a file of its own batch."""
    def load():
        def encode(texts):
            import os
            import uuid

            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\x00".join(texts))
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])
        return encode
    return lambda c: EM.encoder_udf(load, "double")(c)


def seen(folder):
    out = []
    for f in glob.glob(f"{folder}/*"):
        with open(f) as h:
            out += h.read().split("\x00")
    return sorted(out)


def test_each_text_is_encoded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = EM.VectorTable(spark, f"{tmp_path}/v", counting(str(calls)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "banana", "a", "", None, "a", "kiwi"])], "id long, text string").repartition(4)
    table.fill(rows.select("text"), rows.select(F.col("text").alias("again")))
    assert seen(calls) == ["", "a", "banana", "kiwi"]
    # a later job, and another object on the same folder, add only what is new
    EM.VectorTable(spark, f"{tmp_path}/v", counting(str(calls))).fill(spark.createDataFrame([("kiwi",), ("plum",)], "x string"))
    assert seen(calls) == ["", "a", "banana", "kiwi", "plum"]
    got = {r.id: r.vec for r in table.attach(rows, "text").collect()}
    assert len(got) == 7 and got[4] is None and got[0] == got[2] == got[5]
    assert np.allclose(got[1], np.array([6, 4]) / np.hypot(6, 4))
    assert sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/v/*.parquet")) == 5


def test_ranking_encodes_each_text_once(spark, tmp_path, monkeypatch):
    from tessera.plans import news as NW

    calls = tmp_path / "calls"
    calls.mkdir()
    sf = "/root/testdata/sf0.01"
    out = NW.ranked(T.articles(spark, sf), T.topics(spark), T.AS_OF, embedding=counting(str(calls)))
    rows = out.select("query", "article_text").collect()
    want = {r.query for r in rows} | {r.article_text for r in rows}
    assert seen(calls) == sorted(want) and len(rows) > len({r.article_text for r in rows})
