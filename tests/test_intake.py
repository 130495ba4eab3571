"""Landed feeds: one pass, two sinks, batch after batch."""

import os
import time

from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.sources import feeds as FD
from tessera.sources import intake as IN

AS_OF = "2025-01-01 00:00:00"
FEEDS = [("tech", "Ars One", "u", 0), ("tech", "Verge Two", "u", 1), ("world", "BBC News", "u", 0)]


def item(guid, title, link, date="Wed, 01 Jan 2025 00:00:00 GMT", summary="a summary of some length here"):
    return (f"<item><guid>{guid}</guid><title>{title}</title><link>{link}</link><description>{summary}</description>"
            f"<pubDate>{date}</pubDate><extra><deep>x</deep></extra></item>")


def land(root, category, feed, name, *items, raw=None):
    d = os.path.join(root, f"category={category}", f"feed={feed}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write(raw if raw is not None else "<rss><channel>" + "".join(items) + "</channel></rss>")
    time.sleep(0.05)


def catalogue(spark):
    return spark.createDataFrame(FEEDS, "category string, source string, url string, source_order int")


def both(spark, out):
    ok = {r.guid: (r.category, r.source, r.batch) for r in IN.read(spark, out, "accepted").collect()}
    no = sorted((r.guid or "", r.reason, r.batch) for r in IN.read(spark, out, "rejected").collect())
    return ok, no


def test_intake_batches_reasons_and_first_accepted(spark, tmp_path):
    landed, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    land(landed, "tech", "ars-one", "1.xml", item(1, "A long enough title", "http://x/1"), item(2, "short", "http://x/2"),
         item(3, "Another long enough title", "http://x/3", "Wed, 25 Dec 2024 00:00:00 GMT"), item(4, "", "http://x/4"))
    land(landed, "tech", "verge-two", "1.xml", item(5, "The same link as the first", "HTTP://X/1"), item(6, "A title of its own here", "http://x/6"))
    land(landed, "world", "bbc-news", "1.xml", item(7, "A world title of its own", "http://x/6"), item(8, "One more world title", "http://x/8"))
    land(landed, "world", "nobody", "1.xml", item(9, "A feed that is not known", "http://x/9"))
    land(landed, "weather", "bbc-news", "1.xml", item(10, "A category that is not known", "http://x/10"))
    IN.run(spark, landed, out, catalogue(spark), AS_OF)
    ok, no = both(spark, out)
    assert ok == {"1": ("tech", "Ars One", 0), "6": ("tech", "Verge Two", 0), "8": ("world", "BBC News", 0)}
    assert no == [("10", "unknown feed", 0), ("2", "too short", 0), ("3", "too old", 0), ("4", "no title or link", 0),
                  ("5", "duplicate", 0), ("7", "duplicate", 0), ("9", "unknown feed", 0)]
    # later files: earlier keys are known, new ones are taken in; what was read is not read again
    land(landed, "tech", "ars-one", "2.xml", item(11, "A later copy of the world title", "http://x/8"), item(12, "A new title of good length", "http://x/12"))
    IN.run(spark, landed, out, catalogue(spark), AS_OF)
    ok2, no2 = both(spark, out)
    assert ok2 == ok | {"12": ("tech", "Ars One", 1)} and no2 == sorted([*no, ("11", "duplicate", 1)])
    IN.run(spark, landed, out, catalogue(spark), AS_OF)
    assert both(spark, out) == (ok2, no2)


def test_broken_file_rejects_its_own_rows_only(spark, tmp_path):
    landed, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    land(landed, "tech", "ars-one", "1.xml", item(1, "A long enough title", "http://x/1"))
    land(landed, "tech", "verge-two", "1.xml", raw="<rss><channel><item><guid>2</guid><title>never closed</ti</item></channel></rss>")
    IN.run(spark, landed, out, catalogue(spark), AS_OF)
    ok, no = both(spark, out)
    assert set(ok) == {"1"} and [r[1] for r in no] == ["malformed"]
    rows = IN.first_accepted(IN.judged(IN.read_landed(spark, landed), IN.known_feeds(catalogue(spark)), AS_OF))
    report = {r.feed: (r.rows, r.accepted, r.malformed) for r in IN.source_report(rows).collect()}
    assert report == {"ars-one": (1, 1, 0), "verge-two": (1, 0, 1)}


def test_head_of_a_feed_and_batches_of_one_file(spark, tmp_path):
    landed, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    for n in range(3):
        land(landed, "tech", "ars-one", f"{n}.xml", *[item(10 * n + i, f"A long enough title {n} {i}", f"http://x/{n}/{i}") for i in range(4)])
    IN.run(spark, landed, out, catalogue(spark), AS_OF, limit_per_source=2, max_files=1)
    ok, no = both(spark, out)
    assert sorted(ok) == ["0", "1", "10", "11", "20", "21"] and sorted(v[2] for v in ok.values()) == [0, 0, 1, 1, 2, 2]
    assert {r[1] for r in no} == {"beyond the head of its feed"} and len(no) == 6


def test_registered_sides_add_up(spark):
    from tessera.plans import catalog

    sf = "/root/testdata/sf0.001"
    ok, no = (catalog.QUERIES[f"intake_{k}"](spark, sf).select("article_id").collect() for k in ("accepted", "rejected"))
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert len(ok) + len(no) == n and len({r[0] for r in ok} | {r[0] for r in no}) == n and ok and no


def test_catalogue_has_one_reader(spark):
    feeds = IN.known_feeds(FD.catalogue(spark))
    assert feeds.count() == feeds.select("category", "feed").distinct().count() == 16


def test_published_forms(spark):
    rows = [("Mon, 06 Jan 2025 10:00:00 GMT", "2025-01-06 10:00:00"), ("6 jan 25 9:05 +0530", "2025-01-06 03:35:00"), ("06 JAN 2025 10:00 EST", "2025-01-06 15:00:00"),
            ("Tue,07 Jan 2025 00:30:00 -0800", "2025-01-07 08:30:00"), ("2025-01-06T10:00:00+02:00", "2025-01-06 08:00:00"), ("2025-01-06", "2025-01-06 00:00:00"),
            ("31 Feb 2025 10:00:00 GMT", None), ("06 Foo 2025 10:00:00 GMT", None), ("06 Jan 2025 25:00:00", None), ("", None), (None, None), ("a|b|c|d|e|f|g", None),
            ("06 Jan 2025 10:00:00 CET", "2025-01-06 09:00:00"), ("06 Jan 2025 10:00:00 XYZW", None), ("06 Jan 2025 10:00:61 GMT", None), ("06 Jan 2025 10:00:00 +05:30", "2025-01-06 04:30:00")]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<raw: string, want: string>")
    got = df.select("i", F.date_format(D.parse_published(F.col("r.raw")), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [w for _, w in rows]
