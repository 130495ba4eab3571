"""Session helpers: a configured SparkSession and a cluster-safe checkpoint dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library assumes.  UTC keeps timestamp arithmetic
# identical to the naive-as-UTC convention of the feeds.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset on a local master (tests) do we create a
    scratch one; on any other master that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that
    functions pickled by reference can be imported wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera")
    sc.addPyFile(shutil.make_archive(archive, "zip", root, "tessera"))
    sc._tessera_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder."""
    import uuid

    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "table", compression: str | None = None):
    """Cut lineage by writing ``df`` once as a parquet table under the
    session's checkpoint folder (shared storage on a cluster) and reading it
    back.  Unlike ``Dataset.checkpoint()``, the input is computed once (no
    count pass followed by a second pass for the write); a lost executor
    re-reads files instead of recomputing lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.parquet(path)
