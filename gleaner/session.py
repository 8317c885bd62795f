"""SparkSession helpers.

The library never hard-codes cluster settings. ``get_session`` only fills in defaults that are unset,
so a cluster's own ``spark-defaults.conf`` wins. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session; only when it is unset (local runs, tests) does it fall back to a fresh scratch folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # of equal keys the last one counts, as in JavaScript
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "gleaner", master: str | None = None, shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``), or the one that the SparkContext
    was given.

    Only a local session that has neither (local runs, tests) gets a fresh folder of its own, remembered per
    application; on a cluster a missing setting is an error, as executors don't share a machine's folders.
    ``spark.checkpoint.dir`` itself cannot be changed on a running session, so it is left alone and the
    SparkContext's checkpoint folder is set instead."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        d = _LOCAL_DIRS.get(app)
        if d is None:
            d = tempfile.mkdtemp(prefix="gleaner-ckpt-")
            _LOCAL_DIRS[app] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage in one pass (``Dataset.checkpoint`` computes its input twice unless cached) and survives
    executor loss, since the files live in the cluster's shared folder."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: What streams on ``transformWithState`` need. They have no timers, so batches without data would do nothing, and under
#: a state TTL they would follow each other without end.
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def start_stateful(stream, out: str, checkpoint: str, available_now: bool = True):
    """Start a stream on ``transformWithState`` into Parquet files at ``out``; returns the StreamingQuery. It takes its
    settings (``STATEFUL``) from the session as it starts; the session's own are put back."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATEFUL}
    for k, v in STATEFUL.items():
        conf.set(k, v)
    try:
        w = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint))
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
