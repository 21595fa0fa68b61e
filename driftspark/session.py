"""Session defaults and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins and partition counts at run time; the raised object-hash
# threshold keeps sketch aggregation hashed when a task sees many small groups.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # The keys that the ingest stream has seen outgrow the heap in time.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def get_spark(app: str = "driftspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftspark-"))
    return os.path.dirname(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there afterwards.

    Used for small per-key tables that steer a later pass over the big input, so
    that the big input is not scanned again for them, even after executor loss.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
