"""Choosing bundles and snapshots: first wins, latest wins, already used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.functions.names import FILE_TYPES, REFERENCE, landing_part
from driftspark.operators.joins import missing_from, sized_join
from driftspark.session import cut

BUNDLE_KEYS = ["sensor_id", "timestamp", "file_type"]
SNAPSHOT_KEYS = ["sensor_id", "timestamp"]


def is_accepted(uploads: DataFrame) -> Column:
    """A known kind, in an archive that is named after it."""
    known = F.col("file_type").isin(*FILE_TYPES)
    if "path" in uploads.columns:
        known = known & (landing_part(F.col("path"), "stem") == F.col("file_type"))
    return F.coalesce(known, F.lit(False))


def valid_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.filter(is_accepted(uploads))


def rejected_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.filter(~is_accepted(uploads))


def _top_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key; the planner keeps one row per key and task before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_of_batch(uploads: DataFrame) -> DataFrame:
    """One upload per key, the earliest."""
    return _top_row(uploads, BUNDLE_KEYS, [F.col("modificationTime"), F.col("path")])


def register_bundles(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """Bundles to append to the catalog: one per key, the earliest, if not yet listed."""
    return missing_from(cut(first_of_batch(new)), catalog, BUNDLE_KEYS)


def pending_bundles(catalog: DataFrame, extracted: DataFrame) -> DataFrame:
    """Listed stats bundles that were not unpacked yet, each once. The catalog may list them
    several times."""
    stats = catalog.filter(F.col("file_type") == "stats")
    return missing_from(cut(stats.dropDuplicates(SNAPSHOT_KEYS)), extracted, SNAPSHOT_KEYS)


def current_status(log: DataFrame) -> DataFrame:
    """Latest state of each snapshot in an append-only log ordered by ``seq``."""
    return _top_row(log, SNAPSHOT_KEYS, [F.col("seq").desc()])


def unconsumed(snapshots: DataFrame, consumed: DataFrame) -> DataFrame:
    """Completed sensor snapshots no earlier cycle has used or superseded."""
    ready = snapshots.filter(
        (F.col("status") == "completed") & (F.col("sensor_id") != REFERENCE)
    )
    return ready.join(consumed.select(*SNAPSHOT_KEYS), SNAPSHOT_KEYS, "left_anti")


def latest_per_sensor(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of each sensor; timestamps are strings and compare as such."""
    return _top_row(snapshots, ["sensor_id"], [F.col("timestamp").desc(), F.col("path")])


def latest_reference(snapshots: DataFrame) -> DataFrame:
    """Newest completed snapshot of the baseline sensor."""
    baseline = (F.col("status") == "completed") & (F.col("sensor_id") == REFERENCE)
    return snapshots.filter(baseline).orderBy(F.col("timestamp").desc(), "path").limit(1)


def latest_reference_stats(results: DataFrame) -> DataFrame:
    """All histograms of each project's newest stored reference result."""
    version = [c for c in ("last_updated", "cycle") if c in results.columns]
    newest = results.groupBy("project_id").agg(F.max(F.struct(*version)).alias("v"))
    newest = newest.select("project_id", "v.*")
    return sized_join(results, cut(newest), ["project_id", *version], "left_semi")


def mark_consumed(candidates: DataFrame, sensors: DataFrame) -> DataFrame:
    """Keys to append to the consumed log: every waiting snapshot of the sensors used,
    the superseded older ones included. ``sensors`` must be cheap to count."""
    used = sensors.select("sensor_id")
    return sized_join(candidates, used, ["sensor_id"], "left_semi").select(*SNAPSHOT_KEYS)
