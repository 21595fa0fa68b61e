"""Stream of landed bundles into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.operators import selection
from driftspark.sources import landing
from driftspark.sources.store import DriftStore

POLL = "10 seconds"
NAMES = ["sensor_id", "timestamp", "file_type", "path", "modificationTime", "length"]


def first_uploads(files: DataFrame) -> DataFrame:
    """A stream of names, to be written in update mode: of the accepted uploads each (sensor,
    timestamp, file type) once, the first one, and all others that are not accepted.

    The earliest upload of the batch a key came in first wins. What was seen is kept in the
    stream's state store, a key a row, so that a batch looks up its own keys only and no catalog
    is read again. A key is new as long as only one batch had it: batches are told apart by
    their time, which Spark logs with them, so that a replayed one finds the same. The state
    belongs to the checkpoint.
    """
    listed = files.select(*NAMES)
    batch = listed.withColumn("batch", F.current_timestamp())
    missing = lambda c: F.col(c).isNull().alias(f"no_{c}")
    # Uploads without a time or a path come last.
    order = [missing("modificationTime"), "modificationTime", missing("path"), "path", "length"]
    firsts = (
        selection.valid_uploads(batch)
        .groupBy(*selection.BUNDLE_KEYS)
        .agg(
            F.min(F.struct(*order)).alias("first"),
            F.min("batch").alias("since"),
            F.max("batch").alias("until"),
        )
        .filter("since = until")
        .select(*selection.BUNDLE_KEYS, "first.*")
    )
    return firsts.select(*NAMES).unionByName(selection.rejected_uploads(listed))


def ingest_batch(store: DriftStore, listed: DataFrame, batch_id: int) -> None:
    """Catalog a micro-batch of first uploads, unpack them, and publish snapshots.

    Contents are read once, by the write of ``members``; for that the batch's paths, at most
    as many as the stream takes in one trigger, are named by the driver. Snapshots turn
    'completed' last, when their sketches are in place. Nothing earlier is read.
    """
    listed = listed.select(*NAMES)
    store.write(selection.rejected_uploads(listed), "rejected", batch_id)
    fresh = selection.first_of_batch(selection.valid_uploads(listed))
    store.write(fresh, "bundles", batch_id)

    added = store.read_part("bundles", batch_id).drop("batch_id")
    stats = added.filter("file_type = 'stats'")
    store.write(stats, "snapshots", batch_id, status="processing")
    members = landing.expand_landed(store.spark, added)
    if members is not None:
        store.write(landing.classify_members(members), "members", batch_id)
        broken = store.read_part("members", batch_id).filter("kind = 'bad_bundle'")
        stats = stats.join(broken.select("path"), "path", "left_anti")
    store.write(added.filter("file_type = 'stats'"), "extracted", batch_id)
    store.write(stats, "snapshots", batch_id, status="completed")
    store.announce(batch_id)


def start_ingest(
    store: DriftStore,
    landing_dir: str,
    max_files: int = landing.FILES_PER_TRIGGER,
    archive_dir: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Poll the landing folder, or work off what is there and stop."""
    files = landing.stream_landing(store.spark, landing_dir, max_files, archive_dir)
    trigger = {"availableNow": True} if available_now else {"processingTime": POLL}
    return (
        first_uploads(files)
        .writeStream.queryName("ingest")
        .outputMode("update")
        .option("checkpointLocation", store.checkpoint("ingest"))
        .trigger(**trigger)
        .foreachBatch(lambda df, batch_id: ingest_batch(store, df, batch_id))
        .start()
    )
