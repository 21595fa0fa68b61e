"""Stream of published snapshots into overall histograms and drift."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.functions.names import REFERENCE
from driftspark.operators import histograms, selection
from driftspark.operators.joins import BROADCAST_ROWS, maybe_in, sent_or_spread, sized_join
from driftspark.plans import cycle as cy
from driftspark.session import cut
from driftspark.sources.store import NEWS, DriftStore

POLL = "10 seconds"
PAYLOAD_KEYS = ["batch_id", "sensor_id", "timestamp"]
CHOSEN = ["sensor_id", "timestamp", "path", "batch_id", "is_reference"]


class Progress(NamedTuple):
    """Where the previous cycle stood; a few numbers for the driver."""

    cycle: int = -1  # the previous cycle
    batch: int = -1  # newest ingest batch it saw
    since: int = -1  # first cycle that had seen that batch


def progress(store: DriftStore, cycle: int) -> Progress:
    """Reads the newest span of headers, and further ones only while they had seen no less."""
    found = None
    for span in reversed([k for k in store.spans("cycles") if 0 <= k <= cycle // store.span]):
        first = span * store.span
        headers = store.read_between("cycles", first, min(cycle, first + store.span) - 1)
        if found is not None:
            headers = headers.filter(F.col("seen_batch") == found.batch)
        by_batch = headers.groupBy("seen_batch").agg(F.max("cycle").alias("cycle"), F.min("cycle").alias("since"))
        last = by_batch.orderBy(F.desc("seen_batch")).first()
        if last and found is None:
            found = Progress(last["cycle"], last["seen_batch"], last["since"])
        elif last:
            found = found._replace(since=last["since"])
        elif found is not None:
            break
    return found or Progress()


def choose(store: DriftStore, cycle: int, before: Progress) -> int | None:
    """Writes the cycle's consumed and selected snapshots; returns the newest ingest batch
    it saw, or None when no sensor sent anything.

    Ingest batches are written in order and a cycle uses up all it sees, so batches
    before the last one seen are finished: only newer partitions are looked at, however
    long the history is.
    """
    done = store.read_between("snapshots", before.batch).filter(F.col("status") == "completed")
    # What a cycle consumed counts once it has its header; a failed one gives it back.
    past = before.since, cycle - 1
    finished = store.read_between("cycles", *past).select("cycle").distinct()
    used = store.read_between("consumed", *past).join(finished, "cycle", "left_semi")
    store.write(selection.unconsumed(done, sent_or_spread(used, used.count())), "consumed", cycle)
    waiting = store.read_part("consumed", cycle)
    reached = waiting.agg(F.max("batch_id").alias("b")).first()["b"]
    if reached is None:
        return None

    newest = selection.latest_per_sensor(waiting).withColumn("is_reference", F.lit(False))
    arrived = done.filter(F.col("sensor_id") == REFERENCE).withColumn("is_reference", F.lit(True))
    kept = store.read_part("selected", before.cycle).filter("is_reference")
    baseline = selection.latest_reference(
        arrived.select(*CHOSEN, "status").unionByName(
            kept.select(*CHOSEN, F.lit("completed").alias("status"))
        )
    )
    store.write(newest.select(*CHOSEN).unionByName(baseline.select(*CHOSEN)), "selected", cycle)
    return reached


def of_chosen(sketches: DataFrame, chosen: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The sketches of the chosen snapshots, which are read from a written table.

    A store holds many snapshots for each chosen one, so with too many of these to broadcast the
    sketches of most others are left out before any is shuffled. No snapshot has more sketches
    than one bundle holds, so none is spread.
    """
    rows = chosen.count()
    if rows > broadcast_rows:
        sketches = maybe_in(sketches, chosen, PAYLOAD_KEYS, rows)
    return sized_join(sketches, chosen, PAYLOAD_KEYS, broadcast_rows=broadcast_rows, fanout=1, rows=rows)


def run_cycle(store: DriftStore, cycle: int, now: int | None = None) -> bool:
    """Aggregate what arrived since the last cycle; False when nothing did.

    A late older snapshot loses against a newer one of the same cycle, but counts in a
    later cycle if it is the newest one waiting there.
    """
    now = int(time.time()) if now is None else now
    before = progress(store, cycle)
    reached = choose(store, cycle, before)
    if reached is None:
        return False

    chosen = store.read_part("selected", cycle).select(*PAYLOAD_KEYS, "is_reference")
    baseline_batch = chosen.filter("is_reference").agg(F.max("batch_id").alias("b")).first()["b"]
    members = store.read_between("members", before.batch)
    if baseline_batch is not None and baseline_batch < before.batch:
        members = members.unionByName(store.read_part("members", baseline_batch))
    sketches = members.filter(F.col("kind") == "sketch").select(
        *PAYLOAD_KEYS, "metric", "submetric", F.col("payload").alias("sketch")
    )
    # The many probes of a histogram are written out wherever Spark describes a plan, which it does
    # anew after every stage: merged first, they stand in a plan of one stage, of many tasks.
    merged = histograms.merge_sketches(of_chosen(sketches, chosen), cy.SIDE_KEYS)
    tasks = store.spark.sparkContext.defaultParallelism
    both = cut(histograms.sketch_histograms(cut(merged.repartition(tasks, *cy.SIDE_KEYS)), cy.SIDE_KEYS))
    store.write(cy.reference_results(both, store.project, now, cycle), "reference_overall", cycle)
    store.write(cy.cycle_results(both, store.project, now, cycle), "overall", cycle)
    # The header comes last: it makes the cycle visible to readers and to the next cycle.
    header = store.spark.range(1).select(
        F.lit(store.project).alias("project_id"),
        F.lit(now).cast("long").alias("last_updated"),
        F.lit(reached).cast("long").alias("seen_batch"),
    )
    store.write(header, "cycles", cycle)
    return True


def start_aggregate(store: DriftStore, available_now: bool = False) -> StreamingQuery:
    """A cycle whenever snapshots were published, or once for all there is. The stream watches
    the folder of notes, which it empties, and not the tables."""
    notes = (
        store.spark.readStream.schema(NEWS)
        .option("cleanSource", "delete")
        .parquet(store.path("news"))
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": POLL}
    return (
        notes.writeStream.queryName("aggregate")
        .option("checkpointLocation", store.checkpoint("aggregate"))
        .trigger(**trigger)
        .foreachBatch(lambda _, cycle: run_cycle(store, cycle))
        .start()
    )
