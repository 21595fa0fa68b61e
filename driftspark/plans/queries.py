"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftspark.functions import distances as d
from driftspark.functions.names import REFERENCE, url_timestamp
from driftspark.operators import drift, histograms, reads, selection
from driftspark.operators.histograms import KEYS
from driftspark.operators.joins import sized_join
from driftspark.plans import cycle as cy
from driftspark.session import cut, shared_dir
from driftspark.sources import landing, tables
from driftspark.sources.store import DriftStore
from driftspark.streaming.aggregate import run_cycle as run_stored_cycle
from driftspark.streaming.ingest import first_uploads

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 8
COARSE_SPLITS = 24
CONSUMED_UNTIL = "2000-01"
MARKED_UNTIL = "2024-01-16"
LATE = "2001-01"
PMF_BOUND = 0.02
SIDE_KEYS = cy.SIDE_KEYS


def _round(*columns: str) -> list[Column]:
    return [F.round(F.col(c), DIGITS).alias(c) for c in columns]


# --- histograms -------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.exact_histograms(tables.observations(spark, sf_dir), SIDE_KEYS)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.align_sides(_sides(spark, sf_dir))


def exact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histograms.histogram_rows(_sides(spark, sf_dir), SIDE_KEYS)
    return rows.select(*SIDE_KEYS, "bin", *_round("x", "p"))


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = tables.observations(spark, sf_dir, spread_out=True)
    return histograms.build_sketches(observed, ["sensor_id", "is_reference", *KEYS])


def build_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketches(spark, sf_dir).select(
        "sensor_id", *KEYS, F.kll_sketch_get_n_float("sketch").alias("n")
    )


def merge_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes, which merging keeps exactly."""
    merged = histograms.merge_sketches(_sketches(spark, sf_dir), SIDE_KEYS)
    quantile = lambda r: F.kll_sketch_get_quantile_float("sketch", F.lit(r)).cast("double")
    return merged.select(
        *SIDE_KEYS,
        F.kll_sketch_get_n_float("sketch").alias("n"),
        F.round(quantile(0.0), 4).alias("low"),
        F.round(quantile(1.0), 4).alias("high"),
    )


def _sketch_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = histograms.merge_sketches(_sketches(spark, sf_dir), SIDE_KEYS)
    return histograms.sketch_histograms(merged, SIDE_KEYS)


def _single_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.exact_histograms(
        tables.observations(spark, sf_dir), SIDE_KEYS, single_precision=True
    )


def single_precision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histograms.histogram_rows(_single_sides(spark, sf_dir), SIDE_KEYS)
    return rows.select(*SIDE_KEYS, "bin", *_round("x", "p"))


def sketch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch histograms beside the exact ones: bins agree within the stated bound."""
    exact = histograms.histogram_rows(_single_sides(spark, sf_dir), SIDE_KEYS).select(
        *SIDE_KEYS, "bin", F.col("p").alias("p_exact")
    )
    rows = histograms.histogram_rows(_sketch_sides(spark, sf_dir), SIDE_KEYS)
    return rows.join(exact, [*SIDE_KEYS, "bin"]).select(
        *SIDE_KEYS,
        "bin",
        F.round("x", 4).alias("x"),
        (F.abs(F.col("p") - F.col("p_exact")) <= PMF_BOUND).alias("within_bound"),
    )


def sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate drift of everything in a single scan, held against the exact one."""
    observed = tables.observations(spark, sf_dir, spread_out=True)
    pooled = histograms.pooled_sketches(observed, SIDE_KEYS)
    sides = histograms.sketch_histograms(pooled, SIDE_KEYS)
    exact = drift.align_sides(_single_sides(spark, sf_dir))
    checked = drift.checked_report(drift.align_sides(sides), exact)
    return checked.select(*KEYS, *_round("psi", "pearson", "euclidean"), "degenerate")


# --- drift --------------------------------------------------------------------------------


def _report(aligned: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return drift.distance_report(aligned, keys).select(
        *keys, *_round("psi", "pearson", "euclidean"), "degenerate"
    )


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_aligned(spark, sf_dir))


def channel_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = tables.channel_observations(spark, sf_dir)
    return _report(drift.align_sides(histograms.exact_histograms(channels, SIDE_KEYS)))


def constant_feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quantity value as a feature of its own (a constant) against all quantities."""
    li = tables.table(spark, sf_dir, "lineitem")
    own = li.select(
        F.col("l_quantity").cast("int").alias("submetric"), F.col("l_quantity").alias("value")
    )
    every = own.select(F.lit(-1).alias("submetric"), "value")
    hist = histograms.exact_histograms(own.unionByName(every), ["submetric"])
    baseline = hist.filter("submetric = -1").select(
        F.col("x").alias("x_ref"), F.col("pmf").alias("pmf_ref"), F.lit("quantity").alias("metric")
    )
    current = hist.filter("submetric <> -1").select(
        F.lit("quantity").alias("metric"),
        "submetric",
        F.col("x").alias("x_cur"),
        F.col("pmf").alias("pmf_cur"),
    )
    # ``baseline`` is a single row.
    return _report(current.join(F.broadcast(baseline), "metric"))


def _distance(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = drift.distance(_aligned(spark, sf_dir), name)
        finite = F.when(F.abs("value") < float("inf"), F.round("value", DIGITS))
        return value.select(*KEYS, finite.alias("value"), (F.col("value") == float("inf")).alias("infinite"))

    return query


def _mixed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current side on 30 bins, reference side on 24, so that rebinning has work to do."""
    splits = f"CASE WHEN is_reference THEN {COARSE_SPLITS} ELSE {histograms.NUM_SPLITS} END"
    observed = tables.observations(spark, sf_dir)
    return drift.align_sides(histograms.exact_histograms(observed, SIDE_KEYS, num_splits=splits))


def rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.rebin_rows(_mixed_grids(spark, sf_dir))
    return rows.select(*KEYS, "bin", *_round("edge", "p", "q"))


def rebinned_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = d.available_metrics()
    wide = drift.distances(_mixed_grids(spark, sf_dir), names)
    return wide.select(*KEYS, *_round(*names))


def normalize_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _sides(spark, sf_dir)
        .select(*SIDE_KEYS, F.posexplode(F.expr(d.normalize_bins("x"))).alias("bin", "edge"))
        .select(*SIDE_KEYS, "bin", *_round("edge"))
    )


def common_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.expr(d.common_bins(d.unit_edges("x_cur"), d.unit_edges("x_ref")))
    return (
        _mixed_grids(spark, sf_dir)
        .select(*KEYS, F.posexplode(edges).alias("bin", "edge"))
        .select(*KEYS, "bin", *_round("edge"))
    )


def psi_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi_of_values(tables.observations(spark, sf_dir)).select(
        *KEYS, F.round("value", 6).alias("value")
    )


def euclidean_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's distance from the mean embedding of label 0."""
    label = F.lit("embedding").alias("metric")
    vectors = tables.table(spark, sf_dir, "embeddings").select(
        label, "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    channels = tables.channel_observations(spark, sf_dir).filter("is_reference")
    means = channels.groupBy("metric", "pos").agg(F.avg("value").alias("value"))
    # One row, as long as a vector.
    mean = means.groupBy("metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("ref")
    )
    both = vectors.join(F.broadcast(mean), "metric")
    return both.select("vec_id", drift.vector_distance("vector", "ref").alias("value")).select(
        "vec_id", *_round("value")
    )


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' histograms as trees metric -> submetric -> histogram, one row a side. The
    reference tree has a histogram where the current one branches by submetric of 'tax'."""
    sides = _sides(spark, sf_dir)
    leaf = F.to_variant_object(F.struct("x", "pmf"))
    branches = sides.groupBy("is_reference", "metric").agg(
        F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("submetric", leaf)))).alias("branch"),
        F.first(leaf).alias("leaf"),
    )
    odd = F.col("is_reference") & (F.col("metric") == "tax")
    node = F.when(odd, F.col("leaf")).otherwise(F.col("branch"))
    return branches.groupBy("is_reference").agg(
        F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("metric", node)))).alias("tree")
    )


def distance_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = cut(_trees(spark, sf_dir))
    hellinger = drift.distance_by_path(
        trees.filter("not is_reference"), trees.filter("is_reference"), "hellinger_distance"
    )
    return hellinger.select(F.concat_ws("/", "path").alias("path"), *_round("value"))


# --- bundles and snapshots ----------------------------------------------------------------


def scan_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tables.uploads(spark, sf_dir).select("event_id", "path")
    return landing.with_bundle_keys(listed).select(
        "event_id", "sensor_id", "timestamp", "file_type"
    )


def valid_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.valid_uploads(tables.uploads(spark, sf_dir))
    return kept.select("sensor_id", "timestamp", "file_type")


def rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = selection.rejected_uploads(tables.uploads(spark, sf_dir))
    return refused.select("sensor_id", "timestamp", "file_type")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads catalogued earlier: the purchases."""
    return tables.uploads(spark, sf_dir).filter("event_type = 'purchase'")


def register_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload arrives a second time an hour later."""
    fresh = selection.valid_uploads(tables.uploads(spark, sf_dir))
    later = fresh.withColumns(
        {
            "modificationTime": F.col("modificationTime") + F.expr("interval 1 hour"),
            "path": F.concat("path", F.lit(".again")),
        }
    )
    added = selection.register_bundles(fresh.unionByName(later), _catalog(spark, sf_dir))
    return added.select("sensor_id", "timestamp", "file_type", "path")


def pending_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = selection.valid_uploads(tables.uploads(spark, sf_dir))
    return selection.pending_bundles(catalog, _catalog(spark, sf_dir)).select(
        "sensor_id", "timestamp", "path"
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = landing.inventory(tables.event_members(spark, sf_dir))
    return listed.select("sensor_id", "timestamp", "metrictype", "metric", "submetric", "path")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.snapshot_docs(landing.inventory(tables.event_members(spark, sf_dir)))


def snapshot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    stats = F.flatten(F.transform("type", lambda t: t["stats"]))
    return docs.select(
        "sensor_id",
        "timestamp",
        F.array_join(F.transform("type", lambda t: t["metrictype"]), ",").alias("metrictypes"),
        F.size(stats).alias("n_stats"),
        F.array_join(F.transform(stats, lambda s: s["path"]), ",").alias("paths"),
    )


def gather_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.gather_sketches(_docs(spark, sf_dir))


def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot starts as 'processing'; those that finished have a second entry."""
    states = tables.snapshots(spark, sf_dir).select("sensor_id", "timestamp", "status")
    started = states.withColumns({"status": F.lit("processing"), "seq": F.lit(0)})
    finished = states.filter("status = 'completed'").withColumn("seq", F.lit(1))
    return selection.current_status(started.unionByName(finished)).select(
        "sensor_id", "timestamp", "status"
    )


def _consumed(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("ts") < F.lit(MARKED_UNTIL).cast("timestamp_ntz"))


def latest_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = tables.snapshots(spark, sf_dir)
    newest = selection.latest_per_sensor(selection.unconsumed(snaps, _consumed(snaps)))
    return newest.select("sensor_id", "timestamp", "path")


def latest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = selection.latest_reference(tables.snapshots(spark, sf_dir))
    return newest.select("sensor_id", "timestamp", "path")


def mark_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors whose newest waiting snapshot is a purchase are the ones used here."""
    snaps = tables.snapshots(spark, sf_dir)
    waiting = selection.unconsumed(snaps, _consumed(snaps))
    used = selection.latest_per_sensor(waiting).filter("event_type = 'purchase'")
    return selection.mark_consumed(waiting, cut(used.select("sensor_id")))


def expand_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = landing.expand_bundles(tables.packed_bundles(spark, sf_dir))
    return members.select("sensor_id", "timestamp", "member")


def load_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax sketches are cut short on arrival, and discount sketches of several values have a
    damaged count in a header of the right length: they must be told apart, not merged."""
    members = landing.expand_bundles(tables.packed_bundles(spark, sf_dir))
    several = F.col("member").contains("/discount_") & (F.length("payload") > 15)
    damaged = (
        F.when(
            F.col("member").contains("/tax_"), F.substring("payload", F.lit(1), F.length("payload") - 4)
        )
        .when(several, F.overlay("payload", F.lit(b"\x7f"), F.lit(16), F.lit(1)))
        .otherwise(F.col("payload"))
    )
    loaded = landing.load_sketches(landing.inventory(members.withColumn("payload", damaged)))
    good = F.when(F.col("readable"), F.col("payload"))
    return loaded.groupBy("metric", "submetric").agg(
        F.count("*").alias("bundles"),
        F.sum(F.col("readable").cast("long")).alias("readable"),
        F.sum(F.kll_sketch_get_n_float(good)).alias("n"),
    )


# --- cycles -------------------------------------------------------------------------------


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The snapshot list is a stored table in use; here it is made once.
    snaps = cut(tables.shipments(spark, sf_dir).select("sensor_id", "timestamp").distinct())
    log = snaps.select(
        "*", F.lit("completed").alias("status"), F.concat_ws("/", "sensor_id", "timestamp").alias("path")
    )
    consumed = snaps.filter(F.col("timestamp") < CONSUMED_UNTIL)
    return cut(cy.choose_snapshots(log, consumed))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.observations(spark, sf_dir, spread_out=True).select(
        "sensor_id", "timestamp", "metric", "submetric", "value"
    )


def run_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle in exact mode: suppliers' newest month against the newest baseline month."""
    payload = _payload(spark, sf_dir)
    sides = cy.cycle_histograms(_chosen(spark, sf_dir), payload, cy.from_values)
    results = cy.cycle_results(sides, tables.PROJECT, 1_700_000_000, 1)
    return results.select(
        "project_id",
        "last_updated",
        *KEYS,
        F.round("distances.PSI", DIGITS).alias("psi"),
        F.round("distances.Pearson", DIGITS).alias("pearson"),
        F.round("distances.Euclidean", DIGITS).alias("euclidean"),
    )


def run_sketch_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cycle by sketches of the chosen snapshots, each distance held against its exact
    value under the bound that the sketches' error gives."""
    chosen = _chosen(spark, sf_dir)
    keys = ["sensor_id", "timestamp"]
    # Only what enters the cycle is sketched.
    payload = sized_join(_payload(spark, sf_dir), chosen.select(*keys), keys, "left_semi")
    sketches = histograms.build_sketches(payload, [*keys, "metric", "submetric"])
    sides = cy.cycle_histograms(chosen, sketches, cy.from_sketches)
    exact = cy.cycle_histograms(chosen, payload, cy.from_single_values)
    checked = drift.checked_report(drift.align_sides(sides), drift.align_sides(exact))
    return checked.select(
        F.lit(tables.PROJECT).alias("project_id"),
        F.lit(1_700_000_000).cast("long").alias("last_updated"),
        *KEYS,
        *_round("psi", "pearson", "euclidean"),
    )


def stored_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles through unpacking, the store and a stored cycle; the ends of every merged
    histogram are exact and tell whether the right snapshots went in.
    """
    root = f"{shared_dir(spark)}/driftspark-store-{uuid.uuid4().hex}"
    store = DriftStore(spark, root, tables.PROJECT)
    members = landing.expand_bundles(tables.packed_bundles(spark, sf_dir))
    store.write(landing.classify_members(members), "members", 0)
    unpacked = store.read_part("members", 0).select(
        "sensor_id", "timestamp", F.concat_ws("/", "sensor_id", "timestamp").alias("path")
    )
    store.write(unpacked.distinct(), "snapshots", 0, status="completed")
    run_stored_cycle(store, 0, now=1_700_000_000)
    return store.read("overall").select(
        "project_id",
        "last_updated",
        *KEYS,
        F.round(F.get("x", F.lit(0)), 4).alias("low"),
        F.round(F.element_at("x", -1), 4).alias("high"),
        F.col("distances").isNotNull().alias("compared"),
    )


def _sketch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier months' sketches as unpacked members."""
    keys = ["sensor_id", "timestamp"]
    observed = tables.observations(spark, sf_dir, spread_out=True)
    made = histograms.build_sketches(observed, [*keys, "metric", "submetric"])
    return made.select(
        *keys,
        F.lit("stats").alias("file_type"),
        F.concat_ws("/", *keys).alias("path"),
        F.lit("customstats").alias("metrictype"),
        "metric",
        "submetric",
        F.col("sketch").alias("payload"),
        F.lit(None).cast("string").alias("error"),
        F.lit("sketch").alias("kind"),
    )


def _two_batches(spark: SparkSession, sf_dir: str) -> DriftStore:
    """A store after two batches and cycles: the second batch brings the months before LATE."""
    store = DriftStore(spark, f"{shared_dir(spark)}/driftspark-store-{uuid.uuid4().hex}", tables.PROJECT)
    members = _sketch_members(spark, sf_dir)
    for batch, wanted in enumerate((F.col("timestamp") >= LATE, F.col("timestamp") < LATE)):
        late_baseline = F.col("sensor_id") == REFERENCE
        # The baseline's months are older than LATE and come with the first batch.
        part = members.filter((wanted & ~late_baseline) | (late_baseline & F.lit(batch == 0)))
        store.write(part, "members", batch)
        listed = store.read_part("members", batch).select("sensor_id", "timestamp", "path").distinct()
        store.write(listed, "snapshots", batch, status="completed")
        run_stored_cycle(store, batch, now=1_700_000_000 + batch)
    return store


def late_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late older snapshots count in the cycle after, each sensor's newest one."""
    chosen = _two_batches(spark, sf_dir).read("selected")
    return chosen.select("cycle", "sensor_id", "timestamp", "is_reference")


def stored_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's newest stored histogram, read back as the read layer does."""
    store = _two_batches(spark, sf_dir)
    found = store.metric_stats(tables.PROJECT, "extendedprice", "A", reference=True)
    return found.select(
        *KEYS,
        F.round(F.get("x", F.lit(0)), 2).alias("low"),
        F.round(F.element_at("x", -1), 2).alias("high"),
    )


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample members of a store, through its own scan and read query."""
    store = DriftStore(spark, f"{shared_dir(spark)}/driftspark-store-{uuid.uuid4().hex}", tables.PROJECT)
    flat = tables.samples(spark, sf_dir)
    members = flat.select(
        "sensor_id",
        "timestamp",
        F.lit("data").alias("file_type"),
        F.col("url").alias("path"),
        "metrictype",
        "metric",
        "submetric",
        F.lit(None).cast("binary").alias("payload"),
        F.lit(None).cast("string").alias("error"),
        F.lit("sample").alias("kind"),
    )
    store.write(members, "members", 0)
    return store.project_data(tables.PROJECT, metric="purchase")


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as a stream of several batches, all of them twice: keyed state lets the first of
    a key through, and the store lists it."""
    root = f"{shared_dir(spark)}/driftspark-uploads-{uuid.uuid4().hex}"
    uploads = tables.uploads(spark, sf_dir).select(
        "sensor_id",
        "timestamp",
        "file_type",
        "path",
        F.col("modificationTime").cast("timestamp").alias("modificationTime"),
        F.lit(0).cast("long").alias("length"),
    )
    again = uploads.withColumns(
        {
            "modificationTime": F.col("modificationTime") + F.expr("interval 1 hour"),
            "path": F.regexp_replace("path", "/landing/", "/landing/again/"),
        }
    )
    # The later uploads come in files written later, as many: one micro-batch each.
    for part in (uploads, again):
        part.write.mode("append").parquet(root)
    half = max(1, len(spark.read.parquet(root).inputFiles()) // 2)
    store = DriftStore(spark, f"{root}-store", tables.PROJECT)
    files = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", str(half)).parquet(root)
    query = (
        first_uploads(files)
        .writeStream.outputMode("update")
        .option("checkpointLocation", store.checkpoint("uploads"))
        .trigger(availableNow=True)
        .foreachBatch(
            lambda df, batch: store.write(selection.valid_uploads(df), "bundles", batch)
        )
        .start()
    )
    query.awaitTermination()
    return store.read("bundles").select("sensor_id", "timestamp", "file_type", "path")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of one cycle per ship year, all against the same baseline."""
    observed = tables.observations(spark, sf_dir)
    year = F.when(F.col("is_reference"), F.lit(0)).otherwise(F.year("ts"))
    hist = histograms.exact_histograms(
        observed.withColumn("cycle", year.cast("long")), ["cycle", *KEYS]
    )
    # Both sides come from one small per-key table.
    hist = cut(hist)
    aligned = drift.align(
        hist.filter("cycle <> 0"), hist.filter("cycle = 0").select(*KEYS, "x", "pmf"), how="left"
    )
    binned = drift.with_common_bins(aligned)
    return binned.select(
        F.lit(tables.PROJECT).alias("project_id"),
        F.col("cycle").alias("last_updated"),
        "cycle",
        *KEYS,
        F.col("x_cur").alias("x"),
        F.col("pmf_cur").alias("pmf"),
        F.struct(
            drift.metric_column("psi").alias("PSI"),
            drift.metric_column("pearson_correlation").alias("Pearson"),
            drift.metric_column("euclidean_distance").alias("Euclidean"),
        ).alias("distances"),
    )


def _document_summary(documents: DataFrame) -> DataFrame:
    mass = F.aggregate(
        F.flatten(F.transform("histograms", lambda h: h["pmf"])), F.lit(0.0), lambda a, v: a + v
    )
    return documents.select(
        "project_id",
        "last_updated",
        "part",
        F.size("histograms").alias("n_histograms"),
        F.size("distance").alias("n_distances"),
        F.round(mass, DIGITS).alias("mass"),
        F.array_join(F.transform("histograms", lambda h: F.concat(h["metric"], F.lit("/"), h["submetric"])), ",").alias("names"),
    )


def assemble_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_summary(cy.assemble_overall(_history(spark, sf_dir)))


def latest_reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly baselines as stored reference results; the newest one is read back."""
    observed = tables.observations(spark, sf_dir).filter("is_reference")
    hist = histograms.exact_histograms(
        observed.withColumn("last_updated", F.year("ts").cast("long")),
        ["project_id", "last_updated", *KEYS],
    )
    newest = selection.latest_reference_stats(hist)
    rows = histograms.histogram_rows(newest, ["project_id", "last_updated", *KEYS])
    return rows.select("project_id", "last_updated", *KEYS, "bin", *_round("x", "p"))


# --- reads --------------------------------------------------------------------------------


def _read_bins(found: DataFrame) -> DataFrame:
    return histograms.histogram_rows(found).select(*KEYS, "bin", *_round("x", "p"))


def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return _read_bins(reads.metric_stats(history, tables.PROJECT, "extendedprice", "N"))


def metric_stats_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a submetric, out of nested documents: the first match counts."""
    documents = cy.assemble_overall(_history(spark, sf_dir))
    flat = reads.flatten_overall(documents)
    return _read_bins(reads.metric_stats(flat, tables.PROJECT, "quantity"))


def metric_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.metric_distances(_history(spark, sf_dir), tables.PROJECT)
    return found.select("project_id", "timestamp", *KEYS, *_round("PSI", "Pearson", "Euclidean"))


def project_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.project_data(tables.samples(spark, sf_dir), tables.PROJECT)


def project_data_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.project_data(
        tables.samples(spark, sf_dir), tables.PROJECT, metric="view", timestamp="20240105"
    )


def nested_project_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.project_data(tables.samples(spark, sf_dir), tables.PROJECT)
    nested = reads.nest_project_data(rows)
    metrics = F.flatten(F.transform("data", lambda t: t["data"]))
    return nested.select(
        "projectName",
        "status",
        "sensorId",
        "timestamp",
        F.size(metrics).alias("n_metrics"),
        F.array_join(
            F.flatten(F.transform(metrics, lambda m: F.transform(m["data"], lambda e: e["url"]))), ","
        ).alias("urls"),
    )


def explode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.explode_samples(tables.sample_documents(tables.samples(spark, sf_dir)))


def url_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample urls beside page urls, which name no time."""
    shots = tables.samples(spark, sf_dir).select("url")
    pages = tables.table(spark, sf_dir, "pages").select("url")
    return shots.unionByName(pages).select("url", url_timestamp(F.col("url")).alias("taken"))


def list_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_metrics(tables.samples(spark, sf_dir))


def list_submetrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_submetrics(tables.samples(spark, sf_dir), "click")


def queries() -> dict[str, Query]:
    named = [
        drift_report, exact_histogram, single_precision_histogram, channel_drift, constant_feature_drift,
        rebin, rebinned_distances, normalize_bins, common_bins,
        psi_of_values, euclidean_of_values, distance_by_path,
        build_sketches, merge_sketches, sketch_histogram, sketch_drift,
        scan_landing, valid_uploads, rejected_uploads, register_bundles, pending_bundles,
        expand_bundles, load_sketches, inventory, snapshot_docs, gather_sketches,
        snapshot_status, latest_per_sensor, latest_reference, mark_consumed,
        run_cycle, run_sketch_cycle, stored_cycle, late_snapshots, stored_reference, stored_samples, ingest_stream, assemble_overall, latest_reference_stats,
        metric_stats, metric_stats_first, metric_distances,
        project_data, project_data_filtered, nested_project_data,
        explode_samples, url_times, list_metrics, list_submetrics,
    ]
    by_name = {q.__name__: q for q in named}
    for name in d.available_metrics():
        by_name[f"dist_{name}"] = _distance(name)
    return by_name
