"""Landing folder -> store -> cycles, driven by streams that stop when caught up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftspark.operators import reads
from driftspark.plans.cycle import assemble_overall
from driftspark.sources.store import DriftStore
from driftspark.streaming.aggregate import run_cycle, start_aggregate
from driftspark.streaming.ingest import ingest_batch, start_ingest
from driftspark.sources import landing

MEMBER = "imgstats/brightness_channel_0.bin"


@pytest.fixture
def store(spark, tmp_path):
    return DriftStore(spark, str(tmp_path / "store"), "demo")


def drain(*queries):
    for query in queries:
        query.awaitTermination()
        assert query.exception() is None


def ingest(store, land):
    drain(start_ingest(store, str(land.base), available_now=True))


def aggregate(store):
    drain(start_aggregate(store, available_now=True))


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ingest_lists_unpacks_and_quarantines(store, land, sketch):
    good = sketch(range(100))
    land.put(
        "s1",
        "100",
        {
            MEMBER: good,
            "imgstats/._brightness_channel_0.bin": b"apple double",
            "samples/randomsampling.bin": b"no sketch at all, but long enough to look at",
            "imgstats/a_b.bin.bin": good,
            "other/x.bin": good,
        },
    )
    land.put_raw("s2", "100", b"not a gzip archive")
    land.put("s3", "100", {"samples/cat_front_1704067207179575.png": b"png"}, "data")
    land.put("s4", "100", {MEMBER: good}, "logs")
    ingest(store, land)

    listed = store.read("members").filter("kind = 'sketch'")
    assert keys(listed, "sensor_id", "metrictype", "metric", "submetric") == [
        ("s1", "imgstats", "a", "b"),
        ("s1", "imgstats", "brightness", "channel_0"),
    ]
    assert keys(store.snapshot_status(), "sensor_id", "status") == [
        ("s1", "completed"),
        ("s2", "processing"),
    ]
    refused = {(r["sensor_id"], r["path"].rsplit("/", 1)[1]) for r in store.quarantine().collect()}
    assert refused == {
        ("s1", "randomsampling.bin"),
        ("s2", "stats.tar.gz"),
        ("s4", "logs.tar.gz"),
    }
    assert keys(store.project_data("demo"), "sensorId", "metric", "submetric", "url_timestamp") == [
        ("s3", "cat", "front", "2024-01-01 00:00:07.179575 UTC")
    ]
    assert keys(store.list_metrics(), "metric") == [("cat",)]
    assert keys(store.list_submetrics("cat"), "submetric") == [("front",)]
    docs = store.snapshot_documents().collect()
    assert [(d["sensor_id"], [t["metrictype"] for t in d["type"]]) for d in docs] == [
        ("s1", ["imgstats"])
    ]


def test_same_key_is_listed_once_and_kinds_do_not_clash(store, land, sketch):
    land.put("s1", "100", {MEMBER: sketch(range(10))})
    ingest(store, land)
    land.put("s1", "100", {"samples/cat_1.png": b""}, "data")
    again = land.put("s1", "100", {MEMBER: sketch(range(20))})
    again.rename(again.with_name("other.tar.gz"))
    ingest(store, land)
    assert keys(store.read("bundles"), "sensor_id", "timestamp", "file_type") == [
        ("s1", "100", "data"),
        ("s1", "100", "stats"),
    ]
    n = store.read("members").filter("kind = 'sketch'").agg(
        F.sum(F.expr("kll_sketch_get_n_float(payload)")).alias("n")
    )
    assert n.first()["n"] == 10


def test_odd_names_and_archiving(store, land, sketch, tmp_path):
    land.put("s[1] {a}*", "10 0", {MEMBER: sketch(range(10))})
    archive = tmp_path / "archive"
    query = start_ingest(store, str(land.base), archive_dir=str(archive), available_now=True)
    drain(query)
    assert keys(store.snapshot_status(), "sensor_id", "timestamp", "status") == [
        ("s[1] {a}*", "10 0", "completed")
    ]
    assert store.read("members").filter("kind = 'sketch'").count() == 1


def test_replayed_batch_adds_nothing(spark, store, land, sketch):
    land.put("s1", "100", {MEMBER: sketch(range(10))})
    files = landing.scan_landing(spark, str(land.base))
    for _ in range(2):
        ingest_batch(store, files, 0)
        assert run_cycle(store, 0, now=1)
    for name in ("bundles", "members", "consumed", "overall", "cycles"):
        assert store.read(name).count() == 1, name
    assert store.read("snapshots").count() == 2


def test_cycles_take_the_newest_snapshot_of_each_sensor(store, land, sketch):
    land.put("reference", "050", {MEMBER: sketch(range(1000))})
    land.put("s1", "100", {MEMBER: sketch(range(5))})
    land.put("s1", "200", {MEMBER: sketch(range(100))})
    land.put("s2", "150", {MEMBER: sketch(range(300))})
    ingest(store, land)
    aggregate(store)
    chosen = store.read("selected").select("sensor_id", "timestamp")
    assert keys(chosen, "sensor_id", "timestamp") == [
        ("reference", "050"),
        ("s1", "200"),
        ("s2", "150"),
    ]
    assert keys(store.read("consumed"), "sensor_id", "timestamp") == [
        ("s1", "100"),
        ("s1", "200"),
        ("s2", "150"),
    ]
    x = store.metric_stats("demo", "brightness", "channel_0").first()["x"]
    assert (len(x), x[0], x[-1]) == (31, 0.0, 299.0)
    assert store.metric_stats("demo", "brightness", reference=True).first()["x"][-1] == 999.0
    dist = store.metric_distances("demo").collect()
    assert len(dist) == 1 and dist[0]["PSI"] is not None

    # Nothing new: no cycle. A late older snapshot is used if it is all there is.
    aggregate(store)
    assert store.read("cycles").count() == 1
    land.put("s1", "120", {MEMBER: sketch(range(50))})
    ingest(store, land)
    aggregate(store)
    assert store.read("cycles").count() == 2
    assert store.metric_stats("demo", "brightness").first()["x"][-1] == 49.0
    last = store.read("cycles").agg(F.max("cycle").alias("c")).first()["c"]
    again = store.read("selected").filter(F.col("cycle") == last)
    assert keys(again, "sensor_id", "timestamp") == [("reference", "050"), ("s1", "120")]


def test_cycle_without_a_baseline_has_no_distances(store, land, sketch):
    land.put("s1", "100", {MEMBER: sketch(range(100))})
    ingest(store, land)
    aggregate(store)
    assert store.metric_stats("demo", "brightness").count() == 1
    assert store.metric_stats("demo", "brightness", reference=True).count() == 0
    assert store.metric_distances("demo").count() == 0
    document = assemble_overall(store.read("overall")).first()
    assert len(document["histograms"]) == 1 and document["distance"] == []


def test_streamed_result_equals_batch_result(spark, store, land, sketch):
    """Two landings in two runs give the rows one batch over everything gives."""
    land.put("reference", "050", {MEMBER: sketch(range(150))})
    ingest(store, land)
    land.put("s1", "100", {MEMBER: sketch(range(100))})
    ingest(store, land)
    aggregate(store)

    whole = DriftStore(spark, store.root + "-batch", "demo")
    ingest_batch(whole, landing.scan_landing(spark, str(land.base)), 0)
    assert run_cycle(whole, 0)
    row = lambda s: s.read("overall").select("metric", "x", "pmf", "distances").collect()
    assert row(store) == row(whole)


def test_documents_read_like_tables(store, land, sketch):
    land.put("reference", "050", {MEMBER: sketch(range(150))})
    land.put("s1", "100", {MEMBER: sketch(range(100)), "modelstats/accuracy.bin": sketch([1, 2])})
    ingest(store, land)
    run_cycle(store, 7, now=1_700_000_000)
    flat = reads.flatten_overall(assemble_overall(store.read("overall")))
    assert keys(flat, "pos", "metric", "submetric") == [
        (0, "accuracy", ""),
        (1, "brightness", "channel_0"),
    ]
    assert flat.filter("distances is not null").count() == 1
    found = reads.metric_distances(flat, "demo").first()
    assert found["timestamp"] == "1700000000" and found["metric"] == "brightness"
