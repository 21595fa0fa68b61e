"""No upload, vector or bundle is lost to age, size, or a bad neighbour."""

from __future__ import annotations

import os
import time

import pytest

from driftspark.operators import drift, reads, selection
from driftspark.sources import landing
from driftspark.sources.store import DriftStore
from driftspark.streaming.ingest import start_ingest


def test_old_uploads_are_taken(spark, tmp_path, land, sketch):
    store = DriftStore(spark, str(tmp_path / "store"), project="demo")
    payload = {"imgstats/brightness_channel_0.bin": sketch([1.0, 2.0])}

    def ingest():
        query = start_ingest(store, str(land.base), available_now=True)
        query.awaitTermination(120)

    land.put("s1", "100", payload)
    ingest()
    old = land.put("s2", "100", payload)
    os.utime(old, (time.time() - 10 * 86_400,) * 2)
    land.put("s3", "100", payload)
    ingest()
    assert {r.sensor_id for r in store.read("bundles").collect()} == {"s1", "s2", "s3"}


def test_a_bad_bundle_harms_only_itself(spark, land):
    land.put("good", "1", {"imgstats/a.bin": b"x", "./imgstats/b.bin": b"y"})
    land.put("name", "1", {"imgstats/\udcff.bin": b"x"})
    land.put_raw("torn", "1", land.put("whole", "1", {"imgstats/a.bin": os.urandom(9000)}).read_bytes()[:4000])
    rows = landing.expand_bundles(landing.scan_landing(spark, str(land.base))).collect()
    assert {r.member for r in rows if r.sensor_id == "good"} == {"imgstats/a.bin", "imgstats/b.bin"}
    assert {r.sensor_id for r in rows if r.error} == {"name", "torn"}


def test_archives_are_named_after_their_kind(spark):
    paths = ["/l/stats/s/1/stats.tar.gz", "/l/stats/s/1/other.tar.gz", "/l/logs/s/1/logs.tar.gz"]
    df = landing.with_bundle_keys(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [r.path for r in selection.valid_uploads(df).collect()] == paths[:1]
    assert [r.path for r in selection.rejected_uploads(df).collect()] == paths[1:]


@pytest.mark.parametrize("n, value", [(1, None), (2, 5.0), (3, None)])
def test_vectors_of_unequal_length_have_no_distance(spark, n, value):
    current = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((3, 4, 9)[:n])], "k string, pos int, value double")
    shared = spark.createDataFrame([(0, 0.0), (1, 0.0)], "pos int, value double")
    own = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0)], "k string, pos int, value double")
    for reference in (shared, own):
        assert [tuple(r) for r in drift.euclidean_of_values(current, reference, ["k"]).collect()] == [("a", value)]


def test_two_cycles_in_one_second(spark):
    schema = (
        "project_id string, last_updated long, cycle long,"
        " histograms array<struct<metric string, submetric string, x array<double>, pmf array<double>>>,"
        " distance array<struct<metric string, submetric string, distances struct<PSI: double>>>"
    )
    rows = [("p", 7, c, [("m", "s", [1.0], [float(c)])], [("m", "s", (float(c),))]) for c in (1, 2)]
    flat = reads.flatten_overall(spark.createDataFrame(rows, schema))
    assert sorted((r.cycle, r.distances.PSI) for r in flat.collect()) == [(1, 1.0), (2, 2.0)]
    assert reads.metric_stats(flat, "p", "m").first().pmf == [2.0]
    newest = selection.latest_reference_stats(flat)
    assert [r.cycle for r in newest.collect()] == [2]
