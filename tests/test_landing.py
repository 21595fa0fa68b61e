"""Paths, member names, urls, and unpacking."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from driftspark.functions import names
from driftspark.operators import selection
from driftspark.sources import landing, tables


@pytest.mark.parametrize(
    "file_name, expected",
    [
        ("brightness_channel_0.bin", ("brightness", "channel_0")),
        ("randomsampling.bin", ("randomsampling", "")),
        ("a_b.bin.bin", ("a", "b")),
        ("a.bin_b.bin", ("a", "b")),
        ("_x.bin", ("", "x")),
        ("a_.bin", ("a", "")),
    ],
)
def test_split_name(spark, file_name, expected):
    metric, submetric = names.split_name(F.col("f"))
    row = spark.createDataFrame([(file_name,)], "f string").select(
        metric.alias("m"), submetric.alias("s")
    )
    assert tuple(row.first()) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("/a/cat_1704067207179575.png", "2024-01-01 00:00:07.179575 UTC"),
        ("/a/cat_0.png", "1970-01-01 00:00:00.000000 UTC"),
        ("/a_5.png/b_86399999999.png", "1970-01-01 00:00:00.000005 UTC"),
        ("/a/cat.png", None),
        ("/a/cat_99999999999999999999999.png", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_url_timestamp(spark, url, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(url,)], "u string")
        assert df.select(names.url_timestamp(F.col("u"))).first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scan_reads_keys_from_the_path(spark, land):
    land.put("s1", "100", {"imgstats/a.bin": b"x"})
    land.put("s2", "200", {"samples/a_1.png": b"x"}, "data")
    found = landing.scan_landing(spark, str(land.base))
    assert sorted(tuple(r) for r in found.select("sensor_id", "timestamp", "file_type").collect()) == [
        ("s1", "100", "stats"),
        ("s2", "200", "data"),
    ]
    assert landing.scan_landing(spark, str(land.base), "data").count() == 1
    # Listing bundles must not read them.
    plan = found.select("path", "sensor_id")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_expand_keeps_good_bundles_and_reports_broken_ones(spark, land):
    land.put("s1", "100", {"./imgstats/a.bin": b"one", "imgstats/b.bin": b"two"})
    whole = land.put("s2", "100", {"imgstats/a.bin": bytes(range(256)) * 500})
    whole.write_bytes(whole.read_bytes()[:-20])
    land.put_raw("s3", "100", b"plain text")
    members = landing.expand_bundles(landing.scan_landing(spark, str(land.base)))
    good = members.filter("error is null").select("sensor_id", "member", "payload")
    assert sorted((r[0], r[1], bytes(r[2])) for r in good.collect()) == [
        ("s1", "imgstats/a.bin", b"one"),
        ("s1", "imgstats/b.bin", b"two"),
    ]
    assert {r["sensor_id"] for r in landing.broken_bundles(members).collect()} == {"s2", "s3"}


def test_inventory_and_documents(spark):
    rows = [
        ("s", "1", "stats", "/l/stats/s/1/stats.tar.gz", m)
        for m in (
            "imgstats/brightness_channel_0.bin",
            "imgstats/._brightness_channel_0.bin",
            "samples/randomsampling.bin",
            "imgstats/notes.txt",
            "other/x.bin",
            "imgstats/deep/x.bin",
        )
    ]
    members = spark.createDataFrame(
        rows, "sensor_id string, timestamp string, file_type string, path string, member string"
    )
    listed = landing.inventory(members)
    doc = landing.snapshot_docs(listed).first()
    found = {(t["metrictype"], s["metric"], s["submetric"], s["path"]) for t in doc["type"] for s in t["stats"]}
    assert found == {
        ("imgstats", "brightness", "channel_0", "/l/stats/s/1/imgstats/brightness_channel_0.bin"),
        ("samples", "randomsampling", "", "/l/stats/s/1/samples/randomsampling.bin"),
    }


def test_uploads_without_a_known_type_are_refused(spark):
    df = spark.createDataFrame([("stats",), ("data",), ("logs",), (None,)], "file_type string")
    assert selection.valid_uploads(df).count() == 2
    assert selection.rejected_uploads(df).count() == 2


def test_first_upload_wins(spark):
    schema = "sensor_id string, timestamp string, file_type string, path string, modificationTime int"
    new = spark.createDataFrame(
        [
            ("s", "1", "stats", "late", 9),
            ("s", "1", "stats", "early", 3),
            ("s", "1", "data", "other", 9),
            ("t", "1", "stats", "known", 1),
        ],
        schema,
    )
    catalog = spark.createDataFrame([("t", "1", "stats", "x", 0)], schema)
    added = selection.register_bundles(new, catalog).collect()
    assert sorted(r["path"] for r in added) == ["early", "other"]


@pytest.mark.parametrize("work", [landing._unpack, tables._pack])
def test_worker_code_needs_no_installed_package(work, tmp_path):
    load = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print(list(f([])) if f.__code__.co_argcount == 1 else 'ok')"
    done = subprocess.run(
        [sys.executable, "-I", "-c", load],
        input=cloudpickle.dumps(work),
        cwd=tmp_path,
        capture_output=True,
        check=False,
    )
    assert done.returncode == 0, done.stderr.decode()
