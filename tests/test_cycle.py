"""Documents, reads, and selection rules that need no landing folder."""

from __future__ import annotations

import pytest

from driftspark.operators import reads, selection
from driftspark.plans.cycle import assemble_overall
from driftspark.sources.store import RESULT, DISTANCES

X, PMF = [float(i) for i in range(31)], [0.0] + [1 / 30] * 30


@pytest.fixture
def results(spark):
    rows = [
        ("demo", stamp, f"m{i}", "", X, PMF, (0.1, None, 0.3) if i % 2 else None, stamp)
        for stamp in (10, 20)
        for i in range(40)
    ]
    rows.append(("empty", 0, "m0", "", X, PMF, (0.1, 0.2, 0.3), 5))
    return spark.createDataFrame(rows, f"{RESULT}, {DISTANCES}, cycle bigint")


def test_large_documents_continue_in_parts(results):
    docs = assemble_overall(results.filter("project_id = 'demo'"), max_histograms=10).collect()
    assert len(docs) > 2 and {d["part"] for d in docs} <= {0, 1, 2, 3}
    names = sorted(h["metric"] for d in docs if d["last_updated"] == 10 for h in d["histograms"])
    assert names == sorted(f"m{i}" for i in range(40))
    assert sum(len(d["distance"]) for d in docs) == 40
    whole = assemble_overall(results).filter("last_updated = 20").collect()
    assert len(whole) == 1 and len(whole[0]["histograms"]) == 40


def test_metric_stats_looks_at_the_newest_document_only(results):
    newest_lacks_it = results.filter("not (last_updated = 20 and metric = 'm3')")
    assert reads.metric_stats(newest_lacks_it, "demo", "m3").count() == 0
    assert reads.metric_stats(results, "demo", "m3").count() == 1
    assert reads.metric_stats(results, "demo", "m3", "other").count() == 0
    assert reads.metric_stats(results, "nobody", "m3").count() == 0


def test_metric_stats_with_headers_sees_empty_cycles(spark, results):
    headers = spark.createDataFrame(
        [("demo", 10, 10), ("demo", 30, 30)], "project_id string, last_updated bigint, cycle bigint"
    )
    assert reads.metric_stats(results, "demo", "m1", cycles=headers).count() == 0


def test_metric_distances_skips_undated_and_unmatched(results):
    assert reads.metric_distances(results, "empty").count() == 0
    found = reads.metric_distances(results, "demo").collect()
    assert len(found) == 40 and [r["timestamp"] for r in found[:20]] == ["10"] * 20
    assert found[0]["Pearson"] is None


def test_selection_rules(spark):
    schema = "sensor_id string, timestamp string, status string, path string"
    snaps = spark.createDataFrame(
        [
            ("a", "100", "completed", "p1"),
            ("a", "99", "completed", "p2"),  # strings: "99" is newer than "100"
            ("a", "999", "processing", "p3"),
            ("b", "1", "completed", "p4"),
            ("reference", "5", "completed", "p5"),
            ("reference", "6", "processing", "p6"),
        ],
        schema,
    )
    used = spark.createDataFrame([("b", "1")], "sensor_id string, timestamp string")
    waiting = selection.unconsumed(snaps, used)
    assert [r["path"] for r in selection.latest_per_sensor(waiting).collect()] == ["p2"]
    assert [r["path"] for r in selection.latest_reference(snaps).collect()] == ["p5"]
    sensors = spark.createDataFrame([("a",)], "sensor_id string")
    marked = selection.mark_consumed(waiting, sensors).collect()
    assert sorted(r["timestamp"] for r in marked) == ["100", "99"]


def test_project_data_filters_and_status(spark):
    rows = [
        ("p", "s1", "2", "completed", "samples", "cat", "x", "/u/a_1.png"),
        ("p", "s1", "1", "processing", "samples", "dog", "y", "/u/b_2.png"),
        ("p", "s2", "1", "completed", "samples", "cat", "y", "/u/c.png"),
        ("q", "s1", "1", "completed", "samples", "cat", "y", "/u/d_4.png"),
    ]
    schema = (
        "project_name string, sensor_id string, timestamp string, status string, "
        "metrictype string, metric string, submetric string, url string"
    )
    samples = spark.createDataFrame(rows, schema)
    found = reads.project_data(samples, "p")
    assert found.count() == 3
    assert {r["status"] for r in found.collect()} == {"processing"}
    only = reads.project_data(samples, "p", timestamp="1", sensor_id="s2")
    assert [(r["url"], r["url_timestamp"], r["status"]) for r in only.collect()] == [
        ("/u/c.png", None, "completed")
    ]
    assert reads.project_data(samples, "p", metric="cat").count() == 2
    assert reads.project_data(samples, "nobody").count() == 0
    nested = reads.nest_project_data(found).filter("sensorId = 's1' and timestamp = '2'").first()
    assert nested["data"][0]["data"][0]["data"][0]["url"] == "/u/a_1.png"
