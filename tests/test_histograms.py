"""Exact and sketch histograms, and the two join strategies behind the exact ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions.sketches import is_sketch
from driftspark.operators import histograms as h
from driftspark.operators.joins import missing_from, sized_join, with_parts
from driftspark.sources import tables

OBS = "sensor_id string, metric string, submetric string, value double"


def observed(spark, values, metric="m", sensors=4):
    rows = [(f"s{i % sensors}", metric, "", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, OBS)


def brute(values, n=30):
    low, high = min(values), max(values)
    step = (high - low) / n or 0.01
    pmf = [0.0] * (n + 1)
    for v in values:
        pmf[min(n, math.floor((v - low) / step) + 1)] += 1 / len(values)
    return [low + i * step for i in range(n)] + [high], pmf


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0], [4.0] * 7, list(range(100))])
def test_exact_histogram(spark, values):
    row = h.exact_histograms(observed(spark, [float(v) for v in values])).first()
    x, pmf = brute(values)
    assert np.allclose(row["x"], x) and np.allclose(row["pmf"], pmf)
    assert row["n_obs"] == len(values) and math.isclose(sum(row["pmf"]), 1.0)


def test_nulls_nans_and_infinite_ranges(spark):
    df = observed(spark, [1.0, None, float("nan"), 3.0]).unionByName(
        observed(spark, [1.0, float("inf")], metric="endless")
    )
    rows = h.exact_histograms(df).collect()
    assert [(r["metric"], r["n_obs"]) for r in rows] == [("m", 2)]


def test_sketches_ignore_the_same_values(spark):
    df = observed(spark, [1.0, None, float("nan"), 3.0]).unionByName(
        observed(spark, [1.0, float("inf")], metric="endless")
    )
    merged = h.merge_sketches(h.build_sketches(df, ["sensor_id", *h.KEYS]))
    rows = h.sketch_histograms(merged).collect()
    assert [(r["metric"], r["n_obs"]) for r in rows] == [("m", 2)]


def test_salted_join_gives_the_broadcast_result(spark, sf_dir):
    """A key with a third of all rows, on either join strategy."""
    df = tables.observations(spark, sf_dir).withColumn(
        "submetric", F.when(F.col("metric") == "tax", "hot").otherwise(F.col("submetric"))
    )
    small = h.exact_histograms(df, num_splits=30)
    salted = h.exact_histograms(df, num_splits=30, broadcast_rows=0)
    assert "BroadcastHashJoin" not in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(small.collect()) == sorted(salted.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_sized_join_keeps_every_row_once(spark, how):
    big = spark.range(1000).withColumn("k", F.expr("if(id % 3 = 0, 0, id % 7)"))
    small = spark.createDataFrame([(0, "a"), (3, "b"), (99, "c")], "k long, name string")
    expected = sorted(big.join(small, "k", how).collect(), key=repr)
    for rows in (10, 0):
        found = sized_join(big, small, ["k"], how, broadcast_rows=rows).collect()
        assert sorted(found, key=repr) == expected


def test_with_parts_splits_only_long_groups(spark):
    rows = spark.range(1000).withColumn("k", F.expr("if(id % 3 = 0, 0, id)"))
    parts = with_parts(rows, ["k"], ["id"], 50).groupBy("k", "part").count().collect()
    assert sum(r["count"] for r in parts) == 1000
    hot = [r["count"] for r in parts if r["k"] == 0]
    assert len(hot) == 7 and max(hot) < 100
    assert all(r["part"] == 0 for r in parts if r["k"] != 0)


def test_missing_from_on_both_strategies(spark):
    new, log = spark.range(10), spark.range(5, 1000)
    for rows in (100, 0):
        left = missing_from(new, log, ["id"], broadcast_rows=rows).collect()
        assert sorted(r["id"] for r in left) == [0, 1, 2, 3, 4]


def test_merged_sketches_stay_within_the_bound(spark, sf_dir):
    df = tables.observations(spark, "/root/testdata/sf0.01").filter("metric = 'extendedprice'")
    merged = h.merge_sketches(h.build_sketches(df, ["sensor_id", *h.KEYS]))
    rows = h.histogram_rows(h.sketch_histograms(merged))
    exact = h.histogram_rows(h.exact_histograms(df)).withColumnRenamed("p", "e").drop("x")
    worst = rows.join(exact, [*h.KEYS, "bin"]).agg(F.max(F.abs(F.col("p") - F.col("e"))))
    assert worst.first()[0] < 0.02


def test_pooled_sketches_match_merged_ones(spark, sf_dir):
    df = tables.observations(spark, sf_dir).filter("metric = 'quantity'")
    pooled = {r["submetric"]: r for r in h.sketch_histograms(h.pooled_sketches(df)).collect()}
    merged = h.merge_sketches(h.build_sketches(df, ["sensor_id", *h.KEYS]))
    for row in h.sketch_histograms(merged).collect():
        other = pooled[row["submetric"]]
        assert (row["x"], row["n_obs"]) == (other["x"], other["n_obs"])
        assert np.abs(np.array(row["pmf"]) - np.array(other["pmf"])).max() < 0.03


def test_merge_order_does_not_matter_within_bounds(spark):
    values = np.random.default_rng(3).gamma(2.0, size=20_000).tolist()
    df = observed(spark, values, sensors=50)
    sketches = h.build_sketches(df, ["sensor_id", *h.KEYS])
    a = h.sketch_histograms(h.merge_sketches(sketches)).first()
    turned = sketches.orderBy(F.desc("sensor_id"))
    b = h.sketch_histograms(h.merge_sketches(turned, spread=1)).first()
    assert a["x"] == b["x"] and np.abs(np.array(a["pmf"]) - np.array(b["pmf"])).max() < 0.02


def test_empty_and_constant_sketches(spark, sketch):
    rows = [("none", "", sketch([])), ("flat", "", sketch([2.5] * 40)), ("one", "", sketch([7]))]
    df = spark.createDataFrame(rows, "metric string, submetric string, sketch binary")
    found = {r["metric"]: r for r in h.sketch_histograms(df).collect()}
    assert set(found) == {"flat", "one"}
    for name, c in (("flat", 2.5), ("one", 7.0)):
        assert found[name]["x"][0] == found[name]["x"][-1] == c
        assert found[name]["pmf"][:3] == [0.0, 1.0, 0.0]


def test_values_on_a_split_go_up_in_single_precision(spark):
    values = [i / 100 for i in range(11)]
    merged = h.merge_sketches(h.build_sketches(observed(spark, values), ["sensor_id", *h.KEYS]))
    row = h.sketch_histograms(merged).first()
    splits = np.array(row["x"][:-1], dtype=np.float32)
    expected = np.zeros(31)
    for v in np.array(values, dtype=np.float32):
        expected[(splits <= v).sum()] += 1 / 11
    assert np.abs(np.array(row["pmf"]) - expected).max() < 2e-3
    exact = h.exact_histograms(observed(spark, values), single_precision=True).first()
    assert np.allclose(exact["pmf"], expected)


def test_readable_sketches(spark, sketch):
    good = [sketch(range(n)) for n in (0, 1, 2, 199, 200, 201, 1000, 20_000)]
    wide = [
        bytes(spark.range(5000).selectExpr(f"kll_sketch_agg_float(float(id), {k}) s").first()["s"])
        for k in (8, 50, 4000)
    ]
    doubles = bytes(spark.range(50).selectExpr("kll_sketch_agg_double(double(id)) s").first()["s"])
    bad = [b"", b"abc", b"no sketch, just text", None, doubles]
    bad += [g[:-4] for g in good[1:]] + [g + b"1234" for g in good] + [good[5][:10]]
    bad += [b"\x05\x01\x07" + good[4][3:]]
    for buffers, answer in ((good + wide, True), (bad, False)):
        df = spark.createDataFrame([(b,) for b in buffers], "b binary")
        assert [r[0] for r in df.select(F.expr(is_sketch("b"))).collect()] == [answer] * len(buffers)
