"""A table that is counted too long is not broadcast, however short its files are."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from driftspark.operators.joins import BROADCAST_ROWS, maybe_in, sized_join
from driftspark.sources.store import DriftStore
from driftspark.streaming import aggregate
from driftspark.streaming.aggregate import PAYLOAD_KEYS, of_chosen, run_cycle

# More than a cycle broadcasts.
SENSORS = BROADCAST_ROWS + 100


def joins(df):
    """The joins that ran, as AQE settled them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in ("BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin") if k in plan.split("== Initial Plan ==")[0]]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_beyond_the_limit_a_short_file_is_not_broadcast(spark, tmp_path, how):
    big = spark.range(1000).withColumn("k", F.expr("if(id % 3 = 0, 0, id % 7)"))
    spark.createDataFrame([(0, "a"), (3, "b"), (99, "c")], "k long, name string").write.parquet(str(tmp_path / "s"))
    small = spark.read.parquet(str(tmp_path / "s"))
    sent, spread = (sized_join(big, small, ["k"], how, broadcast_rows=rows) for rows in (3, 2))
    assert joins(sent) == ["BroadcastHashJoin"] and joins(spread) == ["SortMergeJoin"]
    assert sorted(sent.collect(), key=repr) == sorted(spread.collect(), key=repr)


@pytest.mark.parametrize("words", [1, 8, 1 << 18])
def test_the_sieve_keeps_every_row_with_a_partner(spark, words):
    keyed = lambda df: df.selectExpr("id", "if(id % 50 = 7, null, concat('s', id)) s", "id % 11 t")
    small = keyed(spark.range(0, 40_000, 40)).select("s", "t")
    big = keyed(spark.range(40_000)).unionByName(keyed(spark.range(40_000)))
    kept = maybe_in(big, small, ["s", "t"], small.count(), words)
    assert kept.columns == big.columns
    exact = sorted(big.join(small, ["s", "t"], "left_semi").collect())
    assert sorted(kept.join(small, ["s", "t"], "left_semi").collect()) == exact and len(exact) > 1900
    if words > 1000:
        assert kept.count() < 80_000 / 10


def test_both_ways_find_the_sketches_of_the_chosen(spark, tmp_path):
    sketches = spark.range(3000).selectExpr(
        "id % 2 batch_id", "concat('s', id % 300) sensor_id", "string(id % 7) timestamp", "'m' metric", "string(id) submetric",
        "cast(string(id) as binary) sketch",
    )
    spark.range(40).selectExpr(
        "id % 2 batch_id", "concat('s', id) sensor_id", "string(id % 7) timestamp", "id = 3 is_reference"
    ).write.parquet(str(tmp_path / "chosen"))
    chosen = spark.read.parquet(str(tmp_path / "chosen"))
    sent, spread = of_chosen(sketches, chosen), of_chosen(sketches, chosen, broadcast_rows=0)
    assert sent.columns == spread.columns
    found = sorted(sent.collect())
    assert found == sorted(spread.collect()) and found == sorted(sketches.join(chosen, PAYLOAD_KEYS).collect())
    assert found and "SortMergeJoin" in joins(spread) and joins(sent) == ["BroadcastHashJoin"]


@contextmanager
def short_broadcasts(spark):
    """No broadcast of more than 12 MB, for which a plain table of ``SENSORS`` snapshots is too long."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "12m")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def arrive(store, batch, timestamp, sketches):
    store.write(
        sketches.selectExpr(
            "sensor_id", f"'{timestamp}' timestamp", "'stats' file_type", "concat('/', sensor_id) path", "'customstats' metrictype",
            "'m' metric", "'a' submetric", "sketch payload", "string(null) error", "'sketch' kind",
        ),
        "members",
        batch,
    )
    store.write(store.read_part("members", batch).select("sensor_id", "timestamp", "path"), "snapshots", batch, status="completed")


def test_cycles_of_many_sensors_send_no_long_table(spark, tmp_path):
    store = DriftStore(spark, str(tmp_path / "store"), "demo")
    values = spark.range(0, SENSORS, 1, 8).selectExpr("if(id = 0, 'reference', concat('s', id)) sensor_id", "float(id) v")
    sketches = values.groupBy("sensor_id").agg(F.kll_sketch_agg_float("v").alias("sketch")).localCheckpoint()
    arrive(store, 0, "2001-02", sketches)
    with short_broadcasts(spark):
        assert run_cycle(store, 0, now=1)
    # Older snapshots of all sensors but the baseline, after the first cycle used up the newer ones.
    arrive(store, 1, "2001-01", sketches.filter("sensor_id <> 'reference'"))
    with short_broadcasts(spark):
        assert run_cycle(store, 1, now=2)
    chosen = store.read("selected").groupBy("cycle", "timestamp", "is_reference").count()
    assert sorted(map(tuple, chosen.collect())) == [
        (0, "2001-02", False, SENSORS - 1),
        (0, "2001-02", True, 1),
        (1, "2001-01", False, SENSORS - 1),
        (1, "2001-02", True, 1),
    ]
    ends = store.read("overall").selectExpr("cycle", "x[0]", "element_at(x, -1)", "distances is not null")
    assert sorted(map(tuple, ends.collect())) == [(c, 1.0, float(SENSORS - 1), True) for c in (0, 1)]
    baseline = store.metric_stats("demo", "m", "a", reference=True)
    assert [tuple(r) for r in baseline.selectExpr("x[0]", "x[1]", "element_at(x, -1)").collect()] == [(0.0, 0.01, 0.0)]


def test_plans_of_many_stages_are_short(spark, tmp_path, monkeypatch):
    """Spark keeps the text of a plan and writes it anew after each stage."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = aggregate.cut
    monkeypatch.setattr(aggregate, "cut", noted)
    store = DriftStore(spark, str(tmp_path / "store"), "demo")
    values = spark.range(30).selectExpr("if(id % 3 = 0, 'reference', concat('s', id % 3)) sensor_id", "float(id) v")
    arrive(store, 0, "2001-02", values.groupBy("sensor_id").agg(F.kll_sketch_agg_float("v").alias("sketch")))
    assert run_cycle(store, 0, now=1)
    assert plans and not [len(p) for p in plans if "Exchange" in p and len(p) > 100_000]
    assert store.read("overall").selectExpr("x[0]", "element_at(x, -1)").collect() == [(1.0, 29.0)]
