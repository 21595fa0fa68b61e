"""Histograms of sketches, rebinning, value PSI and the tree walk against plain versions."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions import distances as d
from driftspark.functions import sketches as sk
from driftspark.operators import drift, histograms as h


def sketched(spark, values):
    df = spark.createDataFrame([("m", "", float(v)) for v in values], "metric string, submetric string, value double")
    return h.build_sketches(df.repartition(1), h.KEYS)


def float_histogram(values, splits=30):
    """What a float sketch of all values would count: single-precision values and splits."""
    v = np.asarray(values, np.float32).astype(float)
    low, high = v.min(), v.max()
    step = (high - low) / splits if high > low else 0.01
    starts = (low + np.arange(splits) * step).astype(np.float32).astype(float)
    bins = np.clip(np.searchsorted(starts, v, side="right"), 1, splits)
    return np.bincount(bins, minlength=splits + 1) / len(v)


@pytest.mark.parametrize("n", [1, 2, 7, 31, 60, 199])
def test_small_sketches_are_exact(spark, n):
    """A sketch of few values holds them all, and none of them is rounded to a probe."""
    values = np.random.default_rng(n).gamma(2.0, 3.0, n)
    row = h.sketch_histograms(sketched(spark, values)).first()
    assert np.abs(np.array(row.pmf) - float_histogram(values)).max() < 1e-12
    assert sum(row.pmf) == pytest.approx(1, abs=1e-12)


def test_no_bin_of_a_large_sketch_is_lost(spark):
    """At 100,000 values every bin in which the sketch itself holds a value has mass."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 99_960), rng.uniform(-60, 60, 40)])
    # Sketching is random, so one sketch is kept.
    made = sketched(spark, values).first()
    sketch = spark.createDataFrame([tuple(made)], "metric string, submetric string, sketch binary")
    row = h.sketch_histograms(sketch).first()
    # All it holds: more probes than values, straight from the sketch.
    held = sketch.selectExpr(f"kll_sketch_get_quantile_float(sketch, {sk.mid_ranks(500_000)}) q").first().q
    own = np.array(held, float)
    low, high = row.x[0], row.x[-1]
    starts = (low + np.arange(30) * (high - low) / 30).astype(np.float32).astype(float)
    bins = np.clip(np.searchsorted(starts, own, side="right"), 1, 30)
    share = np.bincount(bins, minlength=31) / len(own)
    assert (np.array(row.pmf) > 0).tolist() == (share > 0).tolist()
    assert np.abs(np.array(row.pmf) - share).max() < 1e-5


@pytest.mark.parametrize("probes", [1_000, 20_000, 200_000])
def test_mid_ranks(spark, probes):
    ranks = spark.range(1).selectExpr(f"{sk.mid_ranks(probes)} r").first().r
    assert np.abs(np.array(ranks) - (np.arange(probes) + 0.5) / probes).max() < 1e-15


def plain_rebin(hist, edges, common):
    return [
        sum(hist[i] for i in range(len(edges) - 1) if edges[i] <= start < edges[i + 1]) for start in common[:-1]
    ]


@pytest.mark.parametrize("kind", ["grid", "uneven", "constant", "falling", "ties", "two"])
def test_rebin(spark, kind):
    rng = np.random.default_rng(3)
    edges = {
        "grid": np.arange(31) / 30,
        "uneven": np.sort(rng.random(40)),
        "constant": np.append(np.arange(30) / 29, 0.0),
        "falling": rng.random(12),
        "ties": np.sort(rng.integers(0, 8, 25) / 8.0),
        "two": np.array([0.25, 0.75]),
    }[kind].tolist()
    other = np.sort(rng.random(17)).tolist()
    hist = rng.random(len(edges)).tolist()
    common = sorted({*edges, *other})
    df = spark.createDataFrame([(hist, edges, common)], "h array<double>, e array<double>, c array<double>")
    found = df.selectExpr(d.rebin("h", "e", "c") + " r").first().r
    assert found == pytest.approx(plain_rebin(hist, edges, common), abs=1e-12)


def test_rebin_of_a_thousand_bins_is_quick(spark):
    """A thousand pairs of thousand-bin histograms; every edge against every bin took minutes."""
    n = 1000
    rows = [(i,) for i in range(200)]
    df = spark.createDataFrame(rows, "i int").selectExpr(
        f"transform(sequence(0, {n}), k -> k / {n}D) e",
        f"transform(sequence(0, {n - 1}), k -> k / {n - 1}D) f",
        f"transform(sequence(0, {n}), k -> double((k * 7 + i) % 11)) h",
    )
    start = time.time()
    out = df.selectExpr(d.rebin("h", "e", d.common_bins("e", "f")) + " r").selectExpr("size(r) n", "r").collect()
    assert time.time() - start < 60
    edges = [k / n for k in range(n + 1)]
    common = sorted({*edges, *(k / (n - 1) for k in range(n))})
    assert out[3].r[:50] == plain_rebin([float((k * 7 + 3) % 11) for k in range(n + 1)], edges, common[:51])


def numpy_psi(current, reference, bins):
    p, q = (np.clip(np.histogram(v, bins=bins, density=True)[0], 1e-10, None) for v in (current, reference))
    return float(((p - q) * np.log(p / q)).sum())


@pytest.mark.parametrize("bins", [10, 70, 1000])
def test_psi_of_discrete_values_equals_numpy(spark, bins):
    """Values that lie on the edges of bins, where division alone is off by one."""
    rng = np.random.default_rng(bins)
    sets = {
        "cents": (rng.integers(0, 11, 4000) / 100, rng.integers(0, 11, 3000) / 100),
        "tenths": (rng.integers(0, 71, 4000) / 10, rng.integers(3, 64, 3000) / 10),
        "thirds": (rng.integers(0, 31, 2000) / 3, rng.integers(0, 13, 2000) / 3),
        "prices": (np.round(rng.gamma(2, 400, 3000), 2), np.round(rng.gamma(2, 420, 3000), 2)),
        "constant": (np.full(50, 2.5), rng.integers(0, 5, 100).astype(float)),
    }
    rows = [(m, "", s, float(v)) for m, pair in sets.items() for s, vs in zip((False, True), pair) for v in vs]
    df = spark.createDataFrame(rows, "metric string, submetric string, is_reference boolean, value double")
    found = {r.metric: r.value for r in drift.psi_of_values(df, num_bins=bins).collect()}
    for m, pair in sets.items():
        assert found[m] == pytest.approx(numpy_psi(*pair, bins), rel=1e-9, abs=1e-12), m


def trees(spark, **by_key):
    rows = [(k, json.dumps(v)) for k, v in by_key.items()]
    df = spark.createDataFrame(rows, "k string, j string")
    return df.select("k", F.parse_json("j").alias("tree"))


def test_walk_of_nested_trees(spark):
    """Leaves at any depth; a leaf against a branch, a number or nothing is skipped."""
    leaf = lambda s: {"x": [float(i) for i in range(31)], "pmf": [0.0] + [s / 30] * 30, "n": 3}
    current = {
        "a": {"b": {"c": leaf(1), "only": leaf(1)}, "leaf": leaf(1)},
        "top": leaf(1),
        "mixed": leaf(1),
        "branch": {"x": {"y": leaf(1)}},
        "number": {"z": leaf(1)},
        "list": [leaf(1)],
        "dotted.name": {"a/b": leaf(1)},
    }
    reference = {
        "a": {"b": {"c": leaf(4)}, "leaf": {"deeper": leaf(1)}},
        "top": leaf(1),
        "mixed": {"inner": leaf(1)},
        "branch": {"x": {"y": leaf(9)}, "z": 1},
        "number": 7,
        "list": [leaf(1)],
        "dotted.name": {"a/b": leaf(4)},
    }
    a, b = trees(spark, one=current, two={"q": leaf(1)}, empty={}), trees(spark, one=reference, two={"q": None})
    flat = {(r.k, tuple(r.path)) for r in drift.flatten_tree(a, ["k"]).collect()}
    assert ("one", ("a", "b", "c")) in flat and ("two", ("q",)) in flat and len(flat) == 9
    found = {tuple(r.path): r.value for r in drift.distance_by_path(a, b, "manhattan_distance", ["k"]).collect()}
    assert set(found) == {("a", "b", "c"), ("top",), ("branch", "x", "y"), ("dotted.name", "a/b")}
    assert found["top",] == 0 and found["a", "b", "c"] == pytest.approx(29 * 3 / 30)
    assert drift.distance_by_path(a.limit(0), b, "psi", ["k"]).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_for_every_histogram_within_the_error(spark, seed):
    """Distances of histograms moved by at most e in each bin stay within the bounds."""
    rng, e, x = np.random.default_rng(seed), 0.004, [float(i) for i in range(31)]
    schema = "metric string, submetric string, x_cur array<double>, pmf_cur array<double>, x_ref array<double>, pmf_ref array<double>"
    exact, moved = [], []
    for i in range(60):
        sides = [np.concatenate([[0.0], rng.dirichlet(np.full(30, rng.choice([0.3, 1, 20])))]) for _ in range(2)]
        near = [np.clip(s + rng.uniform(-e, e, 31) * (rng.random(31) < 0.8), 0, None) for s in sides]
        for rows, (p, q) in ((exact, sides), (moved, near)):
            rows.append((f"m{i}", "", x, p.tolist(), x, q.tolist()))
    exact, moved = spark.createDataFrame(exact, schema), spark.createDataFrame(moved, schema)
    right = {r.metric: tuple(r)[2:] for r in drift.distance_report(exact).collect()}
    found = {r.metric: tuple(r)[2:] for r in drift.checked_report(moved, exact, error=e).collect()}
    assert found == right


def test_a_distance_beyond_its_bound_shows(spark):
    x = [float(i) for i in range(31)]
    schema = "metric string, submetric string, x_cur array<double>, pmf_cur array<double>, x_ref array<double>, pmf_ref array<double>"
    even, steep = [0.0] + [1 / 30] * 30, [0.0, 0.5] + [0.5 / 29] * 29
    exact = spark.createDataFrame([("m", "", x, even, x, even)], schema)
    wrong = spark.createDataFrame([("m", "", x, steep, x, even)], schema)
    own, found = drift.distance_report(wrong).first(), drift.checked_report(wrong, exact, error=0.001).first()
    assert (found.psi, found.euclidean) == (own.psi, own.euclidean) and found.euclidean > 0.4


def test_vector_distance(spark):
    rows = [([3.0, 4.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.d for r in df.select(drift.vector_distance("a", "b").alias("d")).collect()] == [5.0, None, 0.0]
