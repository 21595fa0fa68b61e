"""Distances and rebinning against brute force in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftspark.functions import distances as d
from driftspark.operators import drift

N = 30
rng = np.random.default_rng(7)


def grid(low, high, n=N):
    step = (high - low) / n or 0.01
    return [float(low + i * step) for i in range(n)] + [float(high)]


def random_pmf(n=N):
    counts = rng.integers(0, 9, n).astype(float)
    counts[0] += 1
    return [0.0, *(counts / counts.sum()).tolist()]


def scaled(x, n_digits=12):
    x = np.array(x)
    return np.round((x - x.min()) / (x.max() - x.min()), n_digits)


def brute_rebin(hist, edges, common):
    """Mass of bin i goes, undivided, to all common bins between its two edges."""
    out = np.zeros(len(common) - 1)
    for j, start in enumerate(common[:-1]):
        for i in range(len(edges) - 1):
            if edges[i] <= start < edges[i + 1]:
                out[j] += hist[i]
    return out


def brute_ranks(v):
    return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])


def brute_corr(p, q):
    if np.all(p == p[0]) or np.all(q == q[0]):
        return None
    return float(np.corrcoef(p, q)[0, 1])


def entropy(p, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p == 0, 0.0, p * np.log(p / q))
    return float(terms.sum())


def brute(name, p, q):
    pn, qn = p / p.sum(), q / q.sum()
    m = (pn + qn) / 2
    return {
        "euclidean_distance": lambda: float(np.sqrt(((p - q) ** 2).sum())),
        "manhattan_distance": lambda: float(np.abs(p - q).sum()),
        "cosine_similarity": lambda: float(p @ q / np.sqrt((p @ p) * (q @ q))),
        "pearson_correlation": lambda: brute_corr(p, q),
        "spearman_rank_correlation": lambda: brute_corr(brute_ranks(p), brute_ranks(q)),
        "jensen_shannon_divergence": lambda: math.sqrt(max(0, entropy(pn, m) + entropy(qn, m)) / 2),
        "kullback_leibler_divergence": lambda: entropy(pn, qn),
        "hellinger_distance": lambda: float(
            np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum()) / np.sqrt(2)
        ),
        "wasserstein_distance": lambda: float(np.abs(np.sort(p) - np.sort(q)).mean()),
    }[name]()


def brute_psi(h1, h2, buckets=10):
    k = np.linspace(0, 1, buckets + 1)
    a = np.interp(k, np.arange(len(h1)) / (len(h1) - 1), h1)
    b = np.interp(k, np.arange(len(h2)) / (len(h2) - 1), h2)
    a, b = np.where(a < 1e-15, 1e-4, a), np.where(b < 1e-15, 1e-4, b)
    return float(((a - b) * np.log(a / b)).sum())


def measure(spark, pairs, grid=True):
    rows = [(i, *map(lambda v: [float(e) for e in v], pair)) for i, pair in enumerate(pairs)]
    schema = (
        "id int, x_cur array<double>, pmf_cur array<double>, "
        "x_ref array<double>, pmf_ref array<double>"
    )
    df = spark.createDataFrame(rows, schema)
    names = d.available_metrics()
    out = drift.distances(df, names, ["id"], grid)
    return [r.asDict() for r in out.orderBy("id").collect()]


def close(a, b):
    if a is None or b is None:
        return a is b
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_ten_metrics_are_listed():
    assert d.available_metrics() == [
        "euclidean_distance",
        "manhattan_distance",
        "cosine_similarity",
        "pearson_correlation",
        "spearman_rank_correlation",
        "jensen_shannon_divergence",
        "kullback_leibler_divergence",
        "hellinger_distance",
        "wasserstein_distance",
        "psi",
    ]


def test_equal_grids_compare_bin_by_bin(spark):
    pairs = [(grid(0, 7), random_pmf(), grid(-3, 900.5), random_pmf()) for _ in range(20)]
    for found, (_, h1, _, h2) in zip(measure(spark, pairs), pairs):
        p, q = np.array(h1[:-1]), np.array(h2[:-1])
        for name in d.BINNED:
            assert close(found[name], brute(name, p, q)), name
        assert close(found["psi"], brute_psi(h1, h2))


def test_different_grids_are_rebinned(spark):
    pairs = [(grid(0, 1), random_pmf(), grid(5, 6, n), random_pmf(n)) for n in (10, 24, 29, 45)]
    for found, (x1, h1, x2, h2) in zip(measure(spark, pairs), pairs):
        e1, e2 = scaled(x1), scaled(x2)
        common = np.union1d(e1, e2)
        p, q = brute_rebin(h1, e1, common), brute_rebin(h2, e2, common)
        for name in d.BINNED:
            assert close(found[name], brute(name, p, q)), name
        assert close(found["psi"], brute_psi(h1, h2))


def test_arbitrary_edges(spark):
    x1, x2 = [0.0, 1.0, 4.0, 10.0], [2.0, 3.0, 3.5, 8.0, 12.0]
    h1, h2 = [0.1, 0.4, 0.3, 0.2], [0.2, 0.2, 0.3, 0.1, 0.2]
    found = measure(spark, [(x1, h1, x2, h2)], grid=False)[0]
    common = np.union1d(scaled(x1), scaled(x2))
    p, q = brute_rebin(h1, scaled(x1), common), brute_rebin(h2, scaled(x2), common)
    for name in d.BINNED:
        assert close(found[name], brute(name, p, q)), name
    k = np.linspace(0, 1, 11)
    a, b = np.interp(k, scaled(x1), h1), np.interp(k, scaled(x2), h2)
    assert close(found["psi"], float(((a - b) * np.log(a / b)).sum()))


def test_constant_feature(spark):
    constant = (grid(5, 5), [0.0, 1.0] + [0.0] * 29)
    usual = (grid(0, 10), random_pmf())
    frame = spark.createDataFrame(
        [(constant[0], constant[1], *map(list, usual))],
        "x_cur array<double>, pmf_cur array<double>, x_ref array<double>, pmf_ref array<double>",
    )
    found = drift.distance_report(frame, []).first()
    assert found["degenerate"] and found["psi"] is None
    binned = drift.with_common_bins(frame).select("p", "q").first()
    # 29 and 30 steps share only both ends; the unit mass lands in two of 58 bins.
    assert len(binned["p"]) == 58 and sum(binned["p"]) == 2.0
    both = spark.createDataFrame([constant + constant], frame.schema)
    same = drift.distance_report(both, []).first()
    assert (same["euclidean"], same["psi"], same["degenerate"]) == (0.0, None, True)


def test_undefined_and_infinite(spark):
    flat = [1 / 31] * 31
    half = [0.5, 0.5] + [0.0] * 29
    found = measure(spark, [(grid(0, 1), flat, grid(0, 1), half)] * 1)[0]
    assert found["pearson_correlation"] is None
    assert found["spearman_rank_correlation"] is None
    assert found["kullback_leibler_divergence"] == math.inf
    zero = measure(spark, [(grid(0, 1), [0.0] * 31, grid(0, 1), half)])[0]
    assert zero["cosine_similarity"] is None
    assert zero["jensen_shannon_divergence"] is None


@settings(max_examples=15, deadline=None)
@given(
    counts=st.lists(st.integers(0, 50), min_size=N, max_size=N).filter(lambda c: len(set(c)) > 1),
    shift=st.floats(-1e6, 1e6),
    scale=st.floats(1e-3, 1e3),
)
def test_identity_symmetry_and_scale_blindness(spark, counts, shift, scale):
    total = sum(counts)
    pmf = [0.0, *(c / total for c in counts)]
    other = random_pmf()
    x, moved = grid(0, 1), grid(shift, shift + scale)
    same, ab, ba, far = measure(
        spark, [(x, pmf, x, pmf), (x, pmf, x, other), (x, other, x, pmf), (moved, pmf, x, other)]
    )
    for name in ("euclidean", "manhattan", "hellinger", "wasserstein"):
        assert same[f"{name}_distance"] == 0
        assert close(ab[f"{name}_distance"], ba[f"{name}_distance"])
    assert same["psi"] == 0 and close(ab["psi"], ba["psi"])
    assert close(same["cosine_similarity"], 1.0)
    if len(set(pmf[:-1])) > 1:
        assert close(same["pearson_correlation"], 1.0)
    assert all(close(ab[n], far[n]) for n in d.available_metrics())


def test_align_drops_unmatched_and_last_reference_wins(spark):
    schema = "metric string, submetric string, pos int, x array<double>, pmf array<double>"
    x = grid(0, 1)
    one, two, three = (random_pmf() for _ in range(3))
    current = spark.createDataFrame([("a", "", 0, x, one), ("b", "", 1, x, one)], schema).drop("pos")
    reference = spark.createDataFrame(
        [("a", "", 0, x, two), ("a", "", 1, x, three), ("c", "", 2, x, two)], schema
    )
    rows = drift.align(current, reference).collect()
    assert [(r["metric"], r["pmf_ref"]) for r in rows] == [("a", three)]
    kept = drift.align(current, reference, how="left").filter(F.col("x_ref").isNull())
    assert [r["metric"] for r in kept.collect()] == ["b"]


@pytest.mark.parametrize("shared", [True, False])
def test_euclidean_of_values(spark, shared):
    a, b = rng.normal(size=(3, 8)), rng.normal(size=(3, 8))
    rows = [(k, i, float(a[k, i])) for k in range(3) for i in range(8)]
    current = spark.createDataFrame(rows, "id int, pos int, value double")
    if shared:
        ref = spark.createDataFrame([(i, float(b[0, i])) for i in range(8)], "pos int, value double")
        expected = np.linalg.norm(a - b[0], axis=1)
    else:
        rows = [(k, i, float(b[k, i])) for k in range(3) for i in range(8)]
        ref = spark.createDataFrame(rows, "id int, pos int, value double")
        expected = np.linalg.norm(a - b, axis=1)
    found = drift.euclidean_of_values(current, ref, ["id"]).orderBy("id").collect()
    assert np.allclose([r["value"] for r in found], expected)


def test_psi_of_values_on_uneven_and_constant_sides(spark):
    a, b = rng.normal(size=500), np.full(50, 3.0)
    rows = [("m", False, float(v)) for v in a] + [("m", True, float(v)) for v in b]
    rows += [("lonely", False, 1.0)]
    df = spark.createDataFrame(rows, "metric string, is_reference boolean, value double")
    found = drift.psi_of_values(df, ["metric"], num_bins=100).collect()
    p = np.clip(np.histogram(a, bins=100, density=True)[0], 1e-10, None)
    q = np.clip(np.histogram(b, bins=100, density=True)[0], 1e-10, None)
    assert [r["metric"] for r in found] == ["m"]
    assert math.isclose(found[0]["value"], ((p - q) * np.log(p / q)).sum(), rel_tol=1e-9)
