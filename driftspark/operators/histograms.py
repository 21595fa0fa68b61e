"""Fixed-resolution histograms, from KLL sketches or exactly from values.

A histogram row is (keys, n_obs, x, pmf): ``x`` holds num_splits split points and the
maximum, ``pmf`` one value per entry of ``x`` with pmf[0] (below the minimum) = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftspark.functions import sketches as sk
from driftspark.functions.names import is_sketch_file, split_name
from driftspark.operators.joins import BROADCAST_ROWS, sized_join
from driftspark.session import cut

KEYS = ["metric", "submetric"]
NUM_SPLITS = 30
# Probes by the number of values: more than two for each of them up to 100,000 values, so that
# every value a sketch holds is met; beyond, what weighs less than a probe may be missed.
PROBES = [(500, 1_000), (10_000, 20_000), (None, 200_000)]
SPREAD = 32


# --- exact mode -----------------------------------------------------------------------


def usable(observations: DataFrame) -> DataFrame:
    """Rows a sketch would count: NULL and NaN values are ignored."""
    return observations.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_ranges(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, maximum and count per key; keys with an infinite range are left out."""
    return (
        usable(observations)
        .groupBy(*keys)
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("value").alias("n_obs"),
        )
        .filter(F.col("high") - F.col("low") < float("inf"))
    )


def exact_histograms(
    observations: DataFrame,
    keys: list[str] = KEYS,
    num_splits: sk.Splits = NUM_SPLITS,
    broadcast_rows: int = BROADCAST_ROWS,
    single_precision: bool = False,
) -> DataFrame:
    """Histograms counted from the values. ``single_precision`` bins them the way a float
    sketch of them would be binned. ``num_splits`` may be an expression over the keys.

    Two scans of the input in all: one aggregated map-side into the small range table,
    one joined with it and counted map-side.
    """
    if single_precision:
        observations = observations.withColumn("value", F.col("value").cast("float").cast("double"))
    ranges = cut(value_ranges(observations, keys))
    known = {"broadcast_rows": broadcast_rows, "rows": ranges.count()}
    limits = ranges.select(*keys, "low", "high")
    binned = sized_join(usable(observations), limits, keys, **known).withColumn(
        "bin", F.expr(sk.grid_bin("value", "low", "high", num_splits))
    )
    if single_precision:
        settled = sk.settle_single("bin", "value", "low", "high", num_splits)
        binned = binned.withColumn("bin", F.expr(settled))
    counts = binned.groupBy(*keys, "bin").agg(F.count("value").alias("hits"))
    # At most num_splits entries per key reach this second aggregation.
    per_key = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "hits"))).alias("hits")
    )
    pmf = f"transform(sequence(0, {num_splits}), i -> coalesce(try_element_at(hits, i), 0) / n_obs)"
    return sized_join(per_key, ranges, keys, **known).select(
        *keys,
        "n_obs",
        F.expr(sk.grid_edges("low", "high", num_splits)).alias("x"),
        F.expr(pmf).alias("pmf"),
    )


# --- sketch mode ----------------------------------------------------------------------


def build_sketches(observations: DataFrame, keys: list[str], k: int = 200) -> DataFrame:
    """One KLL float sketch per key; stands in for what sensors send."""
    value = F.col("value").cast("float")
    return (
        usable(observations)
        .groupBy(*keys)
        .agg(F.kll_sketch_agg_float(value, F.lit(k)).alias("sketch"))
    )


def pooled_sketches(
    observations: DataFrame, keys: list[str] = KEYS, k: int = 200, spread: int = SPREAD
) -> DataFrame:
    """One sketch per key over all sensors, straight from values in a single scan.

    Tasks sketch what they scan; the salt bounds how many sketches of a hot key meet.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(spread))
    parts = build_sketches(observations.withColumn("_salt", salt), [*keys, "_salt"], k)
    return parts.groupBy(*keys).agg(F.kll_merge_agg_float("sketch").alias("sketch"))


def gather_sketches(snapshots: DataFrame) -> DataFrame:
    """Sketch references of nested snapshot documents, one row each.

    The metric names come from the file name again; the metric family is dropped, so
    equal names of different families merge.
    """
    listed = (
        snapshots.select("sensor_id", "timestamp", F.inline("type"))
        .select("sensor_id", "timestamp", F.inline("stats"))
        .select("sensor_id", "timestamp", "path")
        .withColumn("file_name", F.substring_index("path", "/", -1))
        .filter(is_sketch_file(F.col("file_name")))
    )
    metric, submetric = split_name(F.col("file_name"))
    return listed.select(
        "sensor_id", "timestamp", metric.alias("metric"), submetric.alias("submetric"), "path"
    )


def merge_sketches(
    sketches: DataFrame, keys: list[str] = KEYS, spread: int = SPREAD
) -> DataFrame:
    """Merge all sketches of a key.

    Merging happens within each scan task, then per (key, salt), then per key: a key
    every sensor reports still ends in one task with at most ``spread`` sketches. The
    salt is the task's own number, so it adds no groups to the first step.
    """
    return (
        sketches.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
        .groupBy(*keys, "_salt")
        .agg(F.kll_merge_agg_float("sketch").alias("sketch"))
        .groupBy(*keys)
        .agg(F.kll_merge_agg_float("sketch").alias("sketch"))
    )


def sketch_histograms(
    merged: DataFrame,
    keys: list[str] = KEYS,
    num_splits: int = NUM_SPLITS,
    probes: list[tuple[int | None, int]] = PROBES,
) -> DataFrame:
    """Histogram of each merged sketch; empty sketches give no row.

    Rank queries take constant arguments only, so the mass of a bin is the share of evenly
    spaced quantiles that fall into it, settled to whole values where there are probes enough
    for each. No shuffle.
    """
    read = merged.select(
        *keys,
        F.expr(sk.sketch_count("sketch")).alias("n_obs"),
        F.expr(sk.sketch_quantiles("sketch", probes)).alias("quantiles"),
    ).filter("n_obs > 0")
    return (
        read.select(*keys, "n_obs", F.expr(sk.sketch_shape("quantiles", "n_obs", num_splits)).alias("h"))
        .filter("h is not null")
        .select(*keys, "n_obs", "h.x", "h.pmf")
    )


def histogram_rows(histograms: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Long form: one row per (keys, bin)."""
    return histograms.select(
        *keys, F.posexplode(F.arrays_zip("x", "pmf")).alias("bin", "h")
    ).select(*keys, "bin", "h.x", F.col("h.pmf").alias("p"))
