"""One aggregation cycle as a single declarative plan, and its nested document form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from driftspark.operators import drift, histograms, selection
from driftspark.operators.joins import sized_join, with_parts

SIDE_KEYS = ["is_reference", *histograms.KEYS]
VERSION = ["project_id", "last_updated", "cycle"]
DOCUMENT_HISTOGRAMS = 10_000


def choose_snapshots(snapshots: DataFrame, consumed: DataFrame) -> DataFrame:
    """Snapshots entering a cycle: each sensor's newest waiting one, and the baseline."""
    keys = selection.SNAPSHOT_KEYS
    newest = selection.latest_per_sensor(selection.unconsumed(snapshots, consumed))
    baseline = selection.latest_reference(snapshots)
    return newest.select(*keys, F.lit(False).alias("is_reference")).unionByName(
        baseline.select(*keys, F.lit(True).alias("is_reference"))
    )


def from_sketches(sketches: DataFrame) -> DataFrame:
    merged = histograms.merge_sketches(sketches, SIDE_KEYS)
    return histograms.sketch_histograms(merged, SIDE_KEYS)


def from_values(observations: DataFrame) -> DataFrame:
    return histograms.exact_histograms(observations, SIDE_KEYS)


def from_single_values(observations: DataFrame) -> DataFrame:
    """What float sketches of the values estimate."""
    return histograms.exact_histograms(observations, SIDE_KEYS, single_precision=True)


def cycle_histograms(
    chosen: DataFrame,
    payload: DataFrame,
    histogram: Callable[[DataFrame], DataFrame] = from_sketches,
) -> DataFrame:
    """Histograms of both sides. ``chosen`` must be cheap to count."""
    rows = sized_join(payload, chosen, selection.SNAPSHOT_KEYS)
    return histogram(rows)


def cycle_results(both_sides: DataFrame, project_id: str, last_updated: int, cycle: int) -> DataFrame:
    """Flat result rows: current histograms, and distances where a baseline exists."""
    paired = drift.align_sides(both_sides, how="left")
    binned = drift.with_common_bins(paired)
    reported = F.when(
        F.col("x_ref").isNotNull(),
        F.struct(
            drift.metric_column("psi").alias("PSI"),
            drift.metric_column("pearson_correlation").alias("Pearson"),
            drift.metric_column("euclidean_distance").alias("Euclidean"),
        ),
    )
    return binned.select(
        F.lit(project_id).alias("project_id"),
        F.lit(last_updated).cast("long").alias("last_updated"),
        F.lit(cycle).cast("long").alias("cycle"),
        *histograms.KEYS,
        F.col("x_cur").alias("x"),
        F.col("pmf_cur").alias("pmf"),
        reported.alias("distances"),
    )


def reference_results(
    both_sides: DataFrame, project_id: str, last_updated: int, cycle: int
) -> DataFrame:
    return both_sides.filter("is_reference").select(
        F.lit(project_id).alias("project_id"),
        F.lit(last_updated).cast("long").alias("last_updated"),
        F.lit(cycle).cast("long").alias("cycle"),
        *histograms.KEYS,
        "x",
        "pmf",
    )


def assemble_overall(results: DataFrame, max_histograms: int = DOCUMENT_HISTOGRAMS) -> DataFrame:
    """Result rows nested into documents, one per project and cycle.

    A cycle with more than about ``max_histograms`` histograms continues in further
    documents (``part`` 1, 2, ...), so no row grows without bound.
    """
    rows = with_parts(results, VERSION, ["metric", "submetric"], max_histograms)
    nested = [
        F.array_sort(F.collect_list(F.struct("metric", "submetric", "pmf", "x"))).alias(
            "histograms"
        )
    ]
    if "distances" in results.columns:
        matched = F.when(
            F.col("distances").isNotNull(), F.struct("metric", "submetric", "distances")
        )
        nested.append(F.array_sort(F.collect_list(matched)).alias("distance"))
    return rows.groupBy(*VERSION, "part").agg(*nested)
