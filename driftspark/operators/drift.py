"""Comparing histograms: alignment by key, the distances, and value-level variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.functions import distances as d
from driftspark.operators.histograms import KEYS, usable, value_ranges
from driftspark.operators.joins import sized_join
from driftspark.session import cut

VALUE_BINS = 1000
DENSITY_FLOOR = 1e-10
REPORTED = ("psi", "pearson_correlation", "euclidean_distance")


def last_per_key(histograms: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of several histograms stored under one key."""
    return histograms.groupBy(*keys).agg(
        F.max_by(F.struct("x", "pmf"), order).alias("h")
    ).select(*keys, "h.x", "h.pmf")


def align(
    current: DataFrame, reference: DataFrame, keys: list[str] = KEYS, how: str = "inner"
) -> DataFrame:
    """Current histograms with their reference; unmatched ones are dropped (``inner``)
    or kept with a NULL reference (``left``). A stored list with a ``pos`` column may
    repeat a key; its last entry wins.
    """
    if "pos" in reference.columns:
        reference = last_per_key(reference, keys, "pos")
    renamed = reference.select(
        *keys, F.col("x").alias("x_ref"), F.col("pmf").alias("pmf_ref")
    )
    extra = [c for c in current.columns if c not in (*keys, "x", "pmf")]
    return current.select(
        *keys, *extra, F.col("x").alias("x_cur"), F.col("pmf").alias("pmf_cur")
    ).join(renamed, keys, how)


def align_sides(
    histograms: DataFrame,
    keys: list[str] = KEYS,
    is_reference: str = "is_reference",
    how: str = "inner",
) -> DataFrame:
    """Same as ``align`` for one table holding both sides: one aggregation, no join, so
    the input behind it is scanned once instead of twice."""
    side = F.struct("x", "pmf")
    paired = histograms.groupBy(*keys).agg(
        F.max(F.when(~F.col(is_reference), side)).alias("cur"),
        F.max(F.when(F.col(is_reference), side)).alias("ref"),
    )
    kept = "cur is not null" if how == "left" else "cur is not null and ref is not null"
    return paired.filter(kept).select(
        *keys,
        F.col("cur.x").alias("x_cur"),
        F.col("cur.pmf").alias("pmf_cur"),
        F.col("ref.x").alias("x_ref"),
        F.col("ref.pmf").alias("pmf_ref"),
    )


def with_common_bins(aligned: DataFrame, grid: bool = True) -> DataFrame:
    """Adds unit edges ``e_cur``/``e_ref`` and the rebinned vectors ``p``/``q``.

    ``grid`` says the edges are equal steps, as all histograms built here are; without
    it arbitrary edges are scaled by their own range.
    """
    scale = d.unit_edges if grid else d.normalize_bins
    edges = aligned.withColumns(
        {"e_cur": F.expr(scale("x_cur")), "e_ref": F.expr(scale("x_ref"))}
    )
    pair = F.expr(d.rebin_pair("pmf_cur", "e_cur", "pmf_ref", "e_ref"))
    return edges.withColumn("_pq", pair).select("*", "_pq.p", "_pq.q").drop("_pq")


def metric_column(name: str, num_buckets: int = 10) -> Column:
    """A registered distance over the columns ``with_common_bins`` adds."""
    if name == "psi":
        return F.expr(d.psi("pmf_cur", "e_cur", "pmf_ref", "e_ref", num_buckets))
    return F.expr(d.BINNED[name]("p", "q"))


def distances(
    aligned: DataFrame,
    names: tuple[str, ...] | list[str],
    keys: list[str] = KEYS,
    grid: bool = True,
) -> DataFrame:
    """One column per named distance."""
    binned = with_common_bins(aligned, grid)
    return binned.select(*keys, *[metric_column(n).alias(n) for n in names])


def distance(aligned: DataFrame, name: str, keys: list[str] = KEYS, grid: bool = True) -> DataFrame:
    return distances(aligned, [name], keys, grid).withColumnRenamed(name, "value")


def distance_report(
    aligned: DataFrame, keys: list[str] = KEYS, grid: bool = True
) -> DataFrame:
    """PSI, Pearson and Euclidean per key; ``degenerate`` marks constant features."""
    binned = with_common_bins(aligned, grid)
    return binned.select(
        *keys,
        metric_column("psi").alias("psi"),
        metric_column("pearson_correlation").alias("pearson"),
        metric_column("euclidean_distance").alias("euclidean"),
        F.expr(f"{d.is_degenerate('e_cur')} or {d.is_degenerate('e_ref')}").alias("degenerate"),
    )


def pmf_error(k: int = 200) -> float:
    """How far a bin of a float sketch of size ``k`` may be off, in 99 cases of 100.

    Fixed values: the constants that the sketch's authors publish for histograms.
    """
    return 2.446 / k**0.9433


def checked_report(
    approximate: DataFrame, exact: DataFrame, keys: list[str] = KEYS, error: float | None = None
) -> DataFrame:
    """``distance_report`` of sketches, checked against the exact one.

    The bins' error becomes a bound for each distance, taken at the exact histograms. A
    distance within its bound is given by its exact value, one beyond it as the sketches have
    it. Both inputs are aligned sides; ``approximate`` decides which keys there are.
    """
    e = repr(pmf_error() if error is None else error) + "D"
    sides = ["pmf_cur", "e_cur", "pmf_ref", "e_ref"]
    found = with_common_bins(exact).select(
        *keys,
        metric_column("psi").alias("psi_exact"),
        metric_column("pearson_correlation").alias("pearson_exact"),
        metric_column("euclidean_distance").alias("euclidean_exact"),
        F.expr(d.psi_error(*sides, e, "1e-7D")).alias("psi_error"),
        F.expr(d.pearson_error("p", "q", e)).alias("pearson_error"),
        F.expr(d.euclidean_error("p", e)).alias("euclidean_error"),
    )

    def settled(name: str) -> Column:
        own, right = F.col(name), F.col(f"{name}_exact")
        near = (F.abs(own - right) <= F.col(f"{name}_error")) | (own.isNull() & right.isNull())
        return F.when(near, right).otherwise(own).alias(name)

    measured = distance_report(approximate, keys).join(found, keys, "left")
    return measured.select(*keys, *map(settled, ("psi", "pearson", "euclidean")), "degenerate")


def rebin_rows(aligned: DataFrame, keys: list[str] = KEYS, grid: bool = True) -> DataFrame:
    """Long form of the common bins: (keys, bin, edge, p, q)."""
    binned = with_common_bins(aligned, grid)
    common = F.expr(d.common_bins("e_cur", "e_ref"))
    zipped = F.arrays_zip(
        F.slice(common, F.lit(1), F.size("p")).alias("edge"), F.col("p"), F.col("q")
    )
    return binned.select(*keys, F.posexplode(zipped).alias("bin", "b")).select(
        *keys, "bin", "b.edge", "b.p", "b.q"
    )


def _is_histogram(node: Column) -> Column:
    """An object with both arrays of a histogram is a leaf of a tree."""
    arrays = [F.try_variant_get(node, f"$.{c}", "array<double>") for c in ("x", "pmf")]
    return arrays[0].isNotNull() & arrays[1].isNotNull()


def flatten_tree(trees: DataFrame, keys: list[str], tree: str = "tree") -> DataFrame:
    """(keys, path, x, pmf): the histograms in a VARIANT column of nested objects, any depth.

    ``path`` lists the names on the way down. Each round opens one level of all trees at once
    and goes on with the objects that are no histogram; what is neither is left out. There are
    as many rounds as the deepest tree has levels.
    """
    spark, found = trees.sparkSession, []
    level = trees.select(*keys, F.array().cast("array<string>").alias("path"), F.col(tree).alias("node"))
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        # Entries of arrays have no name.
        children = cut(
            opened.filter("key is not null").select(
                *keys, F.concat("path", F.array("key")).alias("path"), F.col("value").alias("node")
            )
        )
        leaf = _is_histogram(F.col("node"))
        found.append(
            children.filter(leaf).select(
                *keys,
                "path",
                F.variant_get("node", "$.x", "array<double>").alias("x"),
                F.variant_get("node", "$.pmf", "array<double>").alias("pmf"),
            )
        )
        level = children.filter(~leaf & F.schema_of_variant("node").startswith("OBJECT<"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def distance_by_path(
    current: DataFrame,
    reference: DataFrame,
    name: str,
    keys: list[str] | None = None,
    tree: str = "tree",
    grid: bool = True,
) -> DataFrame:
    """(keys, path, value): a chosen distance wherever both trees of a key hold a histogram at
    the same path. A leaf against a branch, or against nothing, is skipped.
    """
    full = [*(keys or []), "path"]
    flat = [flatten_tree(t, keys or [], tree) for t in (current, reference)]
    return distance(align(*flat, full), name, full, grid)


def psi_of_values(
    observations: DataFrame,
    keys: list[str] = KEYS,
    num_bins: int = VALUE_BINS,
    is_reference: str = "is_reference",
) -> DataFrame:
    """PSI of two value sets: density histograms on each side's own range, compared by
    bin position. Bins empty on both sides contribute nothing, so only the filled ones
    are ever materialized.

    A value is placed by division and then moved to the bin whose edges enclose it, the top
    bin being closed: division alone is off by one where values lie on edges.
    """
    sides = [*keys, is_reference]
    flat = F.col("low") == F.col("high")
    low = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    ranges = cut(
        value_ranges(observations, sides).select(*sides, "n_obs", low.alias("low"), high.alias("high"))
    )
    rows = ranges.count()
    step = (F.col("high") - F.col("low")) / num_bins

    def edge(i: Column) -> Column:
        return F.when(i == num_bins, F.col("high")).otherwise(F.col("low") + i * step)

    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    near = F.least(F.lit(num_bins - 1).cast("long"), F.floor(share * num_bins))
    b = F.col("near")
    bin_ = (
        F.when(F.col("value") < edge(b), b - 1)
        .when((b < num_bins - 1) & (F.col("value") >= edge(b + 1)), b + 1)
        .otherwise(b)
    )
    counts = (
        sized_join(usable(observations), ranges.drop("n_obs"), sides, rows=rows)
        .withColumn("near", near)
        .withColumn("bin", bin_)
        .groupBy(*sides, "bin")
        .agg(F.count("value").alias("hits"))
    )
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    density = F.col("hits") / (F.col("n_obs") * width)
    filled = sized_join(counts, ranges, sides, rows=rows).withColumn("density", density)
    clip = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(DENSITY_FLOOR))
    paired = filled.groupBy(*keys, "bin").agg(
        clip(F.max(F.when(~F.col(is_reference), F.col("density")))).alias("p"),
        clip(F.max(F.when(F.col(is_reference), F.col("density")))).alias("q"),
        F.max(~F.col(is_reference)).alias("has_cur"),
        F.max(F.col(is_reference)).alias("has_ref"),
    )
    return (
        paired.groupBy(*keys)
        .agg(
            F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("value"),
            (F.max("has_cur") & F.max("has_ref")).alias("both"),
        )
        .filter("both")
        .drop("both")
    )


def vector_distance(current: str, reference: str) -> Column:
    """Distance of two array columns within the row; NULL where their lengths differ."""
    whole = f"CASE WHEN size({current}) = size({reference}) THEN "
    return F.expr(whole + d.euclidean_distance(current, reference) + " END")


def euclidean_of_values(
    current: DataFrame, reference: DataFrame, keys: list[str], position: str = "pos"
) -> DataFrame:
    """Distance of two vectors given as (keys, position, value) rows, for vectors too long to
    be arrays; ``vector_distance`` needs no shuffle.

    Keys absent from ``reference`` columns are shared: one reference vector then serves
    every key. NULL where the vectors have different positions.
    """
    full = [*keys, position]
    shared = [k for k in full if k in reference.columns]
    size = F.count("*").over(Window.partitionBy(*[k for k in shared if k != position]))
    renamed = reference.select(*shared, F.col("value").alias("_ref"), size.alias("_size"))
    joined = (
        current.join(renamed, full, "left")
        if shared == full
        else sized_join(current, cut(renamed), shared, "left")
    )
    gap = F.col("value") - F.col("_ref")
    same_size = (F.count("*") == F.count("_size")) & (F.count("*") == F.max("_size"))
    return (
        joined.groupBy(*keys)
        .agg(F.when(same_size, F.sqrt(F.sum(gap * gap))).alias("value"))
    )
