"""Read queries over result tables and sample listings. Nesting counts its groups at once;
everything else stays lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftspark.functions.names import url_timestamp
from driftspark.operators.joins import with_parts

VERSION = ["last_updated", "cycle"]
DOCUMENT_URLS = 100_000


def flatten_overall(documents: DataFrame) -> DataFrame:
    """Nested result documents as one row per histogram, ``pos`` keeping their order.

    A document that goes on in several parts has no order across them: ``part`` is kept, and
    tells readers that ``pos`` counts within it.
    """
    keyed = documents
    if "cycle" not in documents.columns:
        keyed = documents.withColumn("cycle", F.col("last_updated"))
    part = [c for c in ("part",) if c in documents.columns]
    rows = keyed.select("project_id", *VERSION, *part, F.posexplode("histograms").alias("pos", "h"))
    flat = rows.select(
        "project_id", *VERSION, *part, "pos", "h.metric", "h.submetric", "h.x", "h.pmf"
    )
    if "distance" not in documents.columns:
        return flat
    dist = keyed.select("project_id", *VERSION, F.inline("distance"))
    return flat.join(dist, ["project_id", *VERSION, "metric", "submetric"], "left")


def metric_stats(
    results: DataFrame,
    project_id: str,
    metric: str,
    submetric: str | None = None,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """The metric's histogram in the project's newest result: one row or none.

    ``cycles`` is the header table (one row per cycle); without it the newest cycle is
    found from the result rows.
    """
    of_project = F.col("project_id") == project_id
    headers = (cycles if cycles is not None else results).filter(of_project)
    newest = headers.agg(F.max(F.struct(*VERSION)).alias("v")).select("v.*")
    wanted = of_project & (F.col("metric") == metric)
    if submetric is not None:
        wanted = wanted & (F.col("submetric") == submetric)
    # ``newest`` is a single row.
    hits = results.filter(wanted).join(F.broadcast(newest), VERSION, "left_semi")
    order = ["pos"] if "pos" in results.columns and "part" not in results.columns else []
    return hits.orderBy(*order, "submetric").limit(1).select("metric", "submetric", "pmf", "x")


def metric_distances(results: DataFrame, project_id: str) -> DataFrame:
    """Distances of every cycle of a project, oldest first."""
    kept = results.filter(
        (F.col("project_id") == project_id)
        & (F.col("last_updated") != 0)
        & F.col("distances").isNotNull()
    )
    return kept.select(
        "project_id",
        F.col("last_updated").cast("string").alias("timestamp"),
        "metric",
        "submetric",
        "distances.PSI",
        "distances.Pearson",
        "distances.Euclidean",
        "last_updated",
    ).orderBy("last_updated", "metric", "submetric").drop("last_updated")


def explode_samples(documents: DataFrame) -> DataFrame:
    """Nested sample documents as one row per url, with the time named in the url."""
    keys = ["project_name", "sensor_id", "timestamp", "status"]
    return (
        documents.select(*keys, F.inline("type"))
        .select(*keys, "metrictype", F.inline("data"))
        .select(*keys, "metrictype", "metric", "submetric", F.explode("data").alias("url"))
        .withColumn("url_timestamp", url_timestamp(F.col("url")))
    )


def project_data(
    samples: DataFrame,
    project_name: str,
    metrictype: str | None = None,
    metric: str | None = None,
    submetric: str | None = None,
    timestamp: str | None = None,
    sensor_id: str | None = None,
) -> DataFrame:
    """Filtered sample rows (flat) with the project's status from its first document.

    An argument left out does not filter. Empty when nothing matches.
    """
    docs = samples.filter(F.col("project_name") == project_name)
    for name, value in {"timestamp": timestamp, "sensor_id": sensor_id}.items():
        if value:
            docs = docs.filter(F.col(name) == value)
    rows = docs
    for name, value in {"metrictype": metrictype, "metric": metric, "submetric": submetric}.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    # A single row, found without sorting the project.
    first = (
        docs.orderBy("timestamp", "sensor_id", "status")
        .limit(1)
        .select("project_name", F.col("status").alias("project_status"))
    )
    return rows.join(F.broadcast(first), "project_name").select(
        F.col("project_name").alias("projectName"),
        F.col("project_status").alias("status"),
        F.col("sensor_id").alias("sensorId"),
        "timestamp",
        "metrictype",
        "metric",
        "submetric",
        "url",
        url_timestamp(F.col("url")).alias("url_timestamp"),
    )


def nest_project_data(rows: DataFrame, max_urls: int = DOCUMENT_URLS) -> DataFrame:
    """``project_data`` rows nested again, one document per sensor snapshot. A snapshot
    with more than about ``max_urls`` urls continues in further documents (``part``).
    """
    keys = ["projectName", "status", "sensorId", "timestamp"]
    document = [*keys, "part"]
    entry = F.struct(F.col("url_timestamp").alias("timestamp"), "url")
    # One shuffle serves all three steps.
    return (
        with_parts(rows, keys, ["metrictype", "metric", "submetric", "url"], max_urls)
        .repartition(*document)
        .groupBy(*document, "metrictype", "metric", "submetric")
        .agg(F.array_sort(F.collect_list(entry)).alias("data"))
        .groupBy(*document, "metrictype")
        .agg(F.array_sort(F.collect_list(F.struct("metric", "submetric", "data"))).alias("data"))
        .groupBy(*document)
        .agg(F.array_sort(F.collect_list(F.struct("metrictype", "data"))).alias("data"))
    )


def list_metrics(samples: DataFrame) -> DataFrame:
    return samples.select("metric").distinct()


def list_submetrics(samples: DataFrame, metric: str) -> DataFrame:
    return samples.filter(F.col("metric") == metric).select("submetric").distinct()
