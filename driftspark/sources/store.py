"""Append-only parquet tables that stand in for mutable documents.

Flags such as "unpacked" or "used" are rows of a log, looked up by anti-join. Every
writer owns one partition per batch and overwrites it, so a replayed batch adds nothing.
Batches lie in folders of SPAN batches each, so that a reader who needs the newest ones lists
only their spans, however long the history is. The streams' own checkpoints live below the
same root: batch numbers and tables share their fate.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftspark.operators import reads
from driftspark.sources import landing

HISTOGRAM = "metric string, submetric string, x array<double>, pmf array<double>"
RESULT = f"project_id string, last_updated bigint, {HISTOGRAM}"
DISTANCES = "distances struct<PSI: double, Pearson: double, Euclidean: double>"

# Table: (columns, partition columns). batch_id counts ingest batches, cycle counts
# aggregation cycles.
TABLES = {
    "bundles": (
        "sensor_id string, timestamp string, file_type string, path string, "
        "modificationTime timestamp, length bigint",
        ["batch_id"],
    ),
    "rejected": ("sensor_id string, timestamp string, file_type string, path string", ["batch_id"]),
    "members": (
        "sensor_id string, timestamp string, file_type string, path string, metrictype string, "
        "metric string, submetric string, payload binary, error string",
        ["batch_id", "kind"],
    ),
    "extracted": ("sensor_id string, timestamp string", ["batch_id"]),
    "snapshots": ("sensor_id string, timestamp string, path string", ["batch_id", "status"]),
    "consumed": ("sensor_id string, timestamp string, path string, batch_id bigint", ["cycle"]),
    "selected": (
        "sensor_id string, timestamp string, path string, batch_id bigint, is_reference boolean",
        ["cycle"],
    ),
    "overall": (f"{RESULT}, {DISTANCES}", ["cycle"]),
    "reference_overall": (RESULT, ["cycle"]),
    "cycles": ("project_id string, last_updated bigint, seen_batch bigint", ["cycle"]),
}
TEXT_PARTITIONS = {"kind", "status"}
SPAN = 1000
NEWS = "batch_id bigint"


class DriftStore:
    """The tables below one root folder, with the read queries over them."""

    def __init__(self, spark: SparkSession, root: str, project: str, span: int = SPAN) -> None:
        self.spark, self.root, self.project, self.span = spark, root.rstrip("/"), project, span
        for name in TABLES:
            try:
                spark.read.parquet(self.path(name))
            except AnalysisException:
                self._create(name)
        self.spark.createDataFrame([], NEWS).coalesce(1).write.mode("append").parquet(self.path("news"))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/_checkpoints/{stream}"

    def schema(self, name: str) -> str:
        columns, partitions = TABLES[name]
        typed = [f"{p} {'string' if p in TEXT_PARTITIONS else 'bigint'}" for p in partitions]
        return ", ".join([columns, "span bigint", *typed])

    def _folder(self, name: str, number: int) -> str:
        return f"{self.path(name)}/span={number // self.span}/{TABLES[name][1][0]}={number}"

    def _create(self, name: str) -> None:
        columns, partitions = TABLES[name]
        folder = "/".join([self._folder(name, -1), *[f"{p}=none" for p in partitions[1:]]])
        empty = self.spark.createDataFrame([], columns).coalesce(1)
        empty.write.mode("overwrite").parquet(folder)

    def _read(self, name: str, *paths: str) -> DataFrame:
        reader = self.spark.read.schema(self.schema(name)).option("basePath", self.path(name))
        return reader.parquet(*paths).drop("span")

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.path(name))

    def read_part(self, name: str, number: int) -> DataFrame:
        """One batch's rows, without listing the rest of the table."""
        return self._read(name, self._folder(name, number))

    def spans(self, name: str) -> list[int]:
        """The spans that a table has, oldest first; one entry each is listed, not their files."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        names = [f.getPath().getName() for f in found]
        return sorted(int(n.removeprefix("span=")) for n in names if n.startswith("span="))

    def read_between(self, name: str, first: int, last: int | None = None) -> DataFrame:
        """The rows of batches ``first`` to ``last``; only the spans they lie in are listed."""
        wanted = [
            k
            for k in self.spans(name)
            if k >= first // self.span and (last is None or k <= last // self.span)
        ]
        number = F.col(TABLES[name][1][0])
        # Span -1 is the empty one that every table begins with.
        rows = self._read(name, *[f"{self.path(name)}/span={k}" for k in wanted or [-1]])
        return rows.filter(number >= first) if last is None else rows.filter(number.between(first, last))

    def write(self, df: DataFrame, name: str, number: int, **fixed: str) -> None:
        """Replace one batch's partition; a column left to partition by stays in ``df``."""
        columns, partitions = TABLES[name]
        folders = [self._folder(name, number), *[f"{k}={v}" for k, v in fixed.items()]]
        free = [p for p in partitions[1:] if p not in fixed]
        wanted = StructType.fromDDL(columns).names
        writer = df.select(*wanted, *free).write.mode("overwrite")
        if free:
            writer = writer.partitionBy(*free)
        writer.parquet("/".join(folders))

    def announce(self, batch_id: int) -> None:
        """Tell the aggregation stream of a published batch, which takes the note away."""
        note = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
        note.write.mode("append").parquet(self.path("news"))

    # --- read queries -----------------------------------------------------------------

    def samples(self) -> DataFrame:
        """Sample listings out of unpacked data bundles."""
        return (
            self.read("members")
            .filter("kind = 'sample'")
            .select(
                F.lit(self.project).alias("project_name"),
                "sensor_id",
                "timestamp",
                F.lit("completed").alias("status"),
                "metrictype",
                "metric",
                "submetric",
                F.col("path").alias("url"),
            )
        )

    def quarantine(self) -> DataFrame:
        """Everything refused: bad uploads, broken archives, unreadable sketches."""
        keys = ["sensor_id", "timestamp", "file_type", "path"]
        refused = self.read("rejected").select(*keys, F.lit("unknown file type").alias("reason"))
        bad = self.read("members").filter("kind in ('bad_bundle', 'bad_sketch')")
        return refused.unionByName(
            bad.select(*keys, F.coalesce("error", F.lit("not a whole KLL float sketch")).alias("reason"))
        )

    def snapshot_status(self) -> DataFrame:
        """Latest state per snapshot: 'completed' once it was unpacked."""
        states = self.read("snapshots").groupBy("sensor_id", "timestamp")
        done = states.agg(F.max(F.col("status") == "completed").alias("done"))
        status = F.when(F.col("done"), "completed").otherwise("processing")
        return done.select("sensor_id", "timestamp", status.alias("status"))

    def snapshot_documents(self) -> DataFrame:
        """Completed snapshots as nested documents."""
        sketches = self.read("members").filter("kind = 'sketch'").drop("payload")
        done = self.read("snapshots").filter("status = 'completed'")
        keys = ["sensor_id", "timestamp"]
        return (
            done.select(F.lit(self.project).alias("project_name"), *keys, "status")
            .join(landing.snapshot_docs(sketches), keys, "left")
            .withColumn("type", F.coalesce("type", F.array()))
        )

    def metric_stats(
        self, project_id: str, metric: str, submetric: str | None = None, reference: bool = False
    ) -> DataFrame:
        results = self.read("reference_overall" if reference else "overall")
        # A cycle without a baseline has no reference result, so the headers cannot
        # name the newest one.
        headers = None if reference else self.read("cycles")
        return reads.metric_stats(results, project_id, metric, submetric, headers)

    def metric_distances(self, project_id: str) -> DataFrame:
        return reads.metric_distances(self.read("overall"), project_id)

    def project_data(self, project_name: str, **filters: str | None) -> DataFrame:
        return reads.project_data(self.samples(), project_name, **filters)

    def list_metrics(self) -> DataFrame:
        return reads.list_metrics(self.samples())

    def list_submetrics(self, metric: str) -> DataFrame:
        return reads.list_submetrics(self.samples(), metric)
