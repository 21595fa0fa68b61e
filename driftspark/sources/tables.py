"""The bundled test tables seen as drift-monitoring inputs."""

from __future__ import annotations

import sys
import tarfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftspark.functions.names import REFERENCE
from driftspark.operators.histograms import build_sketches

PROJECT = "demo"
REFERENCE_UNTIL = "1998-01-01"
# Tasks that the rows of one baseline snapshot are dealt to.
DEALT = 32
MEASURES = ("quantity", "extendedprice", "discount", "tax")
FAMILY = {"view": "imgstats", "click": "modelstats", "purchase": "samples", "signup": "customstats"}

# Worker functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to all cores when the files cannot be split that far, as with one
    file of one row group. Inputs with enough splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def micros(ts: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = (ts.cast("timestamp_ntz") - epoch).cast("interval second").cast("decimal(20,6)")
    return (since * 1_000_000).cast("bigint")


def shipments(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """lineitem rows with the sensor they come from; early ones are the reference.
    ``timestamp`` is the ship month as text.
    """
    li = table(spark, sf_dir, "lineitem")
    if spread_out:
        li = spread(li, "l_orderkey")
    is_reference = F.col("l_shipdate") < F.lit(REFERENCE_UNTIL).cast("timestamp_ntz")
    return li.select(
        F.lit(PROJECT).alias("project_id"),
        F.when(is_reference, F.lit(REFERENCE))
        .otherwise(F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")))
        .alias("sensor_id"),
        F.col("l_returnflag").alias("submetric"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws(
            "-",
            F.year("l_shipdate").cast("string"),
            F.lpad(F.month("l_shipdate").cast("string"), 2, "0"),
        ).alias("timestamp"),
        is_reference.alias("is_reference"),
        *[F.col(f"l_{m}").alias(m) for m in MEASURES],
    )


def observations(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """lineitem measures as (sensor_id, metric, submetric, value) with reference flag.

    ``spread_out`` suits work that costs much more per row than the scan, as building
    sketches does.
    """
    return measured(shipments(spark, sf_dir, spread_out))


def measured(shipped: DataFrame) -> DataFrame:
    """One row per measure of each shipment."""
    return shipped.unpivot(
        ["project_id", "sensor_id", "submetric", "ts", "timestamp", "is_reference"],
        list(MEASURES),
        "metric",
        "value",
    )


def channel_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding positions as channels; label 0 is the reference."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        F.col("label").alias("sensor"),
        (F.col("label") == 0).alias("is_reference"),
        F.lit("embedding").alias("metric"),
        F.posexplode("embedding").alias("pos", "raw"),
    ).select(
        "vec_id",
        "sensor",
        "is_reference",
        "metric",
        F.concat(F.lit("channel_"), F.col("pos").cast("string")).alias("submetric"),
        "pos",
        F.col("raw").cast("double").alias("value"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploaded bundles, at the landing paths they would have."""
    ev = table(spark, sf_dir, "events")
    file_type = (
        F.when(F.col("event_type") == "error", "data")
        .when(F.col("event_type") == "signup", "logs")
        .otherwise("stats")
    )
    stamp = micros(F.col("ts")).cast("string")
    user = F.col("user_id").cast("string")
    return ev.select(
        F.concat_ws(
            "/",
            F.lit("/landing/bundles"),
            file_type,
            user,
            stamp,
            F.concat(file_type, F.lit(".tar.gz")),
        ).alias("path"),
        user.alias("sensor_id"),
        stamp.alias("timestamp"),
        file_type.alias("file_type"),
        F.col("ts").alias("modificationTime"),
        "event_id",
        "event_type",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshot states; user 0 is the baseline, errors are still in work."""
    ev = table(spark, sf_dir, "events")
    sensor = F.when(F.col("user_id") == 0, REFERENCE).otherwise(F.col("user_id").cast("string"))
    return ev.select(
        F.lit(PROJECT).alias("project_name"),
        sensor.alias("sensor_id"),
        micros(F.col("ts")).cast("string").alias("timestamp"),
        F.when(F.col("event_type") == "error", "processing")
        .otherwise("completed")
        .alias("status"),
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("path"),
        "ts",
        "event_type",
    )


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as archive members named family/event_k.bin."""
    ev = table(spark, sf_dir, "events")
    family = F.lit("other")
    for event, name in FAMILY.items():
        family = F.when(F.col("event_type") == event, name).otherwise(family)
    member = F.concat(
        family, F.lit("/"), "event_type", F.lit("_"), F.get_json_object("props", "$.k"), F.lit(".bin")
    )
    stamp = micros(F.col("ts")).cast("string")
    user = F.col("user_id").cast("string")
    return ev.select(
        user.alias("sensor_id"),
        stamp.alias("timestamp"),
        F.concat_ws("/", F.lit("/landing/bundles/stats"), user, stamp, F.lit("stats.tar.gz")).alias(
            "path"
        ),
        member.alias("member"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a flat sample listing; the url names the time."""
    ev = table(spark, sf_dir, "events")
    stamp = micros(F.col("ts"))
    return ev.select(
        F.when(F.col("event_type") == "signup", "other").otherwise(PROJECT).alias("project_name"),
        F.col("user_id").cast("string").alias("sensor_id"),
        F.date_format("ts", "yyyyMMdd").alias("timestamp"),
        F.when(F.col("event_type") == "error", "processing").otherwise("completed").alias("status"),
        F.lit("samples").alias("metrictype"),
        F.col("event_type").alias("metric"),
        F.get_json_object("props", "$.k").alias("submetric"),
        F.concat(
            F.lit("/samples/"), "event_type", F.lit("_"), stamp.cast("string"), F.lit(".png")
        ).alias("url"),
    )


def sample_documents(flat: DataFrame) -> DataFrame:
    """The flat listing nested per sensor snapshot and url, as stored documents are."""
    return flat.select(
        "project_name",
        "sensor_id",
        "timestamp",
        "status",
        F.array(
            F.struct(
                "metrictype",
                F.array(F.struct("metric", "submetric", F.array("url").alias("data"))).alias("data"),
            )
        ).alias("type"),
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sensor snapshot's sketches as the tar.gz bundle it would upload."""

    @lru_cache(maxsize=10_000)
    def header(name: str, size: int) -> bytes:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf()

    def archive(members: list[tuple[str, bytes]]) -> bytes:
        parts = []
        for name, content in members:
            parts += [header(name, len(content)), content, bytes(-len(content) % tarfile.BLOCKSIZE)]
        parts.append(bytes(2 * tarfile.BLOCKSIZE))
        parts.append(bytes(-sum(map(len, parts)) % tarfile.RECORDSIZE))
        # Little memory, as setting it up takes longer than a short archive does.
        zipped = zlib.compressobj(1, zlib.DEFLATED, 16 + zlib.MAX_WBITS, 5)
        return zipped.compress(b"".join(parts)) + zipped.flush()

    for batch in batches:
        members = batch.column("members")
        each = members.flatten()
        named = zip(*(each.field(n).to_pylist() for n in ("metric", "submetric", "sketch")))
        files = ((f"customstats/{metric}_{sub}.bin", sketch) for metric, sub, sketch in named)
        contents = [archive(list(islice(files, n))) for n in members.value_lengths().to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(contents, pa.binary())],
            ["sensor_id", "timestamp", "file_type", "path", "content"],
        )


def packed_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem sketches per supplier and month, packed as uploads. A bundle holds one
    sketch per measure and return flag, however many rows went into it."""
    keys = ["sensor_id", "timestamp"]
    # A snapshot's rows meet before they are sketched, so that few sketches are merged; those of
    # the baseline, which has a large share of all, are dealt by their time as well.
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = F.when(F.col("is_reference"), F.pmod(F.xxhash64("ts", *MEASURES), F.lit(DEALT)))
    met = shipments(spark, sf_dir).repartition(least, *keys, dealt)
    sketches = build_sketches(measured(met), [*keys, "metric", "submetric"])
    # Packing costs far more than its few bytes suggest, so partitions are not coalesced.
    spread = sketches.repartition(least, *keys)
    bundles = spread.groupBy(*keys).agg(
        F.collect_list(F.struct("metric", "submetric", "sketch")).alias("members")
    )
    return bundles.select(
        *keys,
        F.lit("stats").alias("file_type"),
        F.concat_ws("/", F.lit("/landing/bundles/stats"), *keys, F.lit("stats.tar.gz")).alias("path"),
        "members",
    ).mapInArrow(
        _pack, "sensor_id string, timestamp string, file_type string, path string, content binary"
    )
