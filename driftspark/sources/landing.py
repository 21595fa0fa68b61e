"""Landed bundles: scanning, unpacking in the executors, and the member inventory."""

from __future__ import annotations

import io
import re
import sys
import tarfile
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftspark.functions import names
from driftspark.functions.sketches import is_sketch

BUNDLE = ["sensor_id", "timestamp", "file_type"]
MEMBERS = (
    "sensor_id string, timestamp string, file_type string, path string, "
    "member string, payload binary, error string"
)
FILES = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_TRIGGER = 10_000
CHUNK_BYTES = 32 << 20
CHUNK_ROWS = 5_000
MEMBER_BYTES = 1 << 30
# Archives that are no longer when unpacked are read in one piece.
SMALL_BYTES = 4 << 20
TAR_BLOCK = 512
TAR_END = bytes(TAR_BLOCK)
# A plain file's header after its name: numbers, of which the size and the checksum are taken, the
# type, the link, the format, owners, devices and no further name.
PLAIN_FILE = re.compile(
    rb"(?:[0-7]{7}\0){3}([0-7]{11})\0[0-7]{11}\0([0-7]{6})\0 0.{100}ustar(?:\x0000|  \0).{64}"
    rb"(?:\0{8}|[0-7]{7}\0){2}\0",
    re.DOTALL,
)
# What Spark's file source reads as one value.
BUNDLE_BYTES = 2**31 - 16
# Spark would skip files a week older than the newest one; an upload of any age counts.
ANY_AGE = "36500d"

# Worker functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_bundle_keys(files: DataFrame) -> DataFrame:
    """Sensor, timestamp and file type, as the landing path spells them."""
    path = F.col("path")
    return files.withColumns(
        {
            "file_type": names.landing_part(path, "file_type"),
            "sensor_id": names.landing_part(path, "sensor_id"),
            "timestamp": names.landing_part(path, "timestamp"),
        }
    )


def scan_landing(spark: SparkSession, base: str, file_type: str | None = None) -> DataFrame:
    """All landed bundles below ``base``. File contents are read only if selected."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.tar.gz")
        .load(base)
    )
    keyed = with_bundle_keys(files)
    return keyed if file_type is None else keyed.filter(F.col("file_type") == file_type)


def stream_landing(
    spark: SparkSession,
    base: str,
    max_files: int = FILES_PER_TRIGGER,
    archive_dir: str | None = None,
) -> DataFrame:
    """New bundles as a stream of names; a micro-batch never holds more than
    ``max_files``. With ``archive_dir`` finished bundles are moved there, which keeps the
    landing folder, and so the cost of listing it, small.

    Contents are left out: a micro-batch handed to a function would read them anew for
    every action. ``read_bundles`` fetches them once.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.tar.gz")
        .option("maxFilesPerTrigger", str(max_files))
        .option("maxFileAge", ANY_AGE)
    )
    if archive_dir is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return with_bundle_keys(reader.load(base).drop("content"))


def expand_landed(spark: SparkSession, listed: DataFrame, most_bytes: int = BUNDLE_BYTES) -> DataFrame | None:
    """Members of the listed bundles; None if there are none.

    ``listed`` is a micro-batch with names and lengths. What is longer than the file source
    reads is not opened: it comes back as a bad bundle with the reason, and the rest is read.
    """
    rows = listed.select(*BUNDLE, "path", "length").collect()
    small = [r["path"] for r in rows if (r["length"] or 0) <= most_bytes]
    parts = [expand_bundles(read_bundles(spark, small))] if small else []
    large = [
        (*r[:4], None, None, f"the bundle has {r['length']} bytes, more than {most_bytes}")
        for r in rows
        if (r["length"] or 0) > most_bytes
    ]
    if large:
        parts.append(spark.createDataFrame(large, MEMBERS))
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Contents of the named bundles; the list is that of one micro-batch at most."""
    plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    return with_bundle_keys(spark.read.format("binaryFile").load(plain))


def _plain_members(content: bytes, keep: bool) -> list[tuple[str, bytes | None]] | None:
    """What ``_archive_members`` gives for a small archive of nothing but plain files; None for any
    other, and for a broken one."""
    try:
        unzip = zlib.decompressobj(16 + zlib.MAX_WBITS)
        raw = unzip.decompress(content, SMALL_BYTES)
        if not unzip.eof:
            return None
        blocks = np.frombuffer(raw, np.uint8, len(raw) // TAR_BLOCK * TAR_BLOCK)
        sums = blocks.reshape(-1, TAR_BLOCK).sum(axis=1, dtype=np.int64).tolist()
        found: dict[str, tuple[int, int]] = {}
        at = 0
        while (header := raw[at : at + TAR_BLOCK]) != TAR_END:
            plain = PLAIN_FILE.match(header, 100)
            # The sum counts its own eight places as blanks.
            if plain is None or int(plain[2], 8) != sums[at // TAR_BLOCK] - sum(header[148:156]) + 8 * 0x20:
                return None
            name = header[:100].partition(b"\0")[0].decode().removeprefix("./")
            start = at + TAR_BLOCK
            end = start + int(plain[1], 8)
            found.pop(name, None)  # the last one counts, at its own place
            found[name] = start, end
            at = end + -end % TAR_BLOCK
        return [(name, raw[start:end] if keep else None) for name, (start, end) in found.items()]
    except (TypeError, ValueError, zlib.error):
        return None


def _archive_members(content: bytes, keep: bool) -> Iterator[tuple[str, bytes | None]]:
    """Regular files of a tar.gz by name without a leading './', with their bytes if they are
    to be kept; of equal names the last one, as unpacking would leave it.

    Most archives are small and plain and read in one piece. Any other is read as a stream, one
    member at a time. A first pass over the headers finds whatever is wrong with it before
    anything is given out.
    """
    plain = _plain_members(content, keep)
    if plain is not None:
        yield from plain
        return
    last: dict[str, int] = {}
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
        for n, m in enumerate(tar):
            if m.isfile():
                name = m.name.removeprefix("./")
                name.encode()
                if keep and m.size > MEMBER_BYTES:
                    raise ValueError(f"member {name} has {m.size} bytes")
                last[name] = n
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
        for n, m in enumerate(tar):
            name = m.name.removeprefix("./")
            if m.isfile() and last[name] == n:
                yield name, tar.extractfile(m).read() if keep else None


def _member_rows(
    keys: list[pa.Array], rows: list[tuple[int, str | None, bytes | None, str | None]], schema: pa.Schema
) -> pa.RecordBatch:
    """Members as (place of their bundle, name, bytes, error), beside the columns of their bundles."""
    places, *columns = zip(*rows)
    own = [k.take(pa.array(places, pa.int32())) for k in keys]
    found = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(keys) :])]
    return pa.RecordBatch.from_arrays([*own, *found], schema=schema)


def _unpack(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, contents = batch.columns
        keys = [k.cast(f.type) for k, f in zip(keys, schema)]
        kinds = batch.column("file_type").to_pylist()
        rows: list[tuple[int, str | None, bytes | None, str | None]] = []
        size = 0
        for place, (kind, content) in enumerate(zip(kinds, contents)):
            # Sample images are listed, not stored.
            members = _archive_members(content.as_py(), keep=kind == "stats")
            while True:
                try:
                    member, payload = next(members)
                except StopIteration:
                    break
                except Exception as broken:  # whatever is wrong with a bundle harms only itself
                    reason = f"{type(broken).__name__}: {broken}"
                    rows.append((place, None, None, reason.encode(errors="replace").decode()))
                    break
                rows.append((place, member, payload, None))
                size += len(payload or b"")
                if size > CHUNK_BYTES or len(rows) >= CHUNK_ROWS:
                    yield _member_rows(keys, rows, schema)
                    rows, size = [], 0
        if rows:
            yield _member_rows(keys, rows, schema)


def expand_bundles(bundles: DataFrame) -> DataFrame:
    """One row per archive member; a broken archive gives one row with ``error`` set.

    Nothing is written by member name. Spark bounds the bytes of each Arrow batch, so a
    worker holds a few bundles at a time.
    """
    schema = pa.schema(
        [
            (n, pa.binary() if n == "payload" else pa.string())
            for n in ("sensor_id", "timestamp", "file_type", "path", "member", "payload", "error")
        ]
    )
    return bundles.select(*BUNDLE, "path", "content").mapInArrow(
        lambda batches: _unpack(batches, schema), MEMBERS
    )


def broken_bundles(members: DataFrame) -> DataFrame:
    return members.filter(F.col("error").isNotNull())


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]+$", "")


def _is_listed(member: Column) -> Column:
    return names.member_metrictype(member).isin(*names.METRIC_TYPES) & names.is_sketch_file(
        names.member_file(member)
    )


def _is_sample(member: Column) -> Column:
    file_name = names.member_file(member)
    return file_name.rlike(names.SAMPLE_TIME + "$") & ~file_name.startswith("._")


def _described(members: DataFrame) -> DataFrame:
    """Metric family, metric and submetric from the member name; path of the member."""
    member = F.col("member")
    stem = F.regexp_replace(names.member_file(member), names.SAMPLE_TIME + "$", "")
    metric, submetric = names.split_name(stem)
    return members.withColumns(
        {
            "metrictype": names.member_metrictype(member),
            "metric": metric,
            "submetric": submetric,
            "path": F.concat_ws(
                "/", _folder(F.col("path")), names.member_metrictype(member), names.member_file(member)
            ),
        }
    )


def inventory(members: DataFrame) -> DataFrame:
    """Sketch members of the four metric families, with metric and submetric."""
    return _described(members.filter(_is_listed(F.col("member")))).drop("member")


def load_sketches(listed: DataFrame) -> DataFrame:
    """Inventory rows with ``readable``: whether the bytes are a whole KLL sketch."""
    return listed.withColumn("readable", F.expr(is_sketch("payload")))


def sample_listing(members: DataFrame) -> DataFrame:
    """Sample files of data bundles, named ``family/metric[_submetric]_micros.png``."""
    wanted = (F.col("file_type") == "data") & _is_sample(F.col("member"))
    return _described(members.filter(wanted)).drop("member").withColumnRenamed("path", "url")


def classify_members(members: DataFrame) -> DataFrame:
    """Everything a bundle may hold in one pass, told apart by ``kind``: ``sketch``,
    ``sample``, ``bad_sketch`` or ``bad_bundle``. Other members are left out.
    """
    member = F.col("member")
    kind = (
        F.when(F.col("error").isNotNull(), "bad_bundle")
        .when((F.col("file_type") == "data") & _is_sample(member), "sample")
        .when(
            (F.col("file_type") == "stats") & _is_listed(member),
            F.when(F.expr(is_sketch("payload")), "sketch").otherwise("bad_sketch"),
        )
    )
    broken_path = F.when(F.col("error").isNotNull(), F.col("path"))
    kept = members.withColumns({"kind": kind, "_broken": broken_path}).filter("kind is not null")
    return (
        _described(kept)
        .withColumn("path", F.coalesce("_broken", "path"))
        .drop("member", "_broken")
    )


def snapshot_docs(listed: DataFrame) -> DataFrame:
    """Inventory nested per snapshot: type[metrictype, stats[metric, submetric, path]].

    A snapshot is one bundle, and an archive has at most 2 GB (the limit of Spark's file
    source), so the lists are as long as one archive's index.
    """
    stat = F.struct("metric", "submetric", "path")
    # Nesting does not shrink the data, so one shuffle serves both steps.
    return (
        listed.repartition("sensor_id", "timestamp")
        .groupBy("sensor_id", "timestamp", "metrictype")
        .agg(F.array_sort(F.collect_list(stat)).alias("stats"))
        .groupBy("sensor_id", "timestamp")
        .agg(F.array_sort(F.collect_list(F.struct("metrictype", "stats"))).alias("type"))
    )
