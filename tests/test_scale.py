"""What runs once per upload, bundle or member stays cheap, and gives the same rows."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import os
import tarfile

import pyarrow as pa
import pytest

from driftspark.sources import landing, tables
from driftspark.streaming.ingest import first_uploads

UPLOAD = "sensor_id string, timestamp string, file_type string, path string, modificationTime timestamp, length bigint"


def at(second):
    return None if second is None else dt.datetime(2024, 1, 1, 0, 0, second)


@pytest.fixture
def uploads(spark, tmp_path):
    """Runs batches of (sensor, folder, second, file type, archive) through ``first_uploads``."""

    def run(*batches):
        listed, out = str(tmp_path / "listed"), []
        for batch in batches:
            rows = [
                (s, "1", kind, f"/{folder}/{kind}/{s}/1/{archive}.tar.gz", at(second), 7)
                for s, folder, second, kind, archive in batch
            ]
            spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(listed)
            files = spark.readStream.schema(UPLOAD).parquet(listed)
            query = (
                first_uploads(files)
                .writeStream.outputMode("update")
                .option("checkpointLocation", str(tmp_path / "state"))
                .trigger(availableNow=True)
                .foreachBatch(lambda df, _: out.append(df.collect()))
                .start()
            )
            query.awaitTermination()
            assert query.exception() is None
        return [sorted(((r["sensor_id"], r["path"].split("/")[1]) for r in rows), key=str) for rows in out]

    return run


def test_first_uploads_are_kept_without_python_per_key(spark, tmp_path):
    spark.createDataFrame([], UPLOAD).coalesce(1).write.parquet(str(tmp_path / "none"))
    stream = first_uploads(spark.readStream.schema(UPLOAD).parquet(str(tmp_path / "none")))
    assert stream.isStreaming and stream.columns == [c.split()[0] for c in UPLOAD.split(", ")]
    assert "Python" not in (plan := stream._jdf.queryExecution().analyzed().toString()) and "Pandas" not in plan


def test_the_first_upload_of_the_first_batch_wins(uploads):
    stats = ("stats", "stats")
    found = uploads(
        [("s", "late", 5, *stats), ("s", "early", 3, *stats), ("t", "undated", None, *stats), ("t", "dated", 9, *stats)],
        # Earlier by its time, but a batch later; and what is not accepted comes each time.
        [("s", "older", 1, *stats), ("u", "b", 4, *stats), ("u", "a", 4, *stats), ("s", "logs", 1, "logs", "logs"), ("s", "logs", 1, "logs", "logs")],
        [("s", "again", 1, *stats), ("u", "again", 2, *stats), ("s", "data", 2, "data", "data"), ("s", "other", 0, "stats", "other"), (None, "x", 1, *stats)],
        [(None, "y", 1, *stats)],
    )
    assert found[0] == [("s", "early"), ("t", "dated")]
    assert found[1] == [("s", "logs"), ("s", "logs"), ("u", "a")]
    assert found[2] == [("s", "data"), ("s", "other"), (None, "x")]
    assert found[3] == []


def archive(members, fmt=tarfile.PAX_FORMAT):
    """A tar.gz of (name or header, content)."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz", format=fmt) as tar:
        for name, content in members:
            info = name if isinstance(name, tarfile.TarInfo) else tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return buffer.getvalue()


def header(name, kind, **more):
    info = tarfile.TarInfo(name)
    info.type = kind
    for k, v in more.items():
        setattr(info, k, v)
    return info


def changed(content, at, to):
    raw = bytearray(gzip.decompress(content))
    raw[at : at + len(to)] = to
    return gzip.compress(bytes(raw))


TWO = archive([("./a/x.bin", b"one"), ("a/y.bin", os.urandom(700)), ("a/x.bin", b"two"), ("a/e.bin", b"")])
ARCHIVES = {
    "plain": TWO,
    "gnu": archive([("a/x.bin", b"one")], tarfile.GNU_FORMAT),
    "ustar": archive([("d" * 90 + "/" + "x" * 60, b"one"), ("b", b"")], tarfile.USTAR_FORMAT),
    "long name": archive([("a/" + "x" * 300, b"one"), ("b", b"")]),
    "hundred letters": archive([("x" * 100, b"one")]),
    "accents": archive([("a/\u00e9.bin", b"one"), ("a/" + "\u00e9" * 80, b"two")]),
    "no letters": archive([("a/\udcff.bin", b"one")], tarfile.GNU_FORMAT),
    "folder": archive([(header("a", tarfile.DIRTYPE), b""), ("a/x.bin", b"one")]),
    "links": archive([("a", b"one"), (header("b", tarfile.SYMTYPE, linkname="a"), b""), (header("c", tarfile.LNKTYPE, linkname="a"), b"")]),
    "old file": archive([(header("a", tarfile.AREGTYPE), b"one")]),
    "owner": archive([(header("a", tarfile.REGTYPE, uname="me", uid=1000, mtime=1_700_000_000), b"one")]),
    "fine time": archive([(header("a", tarfile.REGTYPE, mtime=1.5), b"one")]),
    "large owner": archive([(header("a", tarfile.REGTYPE, uid=8**8), b"one")], tarfile.GNU_FORMAT),
    "empty": archive([]),
    "large": archive([("a", bytes(landing.SMALL_BYTES)), ("b", b"one")]),
    "torn": TWO[:-40],
    "no end": gzip.compress(gzip.decompress(TWO)[:3072]),
    "torn member": gzip.compress(gzip.decompress(TWO)[:1700]),
    "wrong sum": changed(TWO, 1024, b"b"),
    "wrong first sum": changed(TWO, 0, b"b"),
    "wrong size": changed(TWO, 1024 + 124, b"99999999999"),
    "wrong check": TWO[:-8] + b"abcdefgh",
    "more behind": TWO + b"more",
    "two streams": TWO + TWO,
    "no zip": b"plain text",
    "nothing": b"",
    "null": None,
}


def unpacked(content, kind="stats"):
    schema = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.string()) for c in landing.MEMBERS.split(", ")])
    bundles = pa.RecordBatch.from_pylist(
        [{"sensor_id": "s", "timestamp": "1", "file_type": kind, "path": "p", "content": content}],
        pa.schema([*list(schema)[:4], ("content", pa.binary())]),
    )
    return [r for b in landing._unpack([bundles], schema) for r in b.to_pylist()]


@pytest.mark.parametrize("kind", ["stats", "data"])
@pytest.mark.parametrize("name", ARCHIVES)
def test_archives_read_in_one_piece_give_what_the_stream_gives(monkeypatch, name, kind):
    found = unpacked(ARCHIVES[name], kind)
    monkeypatch.setattr(landing, "_plain_members", lambda content, keep: None)
    assert found == unpacked(ARCHIVES[name], kind)


def test_plain_bundles_are_not_streamed_member_by_member(monkeypatch):
    def opened(*_, **__):
        raise AssertionError("opened as a stream")

    content = ARCHIVES["plain"]
    monkeypatch.setattr(landing.tarfile, "open", opened)
    rows = unpacked(content)
    assert [(r["member"], r["error"]) for r in rows] == [("a/y.bin", None), ("a/x.bin", None), ("a/e.bin", None)]
    assert rows[1]["payload"] == b"two" and rows[2]["payload"] == b""


def test_members_are_given_out_in_chunks(monkeypatch):
    monkeypatch.setattr(landing, "CHUNK_ROWS", 2)
    assert [r["payload"] for r in unpacked(ARCHIVES["plain"])][1:] == [b"two", b""]


@pytest.mark.parametrize("sizes", [[], [0], [8, 12, 600, 512], [5000] * 9])
def test_packed_bundles_are_the_archives_tarfile_writes(monkeypatch, sizes):
    members = [{"metric": "m", "submetric": f"s{i}", "sketch": os.urandom(n)} for i, n in enumerate(sizes)]
    wanted = archive([(f"customstats/m_{m['submetric']}.bin", m["sketch"]) for m in members])
    listed = pa.list_(pa.struct([("metric", pa.string()), ("submetric", pa.string()), ("sketch", pa.binary())]))
    schema = pa.schema([*((c, pa.string()) for c in ("sensor_id", "timestamp", "file_type", "path")), ("members", listed)])
    row = {"sensor_id": "s", "timestamp": "1", "file_type": "stats", "path": "p"}
    batch = pa.RecordBatch.from_pylist([row | {"members": members[:1]}, row | {"members": members}], schema)
    monkeypatch.setattr(tarfile, "open", None)  # no archive object for each bundle
    (packed,) = tables._pack([batch.slice(0, 1)])
    (packed,) = tables._pack([batch.slice(1, 1)])
    assert gzip.decompress(packed.column("content")[0].as_py()) == gzip.decompress(wanted)
