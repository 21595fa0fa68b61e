"""One bad sketch or bundle harms only itself, and a batch's work does not grow with history."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftspark.functions.sketches import is_sketch
from driftspark.sources import landing
from driftspark.sources.store import DriftStore
from driftspark.streaming import aggregate, ingest
from driftspark.streaming.aggregate import progress, run_cycle, start_aggregate
from driftspark.streaming.ingest import ingest_batch, start_ingest

MEMBER = "imgstats/brightness_channel_0.bin"


def with_byte(buffer: bytes, at: int, value: int) -> bytes:
    return buffer[:at] + bytes([value]) + buffer[at + 1 :]


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def readable(spark, buffers):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(buffers)], "i int, b binary")
    return [r.ok for r in df.select("i", F.expr(is_sketch("b")).alias("ok")).orderBy("i").collect()]


@pytest.mark.parametrize("k", [8, 200, 3000])
def test_whole_sketches_are_taken(spark, k):
    sizes = [0, 1, 2, 7, 199, 201, 5_000, 300_000]
    aggregate = lambda n: spark.range(n).selectExpr(f"kll_sketch_agg_float(cast(id - 50 as float), {k}) s")
    assert readable(spark, [bytes(aggregate(n).first().s) for n in sizes]) == [True] * len(sizes)


def test_infinite_values_are_no_damage(spark, sketch):
    buffers = [sketch([1.0, 2.0, float("inf")]), sketch([float("-inf")]), sketch([float("-inf"), 3.0])]
    assert readable(spark, buffers) == [True] * 3


def test_what_passes_merges(spark, sketch):
    """Random damage anywhere: all that is taken merges with good sketches to real numbers."""
    rng = random.Random(7)
    good = [sketch(range(n)) for n in (1, 9, 250, 6000)]
    buffers = []
    for b in good:
        buffers += [with_byte(b, at, v) for at in range(min(len(b), 48)) for v in (0, 1, 2, 127, 128, 255)]
        for _ in range(300):
            damaged = b
            for _ in range(rng.randint(1, 3)):
                damaged = with_byte(damaged, rng.randrange(len(b)), rng.choice([127, 255, rng.randrange(256)]))
            buffers.append(damaged)
    taken = [b for b, ok in zip(buffers, readable(spark, buffers)) if ok]
    assert 0 < len(taken) < len(buffers)
    df = spark.createDataFrame([(b,) for b in [*taken, *good]], "b binary").repartition(3)
    both = df.selectExpr("kll_merge_agg_float(b) s").selectExpr(
        "kll_sketch_get_n_float(s) n", "kll_sketch_get_quantile_float(s, array(0D, 0.5D, 1D)) q"
    )
    row = both.first()
    assert row.n > 0 and all(q == q for q in row.q)


def test_a_damaged_sketch_stops_no_cycle(spark, tmp_path, land, sketch):
    """Damage in the header bytes that lengths do not show, beside good sketches."""
    store, whole = DriftStore(spark, str(tmp_path / "store"), "demo"), sketch(range(5000))
    land.put("reference", "050", {MEMBER: sketch(range(1000))})
    land.put("good", "100", {MEMBER: sketch(range(300))})
    damaged = [6, 15, *range(24, 32)]
    for at in damaged:
        land.put(f"bad{at}", "100", {MEMBER: with_byte(whole, at, 255), "imgstats/b.bin": sketch(range(10))})
    drain(start_ingest(store, str(land.base), available_now=True))
    drain(start_aggregate(store, available_now=True))
    refused = {(r.sensor_id, r.path.rsplit("/", 1)[1]) for r in store.quarantine().collect()}
    assert refused == {(f"bad{at}", "brightness_channel_0.bin") for at in damaged}
    assert store.metric_stats("demo", "brightness").first().x[-1] == 299.0
    assert store.metric_stats("demo", "b").first().x[-1] == 9.0
    assert store.metric_distances("demo").count() == 1


def test_an_oversize_bundle_beside_a_good_one(spark, land, sketch):
    land.put("small", "1", {MEMBER: sketch(range(10))})
    land.put_raw("large", "1", b"\0" * 5000)
    listed = landing.scan_landing(spark, str(land.base)).drop("content")
    rows = landing.expand_landed(spark, listed, most_bytes=4000).collect()
    assert {(r.sensor_id, r.member) for r in rows if r.error is None} == {("small", MEMBER)}
    (bad,) = [r for r in rows if r.error]
    assert bad.sensor_id == "large" and "5000 bytes" in bad.error
    assert landing.expand_landed(spark, listed.limit(0)) is None


def test_the_first_upload_of_a_key_wins_over_batches(spark, tmp_path, land, sketch):
    """One file a batch, the newer upload first; the earlier one that comes later is no news."""
    store = DriftStore(spark, str(tmp_path / "store"), "demo")
    land.put("s1", "100", {MEMBER: sketch(range(10))})
    drain(start_ingest(store, str(land.base), available_now=True))
    again = land.put("s1", "100", {MEMBER: sketch(range(20))})
    again.rename(again.with_name("stats.tar.gz.moved"))
    other = land.base / "copy" / "stats" / "s1" / "100" / "stats.tar.gz"
    other.parent.mkdir(parents=True)
    again.with_name("stats.tar.gz.moved").rename(other)
    land.put("s1", "200", {MEMBER: sketch(range(30))})
    drain(start_ingest(store, str(land.base), max_files=1, available_now=True))
    listed = sorted((r.timestamp, r.path.count("/copy/")) for r in store.read("bundles").collect())
    assert listed == [("100", 0), ("200", 0)]


def test_a_failed_batch_is_replayed_whole(spark, tmp_path, land, sketch, monkeypatch):
    """The state of a batch that failed half-way is that of the batch before."""
    store = DriftStore(spark, str(tmp_path / "store"), "demo")
    land.put("s1", "100", {MEMBER: sketch(range(10))})
    work = ingest.ingest_batch

    def fails(store, listed, batch_id):
        listed.count()
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "ingest_batch", fails)
    query = start_ingest(store, str(land.base), available_now=True)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    monkeypatch.setattr(ingest, "ingest_batch", work)
    drain(start_ingest(store, str(land.base), available_now=True))
    assert store.read("bundles").count() == 1
    assert [r.status for r in store.snapshot_status().collect()] == ["completed"]


def test_cycles_list_no_history(spark, tmp_path, land, sketch, monkeypatch):
    """Ten batches and cycles in spans of two: the last ones read the newest spans only."""
    store = DriftStore(spark, str(tmp_path / "store"), "demo", span=2)
    land.put("reference", "050", {MEMBER: sketch(range(100))})
    paths, read = [], DriftStore._read

    def watched(self, name, *folders):
        paths.append(folders)
        return read(self, name, *folders)

    counts = []
    for i in range(10):
        land.put("s1", f"{100 + i}", {MEMBER: sketch(range(10 + i))})
        newest = landing.scan_landing(spark, str(land.base)).drop("content")
        newest = newest.filter(F.col("timestamp").isin(f"{100 + i}", *(["050"] if i == 0 else [])))
        monkeypatch.setattr(DriftStore, "_read", watched)
        paths.clear()
        ingest_batch(store, newest, i)
        assert run_cycle(store, i, now=i + 1)
        counts.append(sum(map(len, paths)))
        assert not any(f == store.path(n) for fs in paths for f in fs for n in ("members", "bundles", "snapshots", "cycles", "consumed", "selected"))
        monkeypatch.setattr(DriftStore, "_read", read)
    assert max(counts[4:]) <= max(counts[:4]) + 2
    assert store.metric_stats("demo", "brightness").first().x[-1] == 18.0
    assert store.metric_distances("demo").count() == 10


def test_progress_looks_back_over_spans(spark, tmp_path):
    """Cycles that saw the same newest batch reach back further than one span."""
    store = DriftStore(spark, str(tmp_path / "store"), "demo", span=2)
    assert progress(store, 0) == aggregate.Progress()
    for cycle, seen in [(0, 3), (1, 5), (2, 5), (5, 5), (6, 5)]:
        header = spark.createDataFrame([("demo", cycle, seen)], "project_id string, last_updated long, seen_batch long")
        store.write(header, "cycles", cycle)
    assert progress(store, 7) == aggregate.Progress(cycle=6, batch=5, since=1)
    assert progress(store, 2) == aggregate.Progress(cycle=1, batch=5, since=1)
    assert progress(store, 1) == aggregate.Progress(cycle=0, batch=3, since=0)


def test_notes_are_taken_away(spark, tmp_path, land, sketch):
    store = DriftStore(spark, str(tmp_path / "store"), "demo")
    for i in range(3):
        land.put("s1", f"{100 + i}", {MEMBER: sketch(range(10 + i))})
        drain(start_ingest(store, str(land.base), available_now=True))
        drain(start_aggregate(store, available_now=True))
    assert store.read("cycles").count() == 3
    assert len(list((tmp_path / "store" / "news").glob("*.parquet"))) <= 2
