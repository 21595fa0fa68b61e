"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within ``radius`` bits of one another are linked, and linked documents form
components. Distinct fingerprints are cut into radius + 2 blocks: two that are within the
radius agree in at least two blocks, so each is dealt out once per pair of blocks. What
shares such a key is compared bit plane by bit plane; a key with too many fingerprints is
cut further by the bits that it leaves free, until few can share it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from driftspark.llm.common import small_side, stored
from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
MOST_TOGETHER = 2048  # fingerprints of one key that are compared as they are
PIECE_BYTES = 1 << 20
SPACES = b" \t\n\v\f\r"


# --- fingerprints ---------------------------------------------------------------------------


def _word_runs(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs, each beginning with the last width - 1 of the run before."""
    at, tail = 0, []
    while at < len(data):
        to = at + PIECE_BYTES
        while to < len(data) and data[to] not in SPACES:
            to += 1
        words = tail + data[at:to].split()
        if len(words) >= width or to >= len(data):
            yield words
            tail = words[len(words) - width + 1 :] if width > 1 else []
        else:
            tail = words
        at = to


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the hashes of the shingles; no words: 0."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(BITS, np.int64), 0
    for words in _word_runs(data, width):
        if not words or (total and len(words) < width):
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        w = min(width, len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - w + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            [digest(line[a:b], SEED) for a, b in zip(starts, ends[w - 1 :].tolist())], np.uint64
        )
        # Bits of all hashes, summed over the hashes; byte 0 of "<u8" holds bits 0 to 7.
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    set_bits = np.packbits(2 * ones > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(set_bits.view("<u8")[0])


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): the text's hash, and the fingerprint as a signed long of the same bits."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("h"), "text")
    return keyed.mapInArrow(tidy(compute), f"doc_id {kind}, h long, fp long")


# --- bit-sliced comparison --------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def pairs_within(fps: np.ndarray, radius: int, queries: int = 256) -> Iterator[np.ndarray]:
    """Pairs (i, j), i < j, of distances up to ``radius``, as arrays of two columns.

    Every word holds 64 fingerprints. Distances to a query are counted in vertical carry-save
    counters: one word operation adds a bit to 64 distances. ``over`` collects those above the
    radius; a word in which all are over is abandoned and takes no part in later planes.
    """
    planes = bit_planes(fps)
    varying = [p for p in range(BITS) if (planes[p] != planes[p][0]).any() or planes[p][0] not in (0, 2**64 - 1)]
    n_counters = (radius + 1).bit_length()
    full, n_words = np.uint64(2**64 - 1), planes.shape[1]
    for first in range(0, len(fps), queries):
        asked = fps[first : first + queries]
        q, w = (a.ravel() for a in np.indices((len(asked), n_words)))
        live = w >= (first + q) // 64  # only later fingerprints
        q, w = q[live], w[live]
        counters = [np.zeros(len(q), np.uint64) for _ in range(n_counters)]
        over = np.zeros(len(q), np.uint64)
        for done, p in enumerate(varying, 1):
            flip = -((asked >> np.uint64(p)) & np.uint64(1)).astype(np.int64)
            carry = planes[p][w] ^ flip.view(np.uint64)[q]
            for c in range(n_counters):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            # Distances of radius + 1 and more: the counters' bits compared with the radius.
            above, equal = np.zeros_like(over), np.full_like(over, full)
            for c in reversed(range(n_counters)):
                if radius >> c & 1:
                    equal &= counters[c]
                else:
                    above |= equal & counters[c]
                    equal &= ~counters[c]
            over |= above
            if done % 4 == 0 or done == len(varying):
                keep = over != full
                if not keep.all():
                    q, w, over = q[keep], w[keep], over[keep]
                    counters = [c[keep] for c in counters]
        near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(near)
        i, j = first + q[k], w[k] * 64 + bit
        real = (i < j) & (j < len(fps))
        if real.any():
            yield np.column_stack([i[real], j[real]])


def _compare(radius: int):
    """Links among the fingerprints of each key; keys come together and sorted."""

    def links(fps: np.ndarray) -> pa.RecordBatch:
        fps = np.unique(fps).view(np.uint64)
        found = [p for p in pairs_within(fps, radius)] or [np.zeros((0, 2), np.int64)]
        ends = fps.view(np.int64)[np.concatenate(found)]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            # Whole keys, in runs of about the size that is compared at once.
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            at = 0
            while (ahead := starts[starts >= at + MOST_TOGETHER]).size:
                yield links(fps[at : ahead[0]])
                at = ahead[0]
            keys, fps = keys[at:], fps[at:]
        if len(keys):
            yield links(fps)

    return run


def _keyed(frame: DataFrame, free: list[int], radius: int, first: int):
    """(fp, table, key) for every pair of blocks of the free bits, and the bits left free, by table."""
    blocks = [list(map(int, b)) for b in np.array_split(free, radius + 2) if len(b)]
    keys, left = [], {}
    for pair in combinations(range(len(blocks)), 2):
        table = first + len(left)
        mask = sum(1 << b for i in pair for b in blocks[i])
        mask -= (mask >> 63) << 64  # as a signed long
        part = F.xxhash64(F.lit(mask), "key", F.col("fp").bitwiseAND(F.lit(mask)))
        keys.append(F.struct(F.lit(table).alias("table"), part.alias("key")))
        left[table] = [b for i, block in enumerate(blocks) if i not in pair for b in block]
    return frame.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*"), left


def near_pairs(fps: DataFrame, radius: int = RADIUS, most: int = MOST_TOGETHER) -> DataFrame:
    """(a, b): links between distinct fingerprints (``fps``: a stored table of fp, no repeats).

    No link is lost: whatever agrees in a pair of blocks is compared, and a key with more than
    ``most`` fingerprints is cut again by the bits it leaves free. Once these are few, no more
    than 2 ** free fingerprints can share a key. A hash stands for the key; should two keys
    share one, their fingerprints are merely compared as well.
    """
    frames = [(fps.select("fp").withColumn("key", F.lit(0).cast("long")), list(range(BITS)))]
    found = None
    while frames:
        dealt, left = None, {}
        for frame, free in frames:
            part, of = _keyed(frame, free, radius, len(left))
            dealt, left = (part if dealt is None else dealt.unionByName(part)), left | of
        at = ["table", "key"]
        counts = stored(dealt.groupBy(*at).count().filter("count > 1"), "key-counts")
        bounded = [t for t, bits in left.items() if 2 ** len(bits) <= most or len(bits) < 2]
        few = (F.col("count") <= most) | F.col("table").isin(bounded)
        shared = dealt.join(counts.filter(few).select(*at), at, "left_semi")
        together = shared.repartition("key").sortWithinPartitions("key")
        links = together.select("key", "fp").mapInArrow(_compare(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        crowded = stored(counts.filter(~few).select(*at), "crowded")
        # At most as many numbers as there are pairs of blocks.
        tables = [r.table for r in crowded.select("table").distinct().collect()]
        again = dealt.join(crowded, at, "left_semi") if tables else None
        frames = [
            (stored(again.filter(F.col("table") == t).select("fp", "key"), "recut"), left[t]) for t in tables
        ]
    return found.distinct()


# --- components -------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of every linked fingerprint, by contracting the graph; a root is some
    fingerprint of its component.

    In every round all vertices are ordered anew by a hash of round and vertex. A vertex points
    at the first of itself and its neighbours, pointers are followed once more, and links move
    to where their ends point. Whatever the graph looks like, the order does not follow it, so
    that also of a long chain only a part of the vertices is pointed at and the rounds grow with
    the logarithm of its length. A stored table per round cuts the lineage. A fingerprint has
    few neighbours within the radius, so no vertex is hot at first.
    """
    edges, rounds = stored(links, "links"), 0
    mapping = edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    mapping = mapping.withColumn("root", F.col("fp"))
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(rounds), F.col(c)).alias("rank"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(rank("a"), F.min(rank("b")))["v"]
        to = stored(both.groupBy("a").agg(first.alias("to")), "pointers")
        far = to.alias("p").join(to.alias("q"), F.col("p.to") == F.col("q.a"))
        to = stored(far.select("p.a", F.col("q.to").alias("to")), "pointers")
        moved = edges.join(to, "a").select("b", F.col("to").alias("ta"))
        moved = moved.join(to.withColumnRenamed("a", "b"), "b").filter("ta <> to")
        edges = stored(moved.select(F.col("ta").alias("a"), F.col("to").alias("b")).distinct(), "links")
        led = mapping.join(to.withColumnRenamed("a", "root"), "root", "left")
        mapping = stored(led.select("fp", F.coalesce("to", "root").alias("root")), "mapping")
        rounds += 1
    return mapping


class NearGroups:
    """Fingerprints of all documents and the component of each.

    ``rows``: stored (doc_id, h, fp), h being a hash of the text. ``roots``: stored
    (fp, root, component_id), component_id the smallest doc_id reachable.
    """

    def __init__(self, docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, most: int = MOST_TOGETHER):
        self.rows = stored(fingerprints(docs, width), "fingerprints")
        each = self.rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
        each = stored(each, "distinct-fingerprints")
        linked = components(near_pairs(each, radius, most))
        led = each.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = led.groupBy("root").agg(F.min("least_id").alias("component_id"))
        self.roots = stored(led.join(least, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are split at ASCII white space after lower-casing A-Z. Shorter texts are one shingle;
    a null text or one without words has fingerprint zero and is linked like any other.
    Repeated rows share their component; a null doc_id is never the smallest unless a
    component has no other. No rows give no rows, other columns are ignored.
    """
    groups = NearGroups(docs, width, radius)
    found = groups.rows.join(groups.roots, "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one per component: the one with the smallest doc_id.

    Of rows with that same id the one with the least text hash stays, of equal rows one. Only
    the keys of rows that go are joined with the documents.
    """
    groups = NearGroups(docs, width, radius)
    keyed = groups.rows.join(groups.roots, "fp").groupBy("root", "doc_id", "h").agg(
        F.count(F.lit(1)).alias("copies")
    )
    mine = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    keyed = stored(keyed.withColumn("me", mine), "near-keys")
    best = keyed.groupBy("root").agg(F.min("me").alias("best"), F.count(F.lit(1)).alias("keys"))
    several = best.filter("keys > 1").select("root", "best")
    lose = stored(
        keyed.join(several, "root").filter(F.col("me") != F.col("best")).select(
            F.col("doc_id").alias("__id"), F.col("h").alias("__h")
        ),
        "near-losers",
    )
    repeated = stored(
        keyed.filter("copies > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")),
        "near-repeats",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).withColumn("__key", text_hash(F.col("row.text")))
    same = F.col("row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h"))
    kept = rows.join(small_side(lose), same, "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    marked = small_side(repeated)
    once = kept.join(marked, same, "left_semi").select("row", "__key", F.col("row.doc_id").alias("__id"))
    once = once.groupBy("__id", "__key").agg(F.first("row").alias("row"))
    return kept.join(marked, same, "left_anti").select("row.*").unionByName(once.select("row.*"))
