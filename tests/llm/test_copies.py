"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftspark.llm import exact_dedup as ed, simhash as sh
from driftspark.llm.common import UPPER, LOWER

FOLD = str.maketrans(UPPER, LOWER)


def smallest_first(value):
    return (value is not None, value if value is not None else 0)


def exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t.translate(FOLD)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=smallest_first)
        sha, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def rows(df):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.fixture(params=[None, -1], ids=["sent", "spread"])
def either_join(request, monkeypatch):
    """Joins by hash below and beyond the size up to which a side is sent."""
    if request.param is not None:
        monkeypatch.setattr(ed, "BROADCAST_KEYS", request.param)


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("capacity", [ed.CAPACITY, 3])
def test_duplicates(source, capacity, request, plain, either_join):
    docs = request.getfixturevalue(source)
    assert rows(ed.duplicates(docs, capacity=capacity)) == exact(plain(docs))


def test_colliding_hashes_are_told_apart(odd_docs, real_docs, plain, either_join):
    """With a hash of five values, only the comparison of bytes can separate the texts."""
    weak = lambda t: F.pmod(F.char_length(t), F.lit(5)).cast("long")
    docs = odd_docs.select("doc_id", "text").unionByName(real_docs.select("doc_id", "text"))
    assert rows(ed.duplicates(docs, hash_of=weak, capacity=2)) == exact(plain(docs))
    kept = ed.kept_documents(docs, hash_of=weak)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(
        [r[0] for r in exact(plain(docs)) if r[3]], key=repr
    )


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
def test_kept_documents(source, request, plain, either_join):
    docs = request.getfixturevalue(source)
    kept = ed.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(
        [r[0] for r in exact(plain(docs)) if r[3]], key=repr
    )
    assert kept.exceptAll(docs).isEmpty()


def test_directory_doubles_only_where_it_must():
    counts = np.array([0, 0, 0, 0, 9, 1, 0, 0])
    assert ed.split_buckets(counts, 3, 100) == [(0, 0, 7)]
    assert ed.split_buckets(counts, 3, 9) == [(0, 0, 3), (1, 4, 4), (2, 5, 5), (3, 6, 7)]
    # A bucket that cannot split further stays overfull.
    assert (1, 4, 4) in ed.split_buckets(counts, 3, 2)


# --- near copies ------------------------------------------------------------------------------


def simple_fingerprint(text, width=3):
    words = text.encode().lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_links(fps, radius):
    a = np.array(sorted(set(fps)), np.uint64)
    return {
        (int(a[i]), int(a[j]))
        for i in range(len(a))
        for j in range(i + 1, len(a))
        if int(a[i] ^ a[j]).bit_count() <= radius
    }


def brute_components(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_links(fps, radius):
        parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
def test_near_duplicates(source, request, plain):
    docs = request.getfixturevalue(source)
    fps = [(i, simple_fingerprint(t)) for i, t in plain(docs)]
    root = brute_components([f for _, f in fps], sh.RADIUS)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted([(i, f"{f:016x}", least.get(root[f])) for i, f in fps], key=repr)
    columns = ["doc_id", "fingerprint", "component_id"]
    got = sorted([tuple(r) for r in sh.near_duplicates(docs).select(*columns).collect()], key=repr)
    assert got == want
    kept = sh.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([least.get(r) for r in set(root.values())], key=repr)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, int(n), False))) for n in rng.integers(0, 5, 400)]
    fps = np.unique(seeds[rng.integers(0, 40, 400)] ^ np.array(flips))
    found = {(int(fps[i]), int(fps[j])) for part in sh.pairs_within(fps, radius, 64) for i, j in part}
    assert found == brute_links(fps.tolist(), radius)


@pytest.mark.parametrize("most", [sh.MOST_TOGETHER, 4])
def test_no_link_is_lost(spark, most):
    """Crowded keys are cut again and again; links and components stay those of brute force."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    near = [b ^ np.uint64((1 << int(i)) | (1 << int(j))) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    low = np.arange(40, dtype=np.uint64) * np.uint64(3)  # these share their upper blocks
    fps = np.unique(np.concatenate([base, near, low])).view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    links = sh.near_pairs(df, 2, most)
    got = {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in links.collect()}
    assert got == brute_links(fps.view(np.uint64).tolist(), 2)
    roots = {r.fp & (2**64 - 1): r.root for r in sh.components(links).collect()}
    truth = brute_components(fps.view(np.uint64).tolist(), 2)
    linked = [f for f in truth if f in roots]
    assert len({(roots[f], truth[f]) for f in linked}) == len({roots[f] for f in linked})
    assert len({truth[f] for f in linked}) == len({roots[f] for f in linked})


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(5000))
    monkeypatch.setattr(sh, "PIECE_BYTES", 64)
    assert sh.fingerprint(text) == simple_fingerprint(text)
    for short in ("", "  ", "a", "a b", "a b c", "x" * 300, ("y" * 100 + " ") * 3):
        assert sh.fingerprint(short) == simple_fingerprint(short)


def test_index_divides_a_large_group(spark):
    """Copies of one text with different ids are dealt to several owner tasks."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id)) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = ed.DedupIndex(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = index.groups.select("h", "group_size", "keep_id").collect()
    assert [(r.group_size, r.keep_id) for r in hot] == [(2000, 3998)]
    files = index.entries.filter(F.col("h") == hot[0].h).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 2000


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A thousand vertices in a row, numbered along it, and a star beside it."""
    rounds, stored = [], sh.stored
    monkeypatch.setattr(sh, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    chain = [(i, i + 1) for i in range(1000)]
    star = [(5000, 5001 + i) for i in range(50)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    found = {r.fp: r.root for r in sh.components(links).collect()}
    assert len({found[i] for i in range(1001)}) == 1 and 0 <= found[0] <= 1000
    assert len({found[5000 + i] for i in range(51)}) == 1 and found[5000] >= 5000
    assert rounds.count("mapping") <= 25
