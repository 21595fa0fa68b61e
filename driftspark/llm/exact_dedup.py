"""Exact duplicates through an extendible-hash index on shared files.

The index holds one entry per (hash, doc_id). Its directory maps leading bits of the hash
to buckets and doubles while a bucket is overfull; an overfull bucket splits, the others
keep their shorter prefix. Buckets are ranges of hash values; owner tasks write and read
whole ranges of them. Entries with an equal hash are chained, and the texts behind a chain
of more than one row are compared as bytes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.llm.common import BROADCAST_KEYS, lower_ascii, stored, whole
from driftspark.operators.joins import sized_join

CAPACITY = 100_000
MAX_DEPTH = 20  # the directory has at most 2**20 slots of two numbers, about 16 MB


def default_hash(text: Column) -> Column:
    return F.xxhash64(text)


def split_buckets(counts: np.ndarray, depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """The directory over ``counts`` of entries per ``depth``-bit prefix.

    Starts with one bucket and doubles: every bucket above capacity splits in two, until none
    is or the prefix has ``depth`` bits. Returns (bucket, first slot, last slot), in order.
    """
    sums, buckets, settled = counts, [], np.zeros(len(counts), bool)
    levels = [sums]
    for _ in range(depth):
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    for local in range(depth + 1):
        width = 1 << (depth - local)
        for i in np.flatnonzero((levels[depth - local] <= capacity) | (local == depth)):
            if not settled[i * width]:
                settled[i * width : (i + 1) * width] = True
                buckets.append((int(i) * width, int(i + 1) * width - 1))
    return [(n, first, last) for n, (first, last) in enumerate(sorted(buckets))]


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored index: ``entries`` (with ``h``) plus ``bucket``, in files by bucket range."""
    spark = entries.sparkSession
    rows = entries.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(rows / capacity))) + 4) if rows > capacity else 0
    counts = np.zeros(1 << depth, np.int64)
    for slot, n in entries.groupBy(_slot(depth).alias("slot")).count().collect():
        counts[slot] = n
    buckets = split_buckets(counts, depth, capacity)
    slots = [(s, b) for b, first, last in buckets for s in range(first, last + 1)]
    directory = spark.createDataFrame(slots, "__slot int, bucket int")
    placed = entries.withColumn("__slot", _slot(depth)).join(F.broadcast(directory), "__slot")
    # Equal hashes share every bit: the id lets a large group of copies span several ranges.
    place = ["bucket", "h", "doc_id"]
    owned = placed.drop("__slot").repartitionByRange(*place).sortWithinPartitions(*place)
    return stored(owned, "hash-index")


def _texts(docs: DataFrame, hash_of) -> DataFrame:
    text = lower_ascii(whole("text"))
    return docs.select("doc_id", text.alias("norm")).withColumn("h", hash_of(F.col("norm")))


def _by_hash(big: DataFrame, known: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join with a stored table of hashes and numbers: sent while it is counted small, else
    every key is spread over several tasks, as a group of copies may hold a third of all rows."""
    return sized_join(big, known, keys, how, broadcast_rows=BROADCAST_KEYS)


def _in_chains(rows: DataFrame, chains: DataFrame, clashing: DataFrame) -> DataFrame:
    """``rows`` (h, norm) with a hash of ``clashing``, and their ``chain``. Texts are of any
    length, so that ``chains`` is never sent; only rows with such a hash are shuffled."""
    return sized_join(_by_hash(rows, clashing, ["h"], "left_semi"), chains, ["h", "norm"], broadcast_rows=-1)


def _clashes(texts: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, norm, chain) of the hashes that stand for more than one text, and these hashes.

    Grouping by the text compares the bytes of all texts with a shared hash; copies collapse
    within each task, so a large group of copies does not meet anywhere.
    """
    shared = _by_hash(texts, suspects, ["h"], "left_semi")
    per_hash = shared.groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h").count()
    clashing = stored(per_hash.filter("count > 1").select("h"), "clashes")
    chained = _by_hash(texts, clashing, ["h"], "left_semi").select("h", "norm").distinct()
    place = F.row_number().over(Window.partitionBy("h").orderBy("norm")) - 1
    return stored(chained.withColumn("chain", place), "chains"), clashing


class DedupIndex:
    """What one pass over ``docs`` finds out.

    ``entries``: stored (bucket, h, chain, doc_id, copies, text_sha256), ``copies`` counting
    equal rows with the same id. ``groups``: stored (h, chain, keep_id, keep_copies,
    group_size) of groups of two rows and more. ``chains``: stored (h, norm, chain) of hashes
    that stand for several texts, normally none.
    """

    def __init__(self, docs: DataFrame, hash_of=default_hash, capacity: int = CAPACITY):
        self.docs, self.hash_of = docs, hash_of
        texts = _texts(docs, hash_of)
        keys = stored(texts.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "keys")
        suspects = keys.groupBy("h").count().filter("count > 1").select("h")
        self.chains, self.clashing = _clashes(texts, stored(suspects, "suspects"))
        self.clashed = not self.chains.isEmpty()
        if self.clashed:
            sha = F.sha2("norm", 256).alias("text_sha256")
            known = _in_chains(texts, self.chains, self.clashing).select("doc_id", "h", sha, "chain")
            keys = self.without_clash(keys).unionByName(known)
        else:
            keys = keys.withColumn("chain", F.lit(0))
        entries = keys.groupBy("h", "chain", "doc_id").agg(
            F.first("text_sha256").alias("text_sha256"), F.count(F.lit(1)).alias("copies")
        )
        self.entries = build_index(entries, capacity)
        best = F.max(F.struct("doc_id", "copies")).alias("best")
        groups = self.entries.groupBy("bucket", "h", "chain").agg(best, F.sum("copies").alias("n"))
        self.groups = stored(
            groups.filter("n > 1").select(
                "h",
                "chain",
                F.col("best.doc_id").alias("keep_id"),
                F.col("best.copies").alias("keep_copies"),
                F.col("n").alias("group_size"),
            ),
            "groups",
        )

    def without_clash(self, rows: DataFrame) -> DataFrame:
        """The rows whose hash stands for one text only, as the first of their chain."""
        marked = self.clashing.withColumn("clash", F.lit(True))
        clean = _by_hash(rows, marked, ["h"], "left").filter("clash is null").drop("clash")
        return clean.withColumn("chain", F.lit(0))


def duplicates(docs: DataFrame, hash_of=default_hash, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. The row
    with the largest doc_id stays, a null id being the smallest; of equal rows with that same
    id one stays. Other columns are not looked at. No rows give no rows.
    """
    index = DedupIndex(docs, hash_of, capacity)
    found = _by_hash(index.entries, index.groups, ["h", "chain"], "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    # Equal rows with one id form one entry, which is told out again here.
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame, hash_of=default_hash, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only groups of two and more are looked up; the rows of the rest pass unmoved. Whole rows
    travel as one struct, so no column name can clash. Null and empty texts are one group, a
    null id is the smallest, of equal rows one stays, long texts are compared whole; no rows
    give no rows.
    """
    index = DedupIndex(docs, hash_of, capacity)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).withColumn("norm", lower_ascii(whole("row.text")))
    rows = rows.withColumn("h", hash_of(F.col("norm")))
    if index.clashed:
        chained = _in_chains(rows, index.chains, index.clashing)
        rows = index.without_clash(rows).unionByName(chained)
    else:
        rows = rows.withColumn("chain", F.lit(0))
    found = _by_hash(rows, index.groups, ["h", "chain"], "left").filter(
        F.col("group_size").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id"))
    )
    several = F.coalesce(F.col("keep_copies") > 1, F.lit(False))
    kept = found.filter(~several).select("row.*")
    if index.groups.filter("keep_copies > 1").isEmpty():
        return kept
    one = found.filter(several).groupBy("h", "chain").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row.*"))
