"""Shared pieces of the corpus operators: words, spans, stored tables, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftspark.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN_TYPE = "array<struct<start:int,end:int,value:string>>"

# A broadcast key table holds fixed-width numbers only, about 50 bytes a row in a hash
# relation, so this many rows stay near 50 MB on every executor.
BROADCAST_KEYS = 1_000_000
# Matches whose positions are added up together.
SPAN_BLOCK = 64
# Rows of one group that a single window task takes at most, about.
CELL_ROWS = 16_384


_owned: list[list[str]] = []


@contextmanager
def owned_tables(spark: SparkSession, *paths: str) -> Iterator[None]:
    """Drops the tables at ``paths`` and those that ``stored`` makes meanwhile, at the end."""
    tables = list(paths)
    _owned.append(tables)
    try:
        yield
    finally:
        _owned.remove(tables)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and where; such a table stays until it is dropped by its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a table in the folder that ``spark.checkpoint.dir`` names.

    Unlike ``checkpoint()`` this computes the last stage once and keeps columns apart, so
    that later readers take only those they need. It survives lost executors.
    """
    table, path = stored_at(df, name)
    for tables in _owned:
        tables.append(path)
    return table


def small_side(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` (a stored table of fixed-width columns) with a broadcast hint if counted small."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def whole(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever it is used for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), counted in code points.

    What lies between the matches and the matches themselves add up to the positions.
    ``value`` is the given group of the match. Positions are added up within blocks of
    SPAN_BLOCK matches and over the blocks, so that very many matches take little more than a
    constant time each.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("out"))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))

    def add(acc: Column, p: Column) -> Column:
        at = acc["pos"] + F.char_length(p["gap"])
        to = at + F.char_length(p["hit"])
        one = F.array(F.struct(at.alias("start"), to.alias("end"), p["value"].alias("value")))
        return F.struct(to.alias("pos"), F.concat(acc["out"], one.cast(SPAN_TYPE)).alias("out"))

    def blocks(hits: Column) -> Column:
        last = F.floor((F.size(hits) - 1) / SPAN_BLOCK).cast("int")
        block = lambda b: F.aggregate(F.slice(hits, b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)), start, add)
        return F.transform(F.sequence(F.lit(0), last), block)

    def placed(done: Column) -> Column:
        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at"))
        ahead = F.aggregate(
            done,
            zero,
            lambda acc, d: F.struct(
                (acc["pos"] + d["pos"]).alias("pos"), F.concat(acc["at"], F.array(acc["pos"])).alias("at")
            ),
        )
        return F.flatten(F.zip_with(done, ahead["at"], lambda d, by: F.transform(d["out"], lambda s: moved(s, by))))

    def found(hits: Column) -> Column:
        return F.when(F.size(hits) == 0, no_spans()).otherwise(bound(blocks(hits), placed).cast(SPAN_TYPE))

    return bound(F.filter(pieces, lambda p: p["hit"].isNotNull()), found)


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def span_text(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, joined by commas."""


    def mark(spans_of: Column, place: int, kind: str) -> Column:
        return F.transform(
            spans_of,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    ordered = F.array_sort(F.concat(*[mark(c, i, k) for i, (k, c) in enumerate(kinds)]))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def running_total(
    rows: DataFrame, group: list[str], cell: str, order: list[str], value: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before.

    Rows are ordered by ``cell``, then ``order``. Each (group, cell) is summed map-side, the
    cells are added up in order, and a window inside each cell does the rest; no task holds
    more than one cell of rows or one group's list of cells. ``group`` holds no nulls.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*group, cell).agg(F.sum(value).alias("__in"))
    ahead = F.sum("__in").over(before(Window.partitionBy(*group).orderBy(cell)))
    offsets = cells.select(*group, cell, F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    inside = F.sum(value).over(before(Window.partitionBy(*group, cell).orderBy(*order)))
    return (
        rows.join(offsets, [*group, cell])
        .withColumn(out, (F.col("__ahead") + F.coalesce(inside, F.lit(0))).cast("long"))
        .drop("__ahead")
    )


def ranks_alike(rows: DataFrame, key: str, name: str, limit: int = BROADCAST_KEYS) -> tuple[DataFrame, dict]:
    """``rows`` with ``rank``, the place of a row among all with its ``key``; and their counts.

    The tasks that made the stored table have numbered rows alike (``nth_alike``) and
    themselves (``part``), so that only the counts by task are added up and no row moves while
    these are at most ``limit``. ``key`` is a number of few values.
    """
    alike = stored(rows.groupBy(key, "part").count(), f"{name}-counts")
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__ahead")
    offsets = stored(alike.select(key, "part", ahead), f"{name}-offsets")
    ranked = rows.join(small_side(offsets, limit), [key, "part"])
    ranked = ranked.withColumn("rank", F.col("__ahead") + F.col("nth_alike")).drop("__ahead")
    counts = {r[0]: r[1] for r in alike.groupBy(key).agg(F.sum("count")).collect()}
    return ranked, counts
