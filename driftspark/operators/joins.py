"""Joins of a big input with a per-key table whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftspark.session import cut

# A row of the small side is a few keys plus a few numbers, so this stays well under
# the memory of one executor.
BROADCAST_ROWS = 100_000
FANOUT = 32
# Words of 64 bits that ``maybe_in`` broadcasts at most: 16 bits a key up to a million keys.
SIEVE_WORDS = 1 << 18


def sent_or_spread(small: DataFrame, rows: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, marked to be broadcast or shuffled in a join by its counted ``rows``.

    Unmarked, Spark goes by the compressed length of the files that ``small`` comes from, which
    says little of the rows, and nothing of those made from them: it would broadcast millions.
    """
    return F.broadcast(small) if rows <= broadcast_rows else small.hint("merge")


def sized_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    fanout: int = FANOUT,
    rows: int | None = None,
) -> DataFrame:
    """Join (``inner``, ``left`` or ``left_semi``) without ever gathering a hot key in one task.

    ``small`` must be cheap to count: checkpointed, or read from a written table; a caller
    that joins it twice passes the count as ``rows``. Up to
    ``broadcast_rows`` rows it is broadcast and ``big`` is not shuffled at all. Beyond
    that both sides are shuffled, each key spread over ``fanout`` salts; the salt is the
    scan partition, so equal rows spread too.
    """
    rows = small.count() if rows is None else rows
    if rows <= broadcast_rows:
        return big.join(sent_or_spread(small, rows, broadcast_rows), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fanout)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
    return salted.join(sent_or_spread(copies, rows, broadcast_rows), [*keys, "_salt"], how).drop("_salt")


def maybe_in(big: DataFrame, small: DataFrame, keys: list[str], rows: int, words: int = SIEVE_WORDS) -> DataFrame:
    """Rows of ``big`` whose key may be one of the ``rows`` in ``small``: all that are, and some
    others, so that a join afterwards shuffles few rows that it drops.

    Keys are hashed to the bits of at most ``words`` words, which are broadcast: about one other
    row in 16 stays while there are 16 bits a key, more beyond. ``keys`` have the same types on both sides.
    """
    words = max(1, min(words, rows // 4))
    hashed = F.xxhash64(*keys)
    place = {"_word": F.pmod(hashed, F.lit(words)), "_bit": F.shiftrightunsigned(hashed, 58).cast("int")}
    bits = small.select(*(c.alias(n) for n, c in place.items())).groupBy("_word")
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = big.withColumns(place).join(F.broadcast(bits), "_word")
    return marked.filter("(_bits & shiftleft(1L, _bit)) <> 0").drop("_word", "_bit", "_bits")


def missing_from(
    new: DataFrame, log: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of ``new`` whose key is not in the ever-growing ``log``.

    ``new`` must be cheap to count and hold each key once. While it is small the log is
    first cut down to matching keys by a broadcast, so the log is never shuffled.
    """
    known = log.select(*keys)
    if new.count() <= broadcast_rows:
        known = known.join(F.broadcast(new.select(*keys)), keys, "left_semi")
    return new.join(known, keys, "left_anti")


def with_parts(
    rows: DataFrame, keys: list[str], spread_by: list[str], limit: int
) -> DataFrame:
    """Adds ``part``: 0, or for a key with more than ``limit`` rows a number that splits
    it into pieces of about that size, so that nesting never gathers an unbounded group.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    long = cut(
        counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).alias("_parts"))
    )
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    return sized_join(rows, long, keys, "left").withColumn("part", part).drop("_parts")
