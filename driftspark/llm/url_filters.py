"""Temporal list join: which list entries were active when a page was fetched.

A list is a log of dated additions and removals of hosts or domains. The log becomes
validity intervals, and every capture is joined as of its fetch time with the intervals of
its host and of the domains above it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.llm.common import stored
from driftspark.operators.joins import sized_join

# The list is broadcast up to so many rows and bytes of names.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; '' where there is none."""
    authority = F.regexp_extract(whole_url(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def whole_url(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit("")))


def domains(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c. Empty for an empty host."""
    labels = F.split(host, r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(host != "", above).otherwise(F.array().cast("array<string>"))


def domains_up_to(host: Column, longest: int) -> Column:
    """The ``domains`` of at most ``longest`` characters, whatever the length of the host."""
    # The end with one character more holds all of them, and at most one more, cut or whole.
    return F.filter(domains(F.right(host, F.lit(longest + 1))), lambda d: F.char_length(d) <= longest)


def validity_intervals(log: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to) from (entry, category, day, added).

    An addition holds until the next change of the same entry and category; valid_to is
    exclusive, null while it still holds. Repeated additions continue one another; of an
    addition and a removal on the same day the removal counts. Rows without an entry or a day
    are left out: they name nothing or no time.
    """
    named = log.filter("entry is not null and day is not null")
    daily = named.groupBy("entry", "category", "day").agg(
        F.min(F.coalesce("added", F.lit(False))).alias("added")
    )
    w = Window.partitionBy("entry", "category").orderBy("day")
    return (
        daily.withColumn("valid_to", F.lead("day").over(w))
        .filter("added")
        .select("entry", "category", F.col("day").alias("valid_from"), "valid_to")
    )


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def filter_captures(captures: DataFrame, log: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per capture (page_id, url, fetched): page_id, host, fetched, n_active,
    blocked, and the entry and category that decide: the most specific active one, of several
    categories the first (null first).

    Intervals are cut into months, so that the join is on (domain, month) and an entry with a
    long history does not meet in one place. Hosts are looked up once per day, not once per
    page, and only by names no longer than the longest entry, so that a very long url costs no
    more than its own length. A list counted small is broadcast, so that no name is shuffled;
    beyond that each (domain, month) is spread over several tasks.

    A capture without host or fetch day is active on no list; equal rows each give a row; no
    rows give no rows; an empty list blocks nothing. Other columns, of whatever name, are
    ignored in both tables.
    """
    pages = captures.select("page_id", url_host(F.col("url")).alias("host"), "fetched")
    visits = pages.filter("host <> '' and fetched is not null").select("host", "fetched").distinct()
    # What still holds, holds until the day after the last fetch.
    last = captures.agg(F.max("fetched")).first()[0] or date(1970, 1, 1)
    to = F.coalesce("valid_to", F.date_add(F.lit(last), 1))
    # The filter on the interval may be moved behind this, so the end never precedes the start.
    months = F.sequence(_month(F.col("valid_from")), F.greatest(_month(F.col("valid_from")), _month(to)))
    intervals = validity_intervals(log).filter(F.col("valid_from") < to).select(
        "entry", "category", "valid_from", to.alias("valid_to"), F.explode(months).alias("month")
    )
    cut = stored(intervals, "intervals")
    size = F.sum(F.octet_length("entry") + F.coalesce(F.octet_length("category"), F.lit(0)))
    rows, held, longest = cut.agg(F.count(F.lit(1)), size, F.max(F.char_length("entry"))).first()
    asked = visits.withColumn("entry", F.explode(domains_up_to(F.col("host"), longest or 0))).withColumn(
        "month", _month(F.col("fetched"))
    )
    most = broadcast_rows if (held or 0) <= BROADCAST_BYTES else -1
    active = sized_join(asked, cut, ["entry", "month"], broadcast_rows=most, rows=rows).filter(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("valid_to"))
    )
    decided = active.groupBy("host", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.min(F.struct(-F.char_length("entry"), "category", "entry")).alias("top"),
    )
    return pages.join(decided, ["host", "fetched"], "left").select(
        "page_id",
        "host",
        "fetched",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"),
        F.col("top.entry").alias("entry"),
        F.col("top.category").alias("category"),
    )
