"""Expressions over landing paths, archive member names and sample urls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Upload kinds, metric families and the baseline's sensor name.
FILE_TYPES = ("stats", "data")
METRIC_TYPES = ("imgstats", "modelstats", "samples", "customstats")
REFERENCE = "reference"

LANDING = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.tar\.gz$"
MEMBER = r"^(?:\./)?([^/]+)/([^/]+)$"
SAMPLE_TIME = r"_(\d+)\.png"
DAY_MICROS = 86_400_000_000


def landing_part(path: Column, part: str) -> Column:
    group = {"file_type": 1, "sensor_id": 2, "timestamp": 3, "stem": 4}[part]
    return F.regexp_extract(path, LANDING, group)


def member_metrictype(member: Column) -> Column:
    return F.regexp_extract(member, MEMBER, 1)


def member_file(member: Column) -> Column:
    return F.regexp_extract(member, MEMBER, 2)


def split_name(file_name: Column) -> tuple[Column, Column]:
    """Metric and submetric: cut at the first underscore, then drop every '.bin'."""
    cut_at = F.instr(file_name, "_")
    head = F.when(cut_at > 0, F.substring(file_name, F.lit(1), cut_at - 1)).otherwise(file_name)
    tail = F.when(cut_at > 0, F.substring(file_name, cut_at + 1, F.length(file_name))).otherwise("")
    clean = lambda c: F.replace(c, F.lit(".bin"), F.lit(""))
    return clean(head), clean(tail)


def is_sketch_file(file_name: Column) -> Column:
    return file_name.endswith(".bin") & ~file_name.startswith("._")


def url_micros(url: Column) -> Column:
    """Epoch microseconds named in a sample url, NULL when there are none."""
    return F.regexp_extract(url, SAMPLE_TIME, 1).try_cast("bigint")


def micros_text(micros: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS.ffffff UTC', whatever the session time zone is.

    NULL passes through every part, so no branch hides the shared subexpressions from
    code generation.
    """
    rest = F.pmod(micros, F.lit(DAY_MICROS))
    day = F.date_from_unix_date(((micros - rest) / F.lit(DAY_MICROS)).try_cast("int"))
    second = (rest / F.lit(1_000_000)).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    colon = F.lit(":")
    fraction = F.lpad((rest % 1_000_000).cast("string"), 6, "0")
    return F.concat(
        day.cast("string"),
        F.lit(" "),
        two(second / 3600),
        colon,
        two((second / 60).cast("int") % 60),
        colon,
        two(second % 60),
        F.lit("."),
        fraction,
        F.lit(" UTC"),
    )


def url_timestamp(url: Column) -> Column:
    return micros_text(url_micros(url))
