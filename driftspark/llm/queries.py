"""The operators over the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftspark.llm import (
    conversation_repair,
    cost_packing,
    exact_dedup,
    language,
    manifest,
    mixing,
    packing,
    pii,
    quality,
    secret_scan,
    simhash,
    token_counts,
    url_filters,
)
from driftspark.llm.common import stored, whole, word_count
from driftspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

FIRST_DAY = "2024-01-01"
DAYS = 366
# The longest name that the domain name system allows.
LONGEST_NAME = 253


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = word_count(whole("text")).alias("size")
    rows = stored(documents(spark, sf_dir).select("doc_id", "source", size), "sizes")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(documents(spark, sf_dir))
    return token_counts.context_statistics(histogram)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch day: the table names none, so it follows from the page's number."""
    day = F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), day)
    return table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))


def list_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list of hosts and domains that the pages themselves name: each is added and
    removed every few weeks, at days that follow from its length and first letters."""
    host = url_filters.url_host(F.col("url"))
    names = F.explode(url_filters.domains_up_to(host, LONGEST_NAME)).alias("entry")
    named = captures(spark, sf_dir).select(names).distinct().filter("length(entry) - length(replace(entry, '.', '')) > 0")
    step = F.char_length("entry") * 3 + 10
    times = F.sequence(F.lit(0), F.floor(F.lit(DAYS) / step).cast("int"))
    each = named.withColumn("nth", F.explode(times)).withColumn("shift", F.ascii("entry") % 40)
    return each.filter(F.char_length("entry") % 3 > 0).select(
        "entry",
        F.when(F.char_length("entry") % 2 == 0, "adult").otherwise("malware").alias("category"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("nth") * step + F.col("shift")).cast("int")).alias("day"),
        (F.col("nth") % 2 == 0).alias("added"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_captures(captures(spark, sf_dir), list_log(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(documents(spark, sf_dir))


def op11_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(documents(spark, sf_dir))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_mixing,
            op2_secrets,
            op3_exact_dedup,
            op4_pii,
            op5_packing,
            op6_simhash,
            op7_quality,
            op8_token_counts,
            op9_url_filters,
            op10_language,
            op11_cost_packing,
            op12_manifest,
            op13_conversation_repair,
        )
    }
