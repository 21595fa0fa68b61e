"""Token statistics for every context limit from one exact length histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftspark.llm.common import running_total, stored
from driftspark.llm.tokens import encoded_lengths, tokenizer_path

CELL_WIDTH = 4096


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, documents): aggregated map-side, one row per distinct length."""
    lengths = encoded_lengths(docs, path or tokenizer_path())
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(
        F.count(F.lit(1)).alias("documents")
    )


def context_statistics(histogram: DataFrame, cell_width: int = CELL_WIDTH) -> DataFrame:
    """One row per distinct length, taken as a context limit.

    length, documents (of that length), tokens (theirs), docs_longer and tokens_longer
    (suffix sums over greater lengths), total_tokens up to here, truncated_total (sum of
    min(length, limit)), lost_tokens, quantile (share of documents not longer). A limit between
    two lengths follows from the row below it: lost tokens change by docs_longer per token.
    Sums run over ranges of lengths first, so no task holds all of them. No rows give no rows.
    """
    counted = histogram.select(
        F.lit(0).alias("all"),
        "length",
        "documents",
        (F.col("length") * F.col("documents")).alias("tokens"),
        # From the longest down: the sums before a row are its suffix sums.
        F.floor(-F.col("length") / cell_width).alias("cell"),
        (-F.col("length")).alias("down"),
    )
    counted = stored(counted, "length-histogram")
    docs = running_total(counted, ["all"], "cell", ["down"], "documents", "docs_longer")
    both = running_total(docs, ["all"], "cell", ["down"], "tokens", "tokens_longer")
    n, tokens = counted.agg(F.sum("documents"), F.sum("tokens")).first()
    shorter = F.lit(tokens or 0) - F.col("tokens_longer")
    truncated = shorter + F.col("docs_longer") * F.col("length")
    return both.select(
        "length",
        "documents",
        "tokens",
        "docs_longer",
        "tokens_longer",
        shorter.alias("total_tokens"),
        truncated.alias("truncated_total"),
        (F.lit(tokens or 0) - truncated).alias("lost_tokens"),
        (1 - F.col("docs_longer") / F.lit(n or 1)).alias("quantile"),
    )
