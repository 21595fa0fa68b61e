"""Mixing sources to target weights by exact word budgets.

Every row gets a hash-random key. Rows are ranged by that key within their source,
running sums of sizes are computed over the ranges, and each source is cut where its
budget ends, at a key inside one range; a budget beyond the source repeats it in epochs.
Each row then decides by its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.llm.common import CELL_ROWS, WORD, stored, whole, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
KEY_BITS = 60
SEED = "mix"


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """A number below 2**60 drawn from the id; the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Adds ``source_size`` and ``target`` to (source, source_rows, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the whole size. A
    share above ``max_epochs`` times its source stops there and the rest is shared anew. The
    sources that stop are those with the least size per weight: walking up that order, a
    source stops if the share per weight left for it and all after it is above its limit.
    One row per source, so a plain window over the sources is enough.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("__i") % len(weights) + 1)
    numbered = sizes.withColumn("__i", F.row_number().over(by_name) - 1).withColumn(
        "__w", weight.cast("double")
    )
    walk = Window.orderBy(F.col("source_size") / F.col("__w"), "__i")
    earlier = walk.rowsBetween(Window.unboundedPreceding, -1)
    rest = walk.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    limit = F.lit(max_epochs) * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(earlier), F.lit(0))
    walked = numbered.withColumn("__per", left / F.sum("__w").over(rest)).withColumn(
        "__stops", limit < F.col("__per") * F.col("__w")
    )
    # The first source that does not stop sets the share per weight of all that follow.
    share = F.min(F.when(~F.col("__stops"), F.struct("__order", "__per"))).over(everything)["__per"]
    walked = walked.withColumn("__order", F.row_number().over(walk)).withColumn("__share", share)
    target = F.when(F.col("__stops"), limit.cast("double")).otherwise(
        F.least(F.col("__share") * F.col("__w"), limit.cast("double"))
    )
    return walked.select("source", "source_rows", "source_size", "__i", target.alias("target"))


def cuts(
    rows: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Where each source's budget ends, one row per source, from stored doc_id, source, size.

    Keys are cut into equal ranges, about ``cell_rows`` rows each. Every range is summed
    map-side and the sums are added up in order; only the one range of a source that holds the
    end of its budget is sorted. Rows with one key, id and size count as one there.
    """
    sizes = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size")
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    shares = targets(sizes, weights, max_epochs).withColumnRenamed("source", "__source")
    shares = shares.withColumn("__epochs", epochs.cast("long"))
    shares = shares.withColumn("__last", (budget - F.col("__epochs") * F.col("source_size")).cast("long"))
    shares = stored(shares, "mix-shares")
    cells = F.ceil(F.col("source_rows") / cell_rows)
    keyed = (
        rows.select("doc_id", "source", "size", random_key(F.col("doc_id"), seed).alias("__key"))
        .join(shares, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__cell", F.floor(F.col("__key") / float(2**KEY_BITS) * cells))
    )

    def ended(sums: DataFrame, order: list[str]) -> DataFrame:
        """The row of each source, in order, whose ``__in`` words hold the end of the budget."""
        before = Window.partitionBy("__i").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("__in").over(before), F.lit(0)) + F.col("__start")
        found = sums.withColumn("__ahead", ahead)
        return found.filter((F.col("__ahead") < F.col("__last")) & (F.col("__ahead") + F.col("__in") >= F.col("__last")))

    sums = keyed.groupBy("__i", "__last", "__cell").agg(F.sum("size").alias("__in"))
    cut = ended(sums.withColumn("__start", F.lit(0)), ["__cell"])
    cut = stored(cut.select("__i", "__cell", F.col("__ahead").alias("__start")), "mix-cut-ranges")
    inside = keyed.join(cut, ["__i", "__cell"]).groupBy("__i", "__last", "__start", "__key", "doc_id", "size")
    inside = inside.agg(F.count(F.lit(1)).alias("__ties")).withColumn("__in", F.col("__ties") * F.col("size"))
    place = F.struct("__key", "doc_id", "size").alias("__at")
    at = ended(inside, ["__key", "doc_id", "size"]).select("__i", place, "__ahead", "__ties")
    return stored(shares.join(at, "__i", "left"), "mix-cuts")


def decide(rows: DataFrame, ends: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows, by the ends of their sources.

    A row takes part in a source's last epoch if its key comes before the end's; no row has
    to meet another, but for equal rows at an end, which are told apart at random.
    """
    place = F.struct(random_key(F.col("doc_id"), seed).alias("__key"), "doc_id", "size")
    found = rows.join(ends, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__here", place)
    is_end = F.coalesce(F.col("__here") == F.col("__at"), F.lit(False))
    if ends.filter("__ties > 1").isEmpty():
        each = found.withColumn("__nth", F.lit(0))
    else:
        tied = is_end & (F.col("__ties") > 1)
        nth = F.row_number().over(Window.partitionBy("__i").orderBy(F.lit(0))) - 1
        each = found.filter(tied).withColumn("__nth", nth)
        each = found.filter(~tied).withColumn("__nth", F.lit(0)).unionByName(each)
    rest = F.col("__last") - F.col("__ahead") - F.col("__nth") * F.col("size")
    last = (
        F.when(F.col("__here") < F.col("__at"), F.col("size"))
        .when(is_end, F.greatest(F.lit(0), F.least(rest, F.col("size"))))
        .otherwise(0)
    )
    taken = F.col("__epochs") * F.col("size") + last
    own = ["__source", "__i", "__epochs", "__last", "__at", "__ahead", "__ties", "__here", "__nth"]
    return each.withColumn("taken", taken.cast("long")).drop("source_rows", *own)


def mix(rows: DataFrame, **options) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to stored rows with doc_id, source and size.

    ``taken`` counts words with repeats: whole epochs, and in the last one every document up
    to the budget's end, the one at the cut in part. A source takes its target, rounded down.
    A null source is a source of its own; equal rows are told apart at random, which changes
    no row of the result; empty documents are taken with 0 words; no rows give no rows.
    Further columns are kept; names starting with two underscores are this module's own.
    Options are those of ``cuts``.
    """
    return decide(rows, cuts(rows, **options), options.get("seed", SEED))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document taken several times comes as several rows. The one at the cut keeps its text
    up to its last word taken (``n_chars``, if there, follows). Documents without a word take
    no part, nulls among them; a null id or source is as good as any; equal rows are documents
    each; no rows give no rows. The whole row travels as one struct, so no column name can
    clash. Texts are read twice, to be counted and to be passed on, and are not shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row).select(
        "row",
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        word_count(whole("row.text")).alias("size"),
    )
    sizes = stored(packed.select("doc_id", "source", "size"), "sizes")
    taken = decide(packed, cuts(sizes, **options), options.get("seed", SEED)).filter("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size"))
    each = each.withColumn("__words", words)
    # Only a document at a cut is split; the rest pass as they are.
    parts = F.split(F.col("row.text"), WORD, -1)
    hits = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    head = F.array_join(
        F.transform(
            F.slice(F.arrays_zip(parts.alias("gap"), hits.alias("hit")), F.lit(1), F.col("__words").cast("int")),
            lambda p: F.concat(p["gap"], p["hit"]),
        ),
        "",
    )
    each = each.withColumn("__head", F.when(F.col("__words") < F.col("size"), head))
    changed = {"text": F.col("__head"), "n_chars": F.char_length("__head")}
    out = []
    for name in docs.columns:
        own = F.col(f"row.`{name}`")
        new = changed.get(name)
        if new is not None:
            own = F.coalesce(new.cast(docs.schema[name].dataType), own)
        out.append(own.alias(name))
    return each.select(*out)
