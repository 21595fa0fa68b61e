"""Merkle manifest of a dataset: one root over all rows, and a proof for each.

Rows are leaves, in order within their source; every three neighbours become their digest
until a source has one node, and the sources' nodes become the root in the same way. A
superblock is an aligned run of 3**BLOCK_LEVELS nodes. Going up, each superblock is reduced
to its top node alone. Coming down, a superblock's nodes are cogrouped with what its top
needs from outside, so that the reduction inside, the joining of proofs and the folding of
each row up to the root are finished in one place, whatever the size of a source.
"""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARITY = 3
BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- leaves -----------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    value = value.cast("string")
    counted = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(counted, F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, current): digests of the rows as listed and as found now.

    ``current`` is the leaf after the tampering that the manifest is checked against: where 2
    divides the CRC-32 of the id, the text has lost its line feeds.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))

    def leaf(text: Column) -> Column:
        parts = [_field(text if name == "text" else F.col(name)) for name in FIELDS]
        return F.sha2(F.concat(*parts), 256)

    same = found.eqNullSafe(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(~same, leaf(found)).alias("other"))
    return rows.select("doc_id", "source", "leaf", F.coalesce("other", "leaf").alias("current"))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``pos``: the place of each row of the stored table within its group, from 0.

    Rows are dealt by ranges of (group, order) and sorted there, so that a large group lies in
    many ranges; the ranges' counts are added up. Equal rows are told apart at random.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    place = [*group, *order, "__tie"]
    ranged = tied.repartitionByRange(*place).sortWithinPartitions(*place).drop("__tie")
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    # Such an id counts the rows of a partition in its lower 33 bits.
    part = F.shiftright("__at", 33)
    runs = ranged.groupBy(*group, part.alias("__run")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(g).alias(f"__{g}") for g in group],
        "__run",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [part == F.col("__run")]
    placed = ranged.join(runs, same).withColumn("pos", F.col("__at") + F.col("__shift"))
    return placed.drop("__at", "__run", "__shift", *[f"__{g}" for g in group])


# --- superblocks ------------------------------------------------------------------------------


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_levels(nodes: int, most: int) -> int:
    """Levels that a superblock of a tree with so many nodes is reduced by."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def reduced(hashes: list[str], levels: int) -> list[list[str]]:
    """All levels from the given nodes to their top."""
    out = [hashes]
    for _ in range(levels):
        row = out[-1]
        out.append([digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[str]:
    """Siblings of node ``i`` up to the top: those before it, those after it, of each level."""
    path = []
    for row in levels[:-1]:
        run = i - i % ARITY
        path += ["".join(row[run:i]), "".join(row[i + 1 : run + ARITY])]
        i //= ARITY
    return path


def fold(node: str, path: list[str]) -> str:
    for before, after in zip(path[::2], path[1::2]):
        node = digest(before + node + after)
    return node


class Superblocks:
    """The nodes of one step on the way up: (tree, nodes, block, pos, hash) and further columns."""

    def __init__(self, nodes: DataFrame, block_levels: int):
        self.most = block_levels
        size = ARITY**block_levels
        self.nodes = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(size)))

    def tops(self) -> DataFrame:
        """One row per superblock: the nodes of the next step."""
        most, size = self.most, ARITY**self.most

        def top(group: pd.DataFrame) -> pd.DataFrame:
            first = group.iloc[0]
            hashes = group.sort_values("pos")["hash"].tolist()
            levels = reduced(hashes, block_levels(int(first["nodes"]), most))
            tree, pos = int(first["tree"]), int(first["pos"]) // size
            return pd.DataFrame(
                {"tree": [tree], "nodes": [-(-int(first["nodes"]) // size)], "pos": [pos], "hash": levels[-1]}
            )

        few = self.nodes.select("tree", "nodes", "block", "pos", "hash")
        return few.groupBy("tree", "block").applyInPandas(top, "tree long, nodes long, pos long, hash string")

    def paths(self, outer: DataFrame) -> DataFrame:
        """(tree, pos, path, subroot, root) of every node, given those of the tops.

        ``subroot`` is the node's own hash where the tops have none.
        """
        most = self.most

        def join(nodes: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
            nodes, top = nodes.sort_values("pos"), tops.iloc[0]
            hashes, outside = nodes["hash"].tolist(), list(top["path"])
            levels = reduced(hashes, block_levels(int(nodes["nodes"].iloc[0]), most))
            out = nodes[["tree", "pos"]].copy()
            out["path"] = [path_of(levels, i) + outside for i in range(len(hashes))]
            out["subroot"] = hashes if top["subroot"] is None else top["subroot"]
            out["root"] = top["root"]
            return out

        few = self.nodes.select("tree", "nodes", "block", "pos", "hash")
        schema = "tree long, pos long, path array<string>, subroot string, root string"
        return few.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(join, schema)

    def verify(self, outer: DataFrame, kind: str) -> DataFrame:
        """The manifest's rows of every leaf, given the paths of the tops."""
        most = self.most

        def join(nodes: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
            nodes, top = nodes.sort_values("pos"), tops.iloc[0]
            hashes, outside = nodes["hash"].tolist(), list(top["path"])
            levels = reduced(hashes, block_levels(int(nodes["nodes"].iloc[0]), most))
            beyond = "".join(outside)
            own_top, proofs, folded = fold(levels[-1][0], outside), [], []
            for i, current in enumerate(nodes["current"].tolist()):
                path = path_of(levels, i)
                proofs.append(digest("".join(path) + beyond))
                here = fold(current, path)
                folded.append(own_top if here == levels[-1][0] else fold(here, outside))
            out = pd.DataFrame({"doc_id": nodes["doc_id"].array, "leaf": hashes})
            out["subroot"], out["root"] = top["subroot"], top["root"]
            out["proof_sha256"], out["folded_root"] = proofs, folded
            out["verified"] = out["folded_root"] == top["root"]
            return out

        schema = (
            f"doc_id {kind}, leaf string, subroot string, root string,"
            " proof_sha256 string, folded_root string, verified boolean"
        )
        few = self.nodes.select("tree", "nodes", "block", "pos", "hash", "doc_id", "current")
        return few.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(join, schema)


def _climb(nodes: DataFrame, most_nodes: int, block_levels: int) -> tuple[list[Superblocks], DataFrame]:
    """Steps up until every tree has one node, and those nodes."""
    steps = []
    while True:
        steps.append(Superblocks(nodes, block_levels))
        nodes = stored(steps[-1].tops(), "tops")
        most_nodes = -(-most_nodes // ARITY**block_levels)
        if most_nodes <= 1:
            return steps, nodes


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf``, ``subroot``, ``root`` and the proof are of the rows as listed; ``folded_root`` is
    what the row found now leads to along its proof. Nulls in any field have a digest of their
    own; a null source comes first, and so does a null id within its source; equal rows are
    leaves each; a source of one row is its own node. No rows give no rows. Columns other than
    FIELDS are not looked at.

    A task holds one superblock, at most 3**block_levels leaves without their texts. Only the
    sizes of the largest source and of the list of sources reach the driver.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(leaves(docs), "leaves")
    counts = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("nodes")), "source-counts")
    sources, largest = counts.agg(F.count(F.lit(1)), F.max("nodes")).first()
    # Sources are few beside their rows; their places come like those of rows.
    trees = numbered(counts, [], ["source"], "source-order")
    trees = stored(trees.select(F.col("source").alias("__of"), "nodes", F.col("pos").alias("tree")), "trees")
    placed = numbered(rows, ["source"], ["doc_id", "leaf"], "leaf-order")
    placed = placed.join(trees, F.col("source").eqNullSafe(F.col("__of"))).select(
        "tree", "nodes", "pos", F.col("leaf").alias("hash"), "doc_id", "current"
    )
    steps, subroots = _climb(stored(placed, "leaf-places"), largest or 0, block_levels)
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sources).alias("nodes"), F.col("tree").alias("pos"), "hash")
    upper, root = _climb(top, sources, block_levels)
    outer = root.select(
        "tree", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")
    )
    for step in reversed(upper[1:]):
        outer = stored(step.paths(outer).withColumn("subroot", F.lit(None).cast("string")), "paths")
    # The nodes of this step are the subroots; below, they are the tops of their sources.
    outer = stored(upper[0].paths(outer), "paths").withColumn("tree", F.col("pos")).withColumn("pos", F.lit(0).cast("long"))
    for step in reversed(steps[1:]):
        outer = stored(step.paths(outer), "paths")
    return steps[0].verify(outer, kind)
