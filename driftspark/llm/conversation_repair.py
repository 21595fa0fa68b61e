"""Conversation repair: the cheapest edits that make role sequences legal.

A conversation's signature has one symbol per row, its role and fault. What the rest of a
conversation costs depends on that rest alone, so signatures are read from the end: equal
suffixes are one node of an automaton, and its cost-to-go and best edits in every grammar
state are found once. Distinct signatures are sorted by their reversal, which lists the
automaton depth first: a task keeps only the nodes of the signature at hand and adds those
that the one before did not have. Nodes that decide alike, up to a constant cost, are merged.

Edits: K keeps a row, R gives it the other role, D deletes it, I inserts an empty one. The
grammar of role initials is (s?(ua)+)?.
"""

from __future__ import annotations

import hashlib
import os
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftspark.llm.common import stored
from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space, sentence endings, and what edits cost.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDINGS = ".!?"
REROLE, DELETE, INSERT, UNDELETED_TRUNCATED = 1, 2, 5, 5
# Damage by crc32(conv_id:turn) % 20.
DROP, EMPTY, STRIP, REPEAT, AS_USER = range(5)

# Grammar states: nothing yet, after s, after u, after a. Only the first and last may end.
STATES = range(4)
NOTHING, AFTER = 0, {"s": 1, "u": 2, "a": 3}
WANTED = "uuau"  # the role besides an opening s that each state asks for
FULL_ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
# Signatures and audits go to every task up to so many bytes; beyond, they are salted.
BROADCAST_BYTES = 32 << 20
SALTS = 16

LEGAL = ("su", "ua", "au")


# --- damage and faults ----------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after damage, dropped ones marked."""

    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == EMPTY, "").when(
        F.col("__kind") == STRIP, F.translate("text", ENDINGS, "")
    )
    times = F.when(F.col("__kind") == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("__kind") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.coalesce(text, "text").alias("text"),
        (F.col("__kind") == DROP).alias("dropped"),
        F.explode(times).alias("__time"),
    ).drop("__time")


def _order() -> list[Column]:
    """Rows of a conversation: by turn, then by role and digest of the text, copies side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_id")]


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_id, dropped, fault): one fault a row or none, without texts."""
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        F.sha2("text", 256).alias("text_id"),
        "dropped",
        (core == "").alias("__blank"),
        (~F.right(core, F.lit(1)).isin(*ENDINGS)).alias("__open"),
    )
    alike = Window.partitionBy("conv_id", "role", "text_id", "dropped").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("dropped"), None)
        .when(F.col("__blank"), "blank")
        .when(F.row_number().over(alike) > 1, "duplicate")
        .when(F.col("__open"), "truncated")
    )
    return light.withColumn("fault", fault).drop("__blank", "__open")


# --- signatures ------------------------------------------------------------------------------------

FRAGMENT = (
    "part int, signature string, illegal long, blank long, duplicate long, truncated long,"
    " turns long, low long, high long, first string, last string, first_turn long, last_turn long"
)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in a sorted task; a long one may go on in the next task."""
    part, names = TaskContext.get().partitionId(), [f.split()[0] for f in FRAGMENT.split(", ")]
    nobody = object()

    def fresh() -> dict:
        return {
            "signature": [], "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "turns": 0,
            "low": None, "high": None, "first": None, "last": None, "first_turn": None, "last_turn": None,
        }

    conv, now, done = nobody, fresh(), []

    def close() -> None:
        if conv is not nobody:
            done.append({"conv_id": conv, **now, "part": part, "signature": "".join(now["signature"])})

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([d["conv_id"] for d in done], schema.field("conv_id").type)]
        for n in names:
            kind = pa.int32() if n == "part" else pa.string() if n in ("signature", "first", "last") else pa.int64()
            columns.append(pa.array([d[n] for d in done], kind))
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "dropped", "fault"))):
            if row[0] != conv:
                close()
                conv, now = row[0], fresh()
            _, turn, role, dropped, fault = row
            if dropped:
                continue
            initial = role[:1] if role[:1] in AFTER else "o"
            if now["first"] is None:
                now["first"], now["first_turn"] = initial, turn
            elif now["last"] + initial not in LEGAL:
                now["illegal"] += 1
            if turn is not None:
                now["turns"] += turn != now["last_turn"]
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"] = turn
            now["last"], now["last_turn"] = initial, turn
            if fault:
                now[fault] += 1
            delete = fault in ("blank", "duplicate")
            now["signature"].append("x" if delete else initial.upper() if fault else initial)
        yield flush(schema)
    close()
    if done:
        yield flush(schema)


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, signature, gaps and counts of faults.

    A signature has a letter per row: x for one that must go, else the role's initial (o for
    others), in upper case if truncated. Rows are dealt by ranges of (conversation, place), so
    that a long conversation spans many tasks; its pieces are joined here.
    """
    light = stored(faults(rows), "faults")
    place = [F.col("conv_id"), *_order()]
    sorted_rows = light.repartitionByRange(*place).sortWithinPartitions(*place)
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "dropped", "fault"]
    pieces = sorted_rows.select(*columns[:1], F.col("turn").cast("long").alias("turn"), *columns[2:])
    pieces = pieces.mapInArrow(tidy(_fragments), f"conv_id {kind}, {FRAGMENT}")
    names = [f.split()[0] for f in FRAGMENT.split(", ")]
    joined = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all"))
    # Pieces of dropped rows only have no first role.
    some = F.filter("all", lambda p: p["first"].isNotNull())
    joined = joined.select("conv_id", some.alias("some"))
    seams = F.when(F.size("some") > 1, F.sequence(F.lit(1), F.size("some") - 1)).otherwise(F.array().cast("array<int>"))

    def total(name: str) -> Column:
        return F.aggregate("some", F.lit(0).cast("long"), lambda n, p: n + p[name])

    def at_seams(fact) -> Column:
        """How often ``fact(before, after)`` holds for neighbouring pieces."""
        holds = F.transform(seams, lambda i: fact(F.get("some", i - 1), F.get("some", i)))
        return F.size(F.filter(holds, lambda h: h)).cast("long")

    clash = at_seams(lambda a, b: ~F.concat(a["last"], b["first"]).isin(*LEGAL))
    same = at_seams(lambda a, b: F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)))
    low = F.array_min(F.transform("some", lambda p: p["low"]))
    high = F.array_max(F.transform("some", lambda p: p["high"]))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("some", lambda p: p["signature"]), "").alias("signature"),
        F.coalesce(high - low + 1 - (total("turns") - same), F.lit(0)).cast("long").alias("gaps"),
        *[total(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        (total("illegal") + clash).alias("illegal"),
    )


# --- the automaton ---------------------------------------------------------------------------------


class Node(NamedTuple):
    """What to do with a symbol and all after it, in every grammar state.

    ``ahead`` are the costs to go above ``least``; ``edits`` are the letters up to and with
    the one that uses the symbol up, and the state that follows.
    """

    least: int
    ahead: tuple[int, ...]
    edits: tuple[tuple[str, int], ...]


def _settled(options: list[list[tuple[int, str, int]]]) -> Node:
    """The node whose states have the given (cost, letter, next state) besides inserting.

    Of equal costs the smallest letter wins. Different letters start different audits, so
    that this gives the least audit too.
    """
    best = [min(o, default=(NEVER, "", 0)) for o in options]
    edits: list[tuple[str, int]] = [(letter, to) for _, letter, to in best]
    costs = [c for c, _, _ in best]
    # An insertion leads from every state to the one after the wanted role: first settle the
    # two that lead to each other, then the others. Two in a row bring one back.
    two = AFTER["u"], AFTER["a"]
    plain = list(costs), list(edits)
    for state in (*two, NOTHING, AFTER["s"]):
        to = AFTER[WANTED[state]]
        source = plain if state in two else (costs, edits)
        offer = INSERT + source[0][to]
        if offer < plain[0][state] or (offer == plain[0][state] and "I" < plain[1][state][0][:1]):
            costs[state], edits[state] = offer, ("I" + source[1][to][0], source[1][to][1])
    least = min(costs)
    return Node(least, tuple(c - least for c in costs), tuple(edits))


END = _settled([[(0, "", s)] if s in (NOTHING, AFTER["a"]) else [] for s in STATES])


@cache
def step(symbol: str, ahead: tuple[int, ...]) -> Node:
    """The node of a symbol before a node with costs ``ahead``; nodes that decide alike are one."""
    options = []
    for state in STATES:
        offers = [(DELETE + ahead[state], "D", state)]
        if symbol != "x":
            extra = UNDELETED_TRUNCATED if symbol.isupper() else 0
            initial, wanted = symbol.lower(), WANTED[state]
            if initial == wanted or (initial == "s" and state == NOTHING):
                offers.append((extra + ahead[AFTER[initial]], "K", AFTER[initial]))
            offers.append((REROLE + extra + ahead[AFTER[wanted]], "R", AFTER[wanted]))
        options.append(offers)
    return _settled(options)


class Automaton:
    """The nodes of one signature's suffixes, kept as far as the next signature shares them."""

    def __init__(self):
        self.path, self.nodes, self.costs = "", [END], array("q", [END.least])
        self.made = 0

    def audit(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of a reversed signature. Sorted ones make each node once."""
        shared = len(os.path.commonprefix([self.path, backwards]))
        del self.nodes[shared + 1 :], self.costs[shared + 1 :]
        for symbol in backwards[shared:]:
            node = step(symbol, self.nodes[-1].ahead)
            self.nodes.append(node)
            self.costs.append(self.costs[-1] + node.least)
            self.made += 1
        self.path = backwards
        letters, state = [], NOTHING
        for node in reversed(self.nodes):
            edit, state = node.edits[state]
            letters.append(edit)
        return self.costs[-1] + self.nodes[-1].ahead[NOTHING], "".join(letters)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.audit(b) for b in batch.column("backwards").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            ["signature", "cost", "audit"],
        )


def audits(conversations: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures."""
    distinct = stored(conversations.select("signature").distinct(), "signatures")
    backwards = distinct.withColumn("backwards", F.reverse("signature"))
    ordered = backwards.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return ordered.mapInArrow(tidy(_audits), "signature string, cost long, audit string")


# --- repaired conversations ------------------------------------------------------------------------


def _repair(columns: list[str]):
    """Rows after their conversation's header, to one result row per conversation."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, at, state, text_hash, first, done = None, 0, NOTHING, None, True, []

        def put(role: str, text: str) -> None:
            nonlocal first, state
            line = f"{role}:{text}" if first else f"\n{role}:{text}"
            text_hash.update(line.encode("utf-8", "surrogatepass"))
            first, state = False, AFTER[role[:1]]

        def inserts() -> None:
            nonlocal at
            audit = header["audit"]
            while at < len(audit) and audit[at] == "I":
                put(FULL_ROLE[WANTED[state]], "")
                at += 1

        def close() -> None:
            if header is not None:
                inserts()
                done.append({**header, "repaired_sha256": text_hash.hexdigest()})

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            kinds = [schema.field(c).type for c in columns] + [pa.string()]
            names = [*columns, "repaired_sha256"]
            arrays = [pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        schema = None
        for batch in batches:
            schema = batch.schema
            is_row = batch.column("is_row").to_pylist()
            rows = list(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()))
            heads = batch.select(columns)
            for i, (role, text) in enumerate(rows):
                if not is_row[i]:
                    close()
                    header = {c: heads.column(c)[i].as_py() for c in columns}
                    at, state, text_hash, first = 0, NOTHING, hashlib.sha256(), True
                    continue
                inserts()
                edit, at = header["audit"][at], at + 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put(FULL_ROLE[WANTED[state]], text)
            yield flush(schema)
        close()
        if done:
            yield flush(schema)

    return repair


def repair(conversations: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and
    the digest of the repaired conversation, after the damage that ``damaged`` does.

    A null role or text counts as one space; rows without a turn come first; rows with one
    turn are ordered by role and text digest; a null conv_id is a conversation of its own, and
    one that lost all rows has zeros. No rows give no rows; other columns are not looked at.

    Tasks read sorted rows one by one and hold no whole conversation: its audit, a letter per
    row, and its digest are what the result itself asks for. The digest of one conversation
    runs over its texts in order, so these pass through one task.
    """
    rows = damaged(conversations)
    found = stored(signatures(rows), "conversations")
    best = stored(audits(found), "audits")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    size = best.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        heads = found.join(F.broadcast(best), "signature")
    else:  # a signature may be that of a third of all conversations
        salted = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
        heads = found.withColumn("__salt", salt).join(salted, ["signature", "__salt"])
    columns = ["conv_id", *counts, "cost", "audit"]
    heads = heads.select(*columns, F.lit(False).alias("is_row"))
    texts = rows.filter(~F.col("dropped")).select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("text_id"), "text", F.lit(True).alias("is_row")
    )
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_order())
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in [*counts, 'cost'])}, audit string, repaired_sha256 string"
    return ordered.select(*columns, "is_row", "role", "text").mapInArrow(tidy(_repair(columns)), schema)
