"""Conversation repair against a plain search over all edits, one conversation at a time."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from driftspark.llm import conversation_repair as cr

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(show).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out.append((conv, [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), by trying every edit."""

    @cache
    def best(i, state, inserted):
        offers = [(0, "", ())] if i == len(rows) and state in "-a" else []
        follows = {"-": "su", "s": "u", "u": "a", "a": "u"}[state]
        asked = follows[-1]
        name = {"u": "user", "a": "assistant"}[asked]

        def go(price, letter, line, then):
            c, a, lines = then
            return (c + price, letter + a, ((line,) if line is not None else ()) + lines)

        if inserted < 3:
            offers.append(go(5, "I", name + ":", best(i, asked, inserted + 1)))
        if i < len(rows):
            role, text, fault = rows[i]
            offers.append(go(2, "D", None, best(i + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if role[:1] and role[:1] in follows:
                    offers.append(go(extra, "K", f"{role}:{text}", best(i + 1, role[:1], 0)))
                offers.append(go(1 + extra, "R", f"{name}:{text}", best(i + 1, asked, 0)))
        return min(offers, default=(10**9, "", ()))

    return best(0, "-", 0)


def brute_force(rows):
    convs = defaultdict(list)
    for conv, after in damage(rows):
        convs[conv] += after
    out = {}
    for conv, after in convs.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in after:
            core = text.rstrip(SPACES)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(x == f for _, _, x in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, lines = cheapest(tuple(judged))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(found):
    rows = found.select(*COLUMNS).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def random_rows(seed, conversations):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Yes.", "No?", "Go on!  \n", "cut off", "", " \t\n", None, "a.b", "?", "é.", "naïve…"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, 9)):
            if rng.random() < 0.9:
                role = roles[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
                text = f"Part {rng.randint(0, 30)}." if rng.random() < 0.5 else rng.choice(texts)
                rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
    return rows


@pytest.mark.parametrize("broadcast_bytes", [cr.BROADCAST_BYTES, 0])
def test_random_conversations(spark, broadcast_bytes):
    rows = random_rows(1, 400)
    found = cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(9), broadcast_bytes)
    assert found.columns == COLUMNS
    assert rows_of(found) == brute_force(rows)


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(cr.repair(table)) == brute_force(map(tuple, table.collect()))


def test_odd_conversations(spark):
    """Null ids and turns, repeated rows, very long texts, clashing columns, empty tables."""
    rows = [(None, t, r, x) for t, r, x in [(None, "user", "a."), (None, None, None), (3, "assistant", "b.")]]
    rows += [(7, 1, "user", "Same.")] * 3 + [(7, 2, "assistant", "x" * 2_000_000 + ".")]
    rows += [(8, -5, "assistant", "First?"), (8, 2**40, "assistant", "Last.")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS audit", "2 AS signature", "3 AS is_row", "4 AS fault")
    assert rows_of(cr.repair(table)) == brute_force(rows)
    assert cr.repair(table.limit(0)).collect() == []


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = cr.repair(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_conversation_of_most_rows(spark):
    """It spans several range tasks, whose pieces are joined, and comes out as one row."""
    rows = [(1, t // 2 if t < 50 else t, ("user", "assistant")[t % 2], f"Text {t % 40}{'.' * (t % 7 > 0)}") for t in range(160)]
    rows += random_rows(2, 40)[:90]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert rows_of(found) == brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_suffixes_are_one_node():
    """Sorted reversed signatures make as many nodes as there are distinct suffixes."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("suaxUA") for _ in range(rng.randint(0, 8))) for _ in range(500)})
    automaton, fresh = cr.Automaton(), {}
    for word in sorted(w[::-1] for w in words):
        fresh[word] = automaton.audit(word)
    assert automaton.made == len({w[i:] for w in words for i in range(len(w))})
    assert all(cr.Automaton().audit(w) == found for w, found in fresh.items())


def test_a_million_rows_take_little():
    """Nodes that decide alike are merged, so that a long signature adds numbers, not nodes."""
    before = cr.step.cache_info().currsize
    cost, audit = cr.Automaton().audit("auxUoS" * 200_000)
    assert cost > 0 and len(audit) >= 1_200_000
    assert cr.step.cache_info().currsize - before < 500
