"""Mixing against a brute-force share-out and the exact budgets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from driftspark.llm import mixing as mx
from driftspark.llm.common import whole, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def mixed(docs, **options):
    rows = docs.select("doc_id", "source", word_count(whole("text")).alias("size"))
    return mx.mix(rows, **options)


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("cell_rows", [mx.CELL_ROWS, 3])
def test_mix(source, cell_rows, request):
    docs = request.getfixturevalue(source)
    want = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect())
    sizes = defaultdict(int)
    for (_, s, n), times in want.items():
        sizes[s] += n * times
    target = shares(sizes)
    rows = mixed(docs, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == want
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - floor(target[s])) <= 1
    again = mixed(docs, cell_rows=1_000_000).select("doc_id", "source", "size", "taken")
    assert again.exceptAll(mixed(docs, cell_rows=cell_rows).select(*again.columns)).isEmpty()


def test_small_sources_stop_at_three_epochs(spark):
    rows = [(i, "a", 100) for i in range(50)] + [(100, "b", 10), (101, "c", 7), (102, None, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.source: r.target for r in mx.mix(df).collect()}
    sizes = {"a": 5000, "b": 10, "c": 7, None: 1000}
    assert got == pytest.approx(shares(sizes)) and got["b"] == 30 and got["c"] == 21


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
def test_mixed_documents(source, request):
    docs = request.getfixturevalue(source)
    out = mx.mixed_documents(docs)
    assert out.columns == docs.columns
    words = lambda df: {
        (r.doc_id, r.source): r.n
        for r in df.groupBy("doc_id", "source").agg(F.sum("n").alias("n")).collect()
        if r.n
    }
    counted = out.select("doc_id", "source", word_count(whole("text")).alias("n"))
    assert words(counted) == words(mixed(docs).select("doc_id", "source", F.col("taken").alias("n")))
    # Texts are those of the documents, or begin like them where a budget ends.
    given = defaultdict(set)
    for r in docs.collect():
        given[r.doc_id].add(r.text)
    cut = [r for r in out.collect() if r.text not in given[r.doc_id]]
    assert all(any(t and t.startswith(r.text) for t in given[r.doc_id]) for r in cut)
    assert len(cut) <= docs.select("source").distinct().count()
    assert all(r.n_chars == len(r.text) for r in cut)


def test_many_equal_rows_at_the_end_of_a_budget(spark):
    """Rows that differ in nothing are told apart where a budget ends among them."""
    rows = [(1, "a", 7)] * 100 + [(None, "b", 5)] * 40 + [(2, "c", 3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = mx.mix(df, weights=(1, 1, 2)).collect()
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert len(found) == 141
    assert all(taken[r.source] == floor(r.target) for r in found)


def test_texts_are_not_shuffled(real_docs):
    """The documents reach the mix by broadcast joins alone."""
    plan = mx.mixed_documents(real_docs)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x]
    assert lines and all("Broadcast" in x for x in lines)
