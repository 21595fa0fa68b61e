"""The Merkle manifest against a plain tree over all rows."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from driftspark.llm import manifest as mf


def plain_manifest(rows):
    """Result rows, by building every source's tree whole."""
    leaf_of = lambda v: mf.digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    sources = defaultdict(list)
    for r in rows:
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        now = list(values)
        if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            now[-1] = r.text.replace("\n", "")
        sources[r.source].append((r.doc_id, leaf_of(values), leaf_of(now)))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            row = levels[-1]
            levels.append([mf.digest("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
        return levels

    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in sources[s]]) for s in order]
    roots = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, now) in enumerate(sources[s]):
            siblings, at, node = [], i, now
            for levels, at in ((trees[k], i), (roots, k)):
                for row in levels[:-1]:
                    run = [row[j] for j in range(at - at % 3, min(len(row), at - at % 3 + 3))]
                    mine = at % 3
                    siblings += run[:mine] + run[mine + 1 :]
                    node = mf.digest("".join(run[:mine] + [node] + run[mine + 1 :]))
                    at //= 3
            root = roots[-1][0]
            out.append((doc_id, leaf, trees[k][-1][0], root, mf.digest("".join(siblings)), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("levels", [mf.BLOCK_LEVELS, 1, 2])
def test_manifest(source, levels, request):
    docs = request.getfixturevalue(source)
    found = mf.manifest(docs.repartition(6), levels)
    assert found.columns == COLUMNS
    want = plain_manifest(docs.select(*mf.FIELDS).collect())
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_tampering_is_found_only_where_it_is(spark):
    """Lost line feeds fail their own row; rows beside it and texts without any pass."""
    rows = [(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = {r.doc_id: r for r in mf.manifest(docs, 2).collect()}
    for i, *_, text in rows:
        changed = "\n" in text and zlib.crc32(str(i).encode()) % 2 == 0
        assert found[i].verified != changed
        assert (found[i].folded_root == found[i].root) == found[i].verified


def test_a_large_source_lies_in_many_ranges(spark):
    """Places are gapless in every source, also with equal rows and a source of most rows."""
    rows = spark.range(20_000).selectExpr(
        "if(id % 4 = 0, null, if(id % 10 < 9, 'big', 's' || id % 3)) AS source", "id % 700 AS doc_id", "'x' AS leaf"
    )
    found = mf.numbered(rows.repartition(7), ["source"], ["doc_id", "leaf"], "test")
    by_source = defaultdict(list)
    for r in found.collect():
        by_source[r.source].append((r.pos, r.doc_id))
    assert sum(map(len, by_source.values())) == 20_000
    for places in by_source.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        assert [d for _, d in places] == sorted(d for _, d in places)
