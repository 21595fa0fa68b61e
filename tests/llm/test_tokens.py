"""Packing and token counts: ids, gaps, and sequences against bounds and brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftspark.llm import packing as pk, token_counts as tc, tokens as tk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tk.tokenizer_path())


ODD_TEXTS = [
    "Hello, World!! it's we'RE 12 ½ x²  naïve ÀÉ×÷ß ﬁ é a­b  c ıİ Σίσυφος ΌΣΟΣ",
    "日本語 テキスト 한국어 ́́ x y　z \x1c\x1d q\x85r",
    "a<|endoftext|>b <|startoftext|> <|x|> || <| |>",
    "''s 's 't'll don't I'M re've",
    "😀👩‍👩‍👧 --- ... $#@",
    "",
    " \n ",
]


def test_encoder_equals_whole_texts(tokenizer, real_docs):
    texts = ODD_TEXTS + [r.text or "" for r in real_docs.collect()]
    for got, text in zip(tk.TextEncoder(tk.tokenizer_path()).encode(texts), texts):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want


def test_other_tokenizers_encode_text_by_text():
    path = tk.tokenizer_path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    for got, text in zip(tk.TextEncoder(path).encode(ODD_TEXTS), ODD_TEXTS):
        assert np.frombuffer(got, "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("broadcast_rows", [pk.BROADCAST_KEYS, 0])
def test_pack(source, broadcast_rows, request, plain, tokenizer):
    docs = request.getfixturevalue(source)
    rows = pk.pack(docs.repartition(5), broadcast_rows=broadcast_rows).collect()
    want = []
    for i, t in plain(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert least <= len(sequences) <= 1.02 * least + 2


def best_fit(counts, capacity):
    rooms = []
    for k in range(capacity, 0, -1):
        for _ in range(int(counts[k])):
            fits = [i for i, r in enumerate(rooms) if r >= k]
            i = min(fits, key=rooms.__getitem__, default=None)
            if i is None:
                rooms.append(capacity - k)
            else:
                rooms[i] -= k
    return len(rooms)


def length_mixes():
    """Ten kinds of lengths: (name, lengths, capacity)."""
    rng = np.random.default_rng(4)
    for shape in (0.5, 1.0, 3.0):
        for capacity in (64, 2048):
            lengths = np.clip((rng.beta(shape, 2, 600) * capacity).astype(int), 1, capacity)
            yield f"beta {shape} {capacity}", lengths, capacity
    yield "uniform", rng.integers(1, 2049, 900), 2048
    yield "large", rng.integers(600, 1400, 900), 2048
    yield "thirds", rng.integers(400, 1000, 900), 2048
    yield "few", rng.choice([700, 690, 610, 750, 1300], 900), 2048


def check_packed(packed, counts, capacity):
    """Every piece exactly once and nothing too long; the number of sequences."""
    used = np.zeros_like(counts)
    for pattern, n in packed:
        assert n > 0 and sum(k * a for k, a in pattern) <= capacity
        for k, a in pattern:
            used[k] += n * a
    assert (used == counts).all()
    return sum(n for _, n in packed)


@pytest.mark.parametrize("name,lengths,capacity", list(length_mixes()), ids=lambda v: v if isinstance(v, str) else "")
def test_no_more_sequences_than_best_fit(name, lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    total = check_packed(pk.pack_lengths(counts, capacity), counts, capacity)
    assert total <= best_fit(counts, capacity)


def test_given_documents_reach_the_lower_bound(spark, tokenizer):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sizes = [len(b) // 4 + 1 for b in tk.TextEncoder(tk.tokenizer_path()).encode(texts)]
    pieces = [p for n in sizes for p in [2048] * (n // 2048) + [n % 2048] if p]
    counts = np.bincount(pieces, minlength=2049)
    total = check_packed(pk.pack_lengths(counts, 2048), counts, 2048)
    assert total == -(-sum(pieces) // 2048)


@pytest.mark.parametrize("name,lengths,capacity", list(length_mixes()), ids=lambda v: v if isinstance(v, str) else "")
def test_fractional_solution(name, lengths, capacity):
    """It covers every demand, uses configurations that fit, and is kept in part by rounding."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = pk.fractional(counts, capacity)
    cover = np.zeros(capacity + 1)
    for pattern, n in found.items():
        assert n > 0 and sum(k * a for k, a in pattern) <= capacity
        for k, a in pattern:
            assert a <= counts[k]
            cover[k] += n * a
    assert (cover >= counts * (1 - 1e-9)).all()
    used, left = pk.rounded(found, counts, capacity, 1.0)
    assert sum(used.values()) and (left >= 0).all()


def test_configurations_beat_best_fit_where_lengths_are_few():
    """Lengths that only pair well in the right proportion."""
    lengths = np.random.default_rng(0).choice([700, 690, 610, 750, 1300], 20_000)
    counts = np.bincount(lengths, minlength=2049)
    total = check_packed(pk.pack_lengths(counts, 2048), counts, 2048)
    assert total < sum(n for _, n in pk.best_fit(Counter(), counts.copy(), 2048))


def test_many_equal_pieces_take_few_steps():
    counts = np.zeros(101, np.int64)
    counts[[30, 35, 40, 55, 100, 1]] = [10**9, 10**9, 10**9, 10**9, 10**9, 7]
    packed = pk.pack_lengths(counts, 100)
    total = sum(n for _, n in packed)
    assert sum(n * sum(k * a for k, a in p) for p, n in packed) == int(counts @ np.arange(101))
    assert total <= 1.2 * (counts @ np.arange(101)) / 100


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("width", [tc.CELL_WIDTH, 5])
def test_context_statistics(source, width, request, plain, tokenizer):
    docs = request.getfixturevalue(source)
    n = [len(tokenizer.encode(t, add_special_tokens=False).ids) for _, t in plain(docs)]
    rows = tc.context_statistics(tc.length_histogram(docs), width).collect()
    assert sorted(r.length for r in rows) == sorted(set(n))
    for r in rows:
        longer = [x for x in n if x > r.length]
        assert r.documents == n.count(r.length) and r.tokens == r.documents * r.length
        assert (r.docs_longer, r.tokens_longer) == (len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, r.length) for x in n)
        assert r.lost_tokens == sum(n) - r.truncated_total and r.total_tokens == sum(n) - sum(longer)
        assert r.quantile == pytest.approx(1 - len(longer) / len(n))
