"""Cost-balanced packing: ids, gaps, padding, and the plan against the greedy rule one by one."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftspark.llm import byte_bpe, cost_packing as cp, tokens as tk

PATH = tk.tokenizer_path("byte_bpe_50k.json")
ODD_TEXTS = [
    "Hello, World!! it's we'RE 12 ½ x²  naïve ÀÉ×÷ß ﬁ é a­b  c ıİ Σίσυφος ΌΣΟΣ",
    "日本語 テキスト 한국어 ́́ x y　z \x1c\x1d q\x85r ​ ﻿",
    "a<|endoftext|>b <|endoftext|> <|x|> || <| |>",
    "''s 's 't'll don't I'M re've",
    "😀👩‍👩‍👧 --- ... $#@",
    "",
    " \n ",
    "x" + " " * 100_000 + "y",
    " " * 300_000,
    "ab" * 50_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer, real_docs):
    encoder = byte_bpe.ByteEncoder(PATH)
    assert encoder.fast is not None
    for text in ODD_TEXTS + [r.text or "" for r in real_docs.collect()]:
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_use_their_own_tokenizer():
    path = tk.tokenizer_path("word_bpe_49k.json")
    encoder, full = byte_bpe.ByteEncoder(path), Tokenizer.from_file(path)
    assert encoder.fast is None
    for text in ODD_TEXTS[:7]:
        assert encoder.encode(text).tolist() == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
@pytest.mark.parametrize("capacity,broadcast_rows", [(1024, cp.BROADCAST_KEYS), (1024, 0), (64, 0)])
def test_pack(source, capacity, broadcast_rows, request, plain, tokenizer):
    docs = request.getfixturevalue(source)
    rows = cp.pack(docs.repartition(5), PATH, capacity, broadcast_rows=broadcast_rows).collect()
    want = defaultdict(list)
    for i, t in plain(docs):
        want[i].append(tokenizer.encode(t, add_special_tokens=False).ids + [0])
    # Every id lies in one piece, and the pieces of equal rows come once for each.
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(want)
    for i, texts in want.items():
        assert all(len(t) == len(texts[0]) for t in texts)
        cover = np.zeros(len(texts[0]), int)
        for start, length, crc, tokens in pieces[i]:
            assert tokens == len(texts[0]) and length > 0
            cover[start : start + length] += 1
            part = np.array(texts[0][start : start + length], "<u4")
            assert crc == zlib.crc32(part.tobytes())
        assert (cover == len(texts)).all()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        sizes.append(at)
    small = [s for s in sizes if s < capacity]
    assert all(s <= capacity for s in sizes)
    assert len(set(small)) == len(small) and all(s & (s - 1) == 0 for s in small)


def one_by_one(lengths, capacity, width):
    """The greedy rule, a rest and a sequence at a time; costs of the sequences, sorted."""
    total, open_ = sum(lengths), []
    for size, n in cp.sequence_sizes(total, capacity):
        open_ += [[0, size] for _ in range(n)]
    waiting = sorted(lengths)
    while waiting:
        length = waiting.pop()
        fits = [s for s in open_ if s[1] >= length] or [s for s in open_ if s[1]]
        # Equal costs: the sequence with less room, as the plan has it.
        best = min(fits, key=lambda s: (s[0], s[1]))
        size = min(length, best[1])
        best[0] += cp.cost(size, width)
        best[1] -= size
        if size < length:
            waiting = sorted([*waiting, length - size])
    return sorted(c for c, _ in open_)


@pytest.mark.parametrize("seed", range(8))
def test_plan_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 64, 256][seed % 3]
    lengths = rng.integers(1, capacity, rng.integers(1, 300)).tolist()
    counts = np.bincount(lengths, minlength=capacity + 1)
    places = cp.balance(counts, capacity)
    kinds = defaultdict(list)
    for p in sorted(places):
        kinds[p.rest, p.nth].append(p)
    costs = defaultdict(int)
    for rest in np.flatnonzero(counts).tolist():
        for rank in range(counts[rest]):
            done = nth = 0
            while done < rest:
                p = [p for p in kinds[rest, nth] if p.rank <= rank][-1]
                assert p.start == done
                costs[p.sequence + rank - p.rank] += cp.cost(p.length)
                done, nth = done + p.length, nth + 1
    assert sorted(costs.values()) == one_by_one(lengths, capacity, cp.WIDTH)


@pytest.mark.parametrize("seed", range(4))
def test_costs_are_balanced(seed):
    """Closer together than if the same rests are packed by best fit, which pads."""
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.gamma(1.5, 150, 2000).astype(int), 1, 1023)
    rooms: list[list[int]] = []  # of each sequence: its room, its cost
    for n in sorted(lengths.tolist(), reverse=True):
        best = min((r for r in rooms if r[0] >= n), default=None)
        if best is None:
            rooms.append(best := [1024, 0])
        best[0] -= n
        best[1] += cp.cost(n)
    costs = one_by_one(lengths.tolist(), 1024, cp.WIDTH)[-(int(lengths.sum()) // 1024) :]
    fitted = [c for _, c in rooms]
    assert np.std(costs) < np.std(fitted)
    assert max(costs) - min(costs) < max(fitted) - min(fitted)


def test_many_equal_rests_take_few_steps():
    counts = np.zeros(1025, np.int64)
    counts[[1, 300, 350, 600, 1000]] = [10**9 + 7, 10**9, 10**9, 10**9, 10**9]
    places = cp.balance(counts)
    assert len(places) < 1000
