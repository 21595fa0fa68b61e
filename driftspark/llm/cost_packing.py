"""Cost-balanced packing: sequences of equal size and near-equal attention cost.

A piece of n tokens costs a linear part for its layers and a quadratic part for attention
inside it. Documents above the capacity give full sequences; what remains of each, a rest,
goes in descending order to the sequence of lowest cost that has room for it. There are only
as many sequences as the tokens fill, the last ones of power-of-two size, so that nothing is
padded: a rest that no sequence can take whole is cut, and its remainder queues up again.

How rests go together follows from the histogram of their lengths, where equal rests and
equal sequences are handled together. Rests then take their places by rank.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from driftspark.llm.byte_bpe import ByteEncoder
from driftspark.llm.common import BROADCAST_KEYS, ranks_alike, stored
from driftspark.llm.tokens import in_slices, tokenizer_path
from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
END_ID = 0
# A layer of this width multiplies 12 width^2 times a token and 2 width times a pair of
# tokens; divided by 2 width, a token costs 6 width and a pair 1.
WIDTH = 1024
# Full sequences of a task are numbered from here, above all sequences of rests.
TASK_NUMBERS = 1 << 40


def cost(length, width: int = WIDTH):
    return 6 * width * length + length * length


# --- who goes where ---------------------------------------------------------------------------


class Sequences(NamedTuple):
    """``count`` sequences in a row, alike so far. Ordered by cost."""

    cost: int
    first: int
    count: int
    used: int


class Placement(NamedTuple):
    """Rests of length ``rest`` and ranks from ``rank``: their piece number ``nth`` starts at
    ``start``, has ``length`` tokens and lies at ``offset`` in sequences from ``sequence``."""

    rest: int
    nth: int
    rank: int
    start: int
    length: int
    sequence: int
    offset: int


def sequence_sizes(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(size, number) of the sequences that ``tokens`` fill: full ones, and powers of two."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << b for b in range(rest.bit_length()) if rest >> b & 1]
    return [(capacity, full)] * (full > 0) + [(p, 1) for p in reversed(powers)]


def balance(counts: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH) -> list[Placement]:
    """Places for ``counts[l]`` rests of every length l, descending, lowest cost first.

    Each step settles all rests of a kind or all sequences of a kind, whatever their number.
    """
    heaps: list[list[Sequences]] = [[] for _ in range(capacity + 1)]
    cheapest = np.full(capacity + 1, np.inf)

    def put(room: int, group: Sequences) -> None:
        heapq.heappush(heaps[room], group)
        cheapest[room] = heaps[room][0].cost

    number = 0
    for size, n in sequence_sizes(int(counts @ np.arange(capacity + 1)), capacity):
        put(size, Sequences(0, number, n, 0))
        number += n
    # Rests, and remainders of cut ones, by the length that is still without a place.
    waiting: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(counts).tolist():
        waiting[length].append((length, 0, 0, 0, int(counts[length])))
    places = []
    for length in range(capacity, 0, -1):
        for rest, nth, start, rank, n in waiting[length]:
            while n:
                room = length + int(cheapest[length:].argmin())
                if cheapest[room] == np.inf:  # nowhere whole
                    room = 1 + int(cheapest[1:length].argmin())
                group = heapq.heappop(heaps[room])
                cheapest[room] = heaps[room][0].cost if heaps[room] else np.inf
                size, m = min(room, length), min(n, group.count)
                places.append(Placement(rest, nth, rank, start, size, group.first, group.used))
                if m < group.count:
                    put(room, group._replace(first=group.first + m, count=group.count - m))
                if size < room:
                    spent = group.cost + cost(size, width)
                    put(room - size, Sequences(spent, group.first, m, group.used + size))
                if size < length:
                    waiting[length - size].append((rest, nth + 1, start + size, rank, m))
                rank, n = rank + m, n - m
    return places


# --- tokens -------------------------------------------------------------------------------------


def token_rests(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: its number of ids, checksums of its full pieces, and its rest.

    ``part`` and ``nth_alike`` number the rests of one length within a task, ``full_before``
    the full pieces. They are only meaningful once the table is stored.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = ByteEncoder(path), TaskContext.get().partitionId()
        seen, full_seen = np.zeros(capacity, np.int64), 0
        for batch in batches:
            ids, texts, at = batch.column("doc_id"), batch.column("text"), 0
            for run in in_slices(t.as_py() for t in texts):
                total, crcs, rest, tail, alike, before = [], [], [], [], [], []
                for text in run:
                    code = np.append(encoder.encode(text), END_ID).astype("<u4")
                    cut = len(code) - len(code) % capacity
                    full = [zlib.crc32(code[i : i + capacity]) for i in range(0, cut, capacity)]
                    left = len(code) - cut
                    total.append(len(code))
                    crcs.append(full)
                    rest.append(left)
                    tail.append(code[cut:].astype(encoder.kind).tobytes())
                    alike.append(seen[left])
                    before.append(full_seen)
                    seen[left] += 1
                    full_seen += len(full)
                n = len(run)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        pa.array(total, pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())),
                        pa.array(before, pa.int64()),
                        pa.array(rest, pa.int32()),
                        pa.array(tail, pa.binary()),
                        pa.array([part] * n, pa.int32()),
                        pa.array(alike, pa.int64()),
                    ],
                    ["doc_id", "doc_tokens", "full_crcs", "full_before", "rest", "tail", "part", "nth_alike"],
                )
                at += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, doc_tokens long, full_crcs array<long>, full_before long,"
        " rest int, tail binary, part int, nth_alike long"
    )
    return docs.select("doc_id", "text").mapInArrow(tidy(split), schema)


# --- pieces -------------------------------------------------------------------------------------


def _seat(places: list[Placement], capacity: int):
    """The task that gives every piece its sequence, offset and checksum."""
    table = np.array(sorted(places), np.int64).reshape(-1, len(Placement._fields))
    column = dict(zip(Placement._fields, table.T.copy()))
    by_nth = np.int64(capacity + 1)
    by_rank = np.int64(1) << np.int64(62 - 2 * int(by_nth).bit_length())
    starts = (column["rest"] * by_nth + column["nth"]) * by_rank + column["rank"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank, tokens, before, part = (
                batch.column(c).to_numpy().astype(np.int64)
                for c in ("rest", "rank", "doc_tokens", "full_before", "part")
            )
            row, start, length, crc, sequence, offset = ([] for _ in range(6))
            for i, full in enumerate(batch.column("full_crcs").to_pylist()):
                n = len(full)
                row += [i] * n
                start += range(0, n * capacity, capacity)
                length += [capacity] * n
                crc += full
                first = (int(part[i]) + 1) * TASK_NUMBERS + int(before[i])
                sequence += range(first, first + n)
                offset += [0] * n
            tails = batch.column("tail").to_pylist()
            open_, nth = np.flatnonzero(rest), 0
            while len(open_):
                key = (rest[open_] * by_nth + nth) * by_rank + rank[open_]
                at = np.searchsorted(starts, key, side="right") - 1
                begin, size = column["start"][at], column["length"][at]
                row += open_.tolist()
                start += (tokens[open_] - rest[open_] + begin).tolist()
                length += size.tolist()
                sequence += (column["sequence"][at] + rank[open_] - column["rank"][at]).tolist()
                offset += column["offset"][at].tolist()
                for i, a, n in zip(open_.tolist(), begin.tolist(), size.tolist()):
                    width = len(tails[i]) // int(rest[i])
                    ids = np.frombuffer(tails[i], f"<u{width}", n, a * width)
                    crc.append(zlib.crc32(ids.astype("<u4")))
                open_, nth = open_[begin + size < rest[open_]], nth + 1
            of = pa.array(row, pa.int64())
            numbers = [pa.array(c, pa.int64()) for c in (start, length, crc, tokens[row], sequence, offset)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), *numbers],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return seat


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    width: int = WIDTH,
    broadcast_rows: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Equal rows are packed each for itself, a null
    doc_id is kept, no rows give no rows, other columns are ignored. Every sequence is full to
    ``capacity`` (a power of two), but for at most one sequence of each smaller power of two.

    Only the histogram of rests (``capacity`` numbers) reaches the driver, and only the table of
    places that follows from it goes to the tasks. Documents are never shuffled: a rest's rank
    is its number within its task plus the number of equal rests in the tasks before.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    rests = stored(token_rests(docs, path, capacity), "rests")
    ranked, alike = ranks_alike(rests, "rest", "rests", broadcast_rows)
    counts = np.zeros(capacity + 1, np.int64)
    for rest, n in alike.items():
        counts[rest] = n
    counts[0] = 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long"
    )
    columns = ["doc_id", "doc_tokens", "full_crcs", "full_before", "rest", "tail", "part", "rank"]
    return ranked.select(*columns).mapInArrow(tidy(_seat(balance(counts, capacity, width), capacity)), schema)


def sequence_costs(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """(sequence_id, tokens, pieces, cost) of packed pieces, to judge the balance."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.count(F.lit(1)).alias("pieces"),
        F.sum(cost(F.col("length"), width)).alias("cost"),
    )
