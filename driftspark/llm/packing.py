"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths matters for how pieces go together, and it has at most
as many entries as a sequence has tokens. A configuration says how many pieces of each
length share a sequence. Fractional numbers of configurations are found by multiplicative
weights, each priced by a knapsack dynamic program, and rounded to whole ones; the pieces
left are put in by best fit, also into the room that configurations have. Pieces then take
their places by rank.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from driftspark.llm.common import BROADCAST_KEYS, ranks_alike, stored
from driftspark.llm.tokens import TextEncoder, in_slices, tokenizer_path
from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 0
# Rounds of multiplicative weights end when every length is covered COVERS times, or after
# MOST_PRICINGS programs, which bounds work: what has no configuration is packed all the same.
# A length's weight is exp(-SHARPNESS x its cover); PER_PRICING configurations use one program
# and are added by STEP of what would cover one of their lengths once.
COVERS = 6.0
SHARPNESS = 2.0
STEP = 0.25
PER_PRICING = 64
MOST_PRICINGS = 300
# Shares of the fractional solution that rounding may keep, in tokens.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)

Pattern = tuple[tuple[int, int], ...]


# --- pieces -------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth_alike) of every document's ids and the
    closing id.

    Only documents above ``capacity`` are cut, into full pieces and a rest. ``part`` and
    ``nth_alike`` number the pieces of one length within a task; they are only meaningful once
    the table is stored.
    """
    path = path or tokenizer_path()
    closing = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step, part = TextEncoder(path), 4 * capacity, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, length, crc, alike = [], [], [], [], []
            n = 0
            for run in in_slices(t.as_py() for t in batch.column("text")):
                for ids in encoder.encode(run):
                    ids += closing
                    for k, at in enumerate(range(0, len(ids), step)):
                        code = ids[at : at + step]
                        size = len(code) // 4
                        row.append(n)
                        piece.append(k)
                        length.append(size)
                        crc.append(zlib.crc32(code))
                        alike.append(seen[size])
                        seen[size] += 1
                    n += 1
            nth = np.asarray(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(nth * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()),
                    pa.array(alike, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth_alike"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth_alike long"
    )
    return docs.select("doc_id", "text").mapInArrow(tidy(cut), schema)


# --- the configuration program --------------------------------------------------------------------


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack program: the best value of every size up to ``capacity``, and the piece that
    reaches it (0: leave one token free). ``values[l]`` is worth of a piece of length l."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for size in range(1, capacity + 1):
        offers = best[size - 1 :: -1] + values[1 : size + 1]
        k = int(offers.argmax())
        if offers[k] > best[size - 1]:
            best[size], choice[size] = offers[k], k + 1
        else:
            best[size] = best[size - 1]
    return best, choice


def _pattern(first: int, choice: np.ndarray, capacity: int, most: np.ndarray) -> Pattern:
    """The configuration that the program chose beside a first piece, within the demand."""
    items, room = Counter({first: 1}), capacity - first
    while room > 0:
        k = int(choice[room])
        if k and items[k] < most[k]:
            items[k] += 1
            room -= k
        else:
            room -= 1
    return tuple(sorted(items.items()))


def fractional(counts: np.ndarray, capacity: int) -> dict[Pattern, float]:
    """Fractional numbers of configurations that cover every length's demand.

    A length has a weight that falls exponentially with the share of its demand covered so
    far, and a piece is worth its tokens at that weight. The program gives the most
    valuable configuration beside each of the least covered lengths, and some of each is added.
    Divided by the least cover, the numbers solve the covering program; rounding cuts back
    what is covered more often.
    """
    demand = counts.astype(float)
    some = np.flatnonzero(counts)
    cover = np.zeros(capacity + 1)
    found: dict[Pattern, float] = {}
    # Among equal values, long pieces go first and short ones stay to fill up.
    share = 1e-6 * np.arange(capacity + 1) / capacity
    for _ in range(MOST_PRICINGS):
        if not len(some) or cover[some].min() >= COVERS:
            break
        weight = np.exp(-SHARPNESS * (cover[some] - cover[some].min()))
        values = np.zeros(capacity + 1)
        # By the token, so that no length is worth more than its room by being rare.
        values[some] = weight * some / capacity + share[some]
        _, choice = price(values, capacity)
        behind = np.flatnonzero(cover[some] < cover[some].min() + 1)
        order = behind[np.lexsort((-some[behind], cover[some][behind]))]
        for first in some[order][:PER_PRICING].tolist():
            pattern = _pattern(first, choice, capacity, counts)
            step = STEP * min(demand[k] / a for k, a in pattern)
            found[pattern] = found.get(pattern, 0.0) + step
            for k, a in pattern:
                cover[k] += a * step / demand[k]
    least = max(STEP, float(cover[some].min())) if len(some) else 1.0
    return {pattern: n / least for pattern, n in found.items()}


def rounded(found: dict[Pattern, float], counts: np.ndarray, capacity: int, share: float) -> tuple[Counter, np.ndarray]:
    """Whole numbers of configurations, and the pieces they leave.

    Fullest configurations first: each is taken as often as its fraction says, rounded down,
    and then once more, as far as there are pieces; no further once ``share`` of all tokens is
    placed.
    """
    left, used = counts.copy(), Counter()
    budget = share * float(counts @ np.arange(capacity + 1))
    fill = {p: sum(k * a for k, a in p) for p in found}
    order = sorted(found, key=lambda p: (-fill[p], -found[p], p))
    for extra in (0, 1):
        for pattern in order:
            n = 1 if extra else int(found[pattern])
            n = min(n, int(budget // fill[pattern]), min(int(left[k]) // a for k, a in pattern))
            if n > 0 and (fill[pattern] == capacity or not extra):
                used[pattern] += n
                budget -= n * fill[pattern]
                for k, a in pattern:
                    left[k] -= n * a
    return used, left


def best_fit(used: Counter, left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """``used`` with the pieces left put in by best fit, longest first, whole groups of equal
    pieces and equal sequences at a time."""
    rooms: dict[int, Counter] = {}
    for pattern, n in used.items():
        rooms.setdefault(capacity - sum(k * a for k, a in pattern), Counter())[pattern] += n
    known = sorted(rooms)  # all rooms there are
    for k in np.flatnonzero(left)[::-1].tolist():
        n = int(left[k])
        while n:
            at = bisect_left(known, k)
            if at == len(known):
                room, per = capacity, capacity // k
                rooms[capacity] = Counter({(): max(1, n // per)})
                known.append(capacity)
            else:
                room = known[at]
            pattern = next(iter(rooms[room]))
            size = rooms[room][pattern]
            # As many of the piece as fit into each of these sequences, or one into some of them.
            a = max(1, min(room // k, n // size))
            take = min(size, n // a)
            grown = Counter(dict(pattern))
            grown[k] += a
            rooms[room][pattern] -= take
            if not rooms[room][pattern]:
                del rooms[room][pattern]
                if not rooms[room]:
                    del rooms[room]
                    known.pop(bisect_left(known, room))
            if room - a * k not in rooms:
                rooms[room - a * k] = Counter()
                insort(known, room - a * k)
            rooms[room - a * k][tuple(sorted(grown.items()))] += take
            n -= a * take
    return [(p, n) for r in sorted(rooms) for p, n in sorted(rooms[r].items()) if p]


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Configurations and whole numbers that use every piece exactly once.

    ``counts[l]`` pieces have length l. Of the fractional solution the largest of SHARES is
    kept that needs the fewest sequences, so that there are never more than by best fit alone.
    """
    found, best, fewest = fractional(counts, capacity), [], None
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    for share in SHARES:
        packed = best_fit(*rounded(found, counts, capacity, share), capacity)
        total = sum(n for _, n in packed)
        if fewest is None or total < fewest:
            best, fewest = packed, total
        if fewest == least:
            break
    return best


# --- places ----------------------------------------------------------------------------------------


def _places(packed: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go into which sequences: parallel arrays by (length, rank)."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, n in packed:
        offset = 0
        for k, a in pattern:
            rows.append((k, taken[k], n, sequence, offset))
            taken[k] += n * a
            offset += k * a
        sequence += n
    rows.sort()
    names = ("length", "rank", "sequences", "first", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T.copy()))


def _seat(places: dict[str, np.ndarray]):
    shift = np.int64(1) << np.int64(48)
    starts = places["length"] * shift + places["rank"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * shift + rank, side="right") - 1
            inside = rank - places["rank"][at]
            n = places["sequences"][at]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["sequence_id"] = pa.array(places["first"][at] + inside % n)
            columns["offset"] = pa.array(places["offset"][at] + inside // n * length)
            del columns["rank"]
            yield pa.RecordBatch.from_pydict(columns)

    return seat


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    broadcast_rows: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Equal rows are packed each for itself, a null
    doc_id is kept, no rows give no rows, other columns are ignored. Sequences have no gaps.

    Only the length histogram (``capacity`` numbers) reaches the driver, and only the table of
    configurations, bounded by it, goes to the tasks. A piece's rank within its length is its
    number within its task plus the number of equal pieces in the tasks before, so that no
    piece moves, whatever length a third of them has.
    """
    pieces = stored(token_pieces(docs, path, capacity), "pieces")
    ranked, alike = ranks_alike(pieces, "length", "pieces", broadcast_rows)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in alike.items():
        counts[length] = n
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long"
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(_seat(_places(pack_lengths(counts, capacity))), schema)
