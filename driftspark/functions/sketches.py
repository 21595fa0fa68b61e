"""Histogram grids and KLL float sketches, as SQL fragments over Spark's ``kll_*``."""

from __future__ import annotations

from collections.abc import Callable

from driftspark.functions.arrays import let

# Fixed values of the public KLL float sketch layout.
KLL_FAMILY = 0x0F
FLAG_EMPTY = 1
PREAMBLE_INTS_SHORT = 2
PREAMBLE_INTS_FULL = 5
VERSION_FULL = 1
VERSION_SINGLE_ITEM = 2
SMALLEST_LEVEL = 8
MOST_LEVELS = 60


# --- equal-step grid ----------------------------------------------------------------------


Splits = int | str  # a number, or an expression over the keys


def grid_step(low: str, high: str, num_splits: Splits) -> str:
    """Histogram step; a constant feature gets 0.01."""
    return f"(CASE WHEN {high} > {low} THEN ({high} - {low}) / double({num_splits}) ELSE 0.01D END)"


def grid_bin(value: str, low: str, high: str, num_splits: Splits) -> str:
    """Bin number 1..num_splits; the top bin is closed on the right."""
    step = grid_step(low, high, num_splits)
    return f"cast(least({num_splits}, floor(({value} - {low}) / {step}) + 1) as int)"


def settle_single(bin_number: str, value: str, low: str, high: str, num_splits: Splits) -> str:
    """Corrects a bin number to what a float sketch counts: it compares single-precision
    values with single-precision split points, a value on a split going up.
    """
    step = grid_step(low, high, num_splits)
    split = lambda i: f"double(float({low} + ({i}) * {step}))"
    b = bin_number
    return (
        f"CASE WHEN {b} < {num_splits} AND {value} >= {split(b)} THEN {b} + 1 "
        f"WHEN {b} > 1 AND {value} < {split(f'{b} - 1')} THEN {b} - 1 ELSE {b} END"
    )


def grid_edges(low: str, high: str, num_splits: Splits) -> str:
    """num_splits split points followed by the maximum."""
    step = grid_step(low, high, num_splits)
    return f"concat(transform(sequence(0, {num_splits} - 1), i -> {low} + i * {step}), array({high}))"


# --- sketches -------------------------------------------------------------------------------


def _byte(buffer: str, at: int) -> str:
    return f"bigint(conv(hex(substring({buffer}, {at + 1}, 1)), 16, 10))"


def _uint(buffer: str, at: int, width: int, beyond: str = "0") -> str:
    """Little-endian unsigned integer of ``width`` bytes, at ``beyond`` bytes after ``at``."""
    byte = lambda i: f"bigint(conv(hex(substring({buffer}, int({at + i + 1} + {beyond}), 1)), 16, 10))"
    return "(" + " + ".join(f"{byte(i)} * {256**i}" for i in range(width)) + ")"


def _is_full(buffer: str) -> str:
    """Whether a multi-item sketch's header agrees with itself and with the length.

    Levels shrink by 2/3 from k, but never below m; level offsets rise up to the number of
    slots, the first one says how many of them are unused; an item of level i stands for 2^i
    values, which add up to the count.
    """
    k, m, levels = _uint(buffer, 4, 2), _byte(buffer, 6), _byte(buffer, 18)
    offset = f"(CASE WHEN i = h.levels THEN h.slots ELSE {_uint(buffer, 20, 4, '4 * i')} END)"
    twice = "floor(2 * h.k * power(2D, depth) / power(3D, depth))"
    slots = (
        "aggregate(sequence(0, int(greatest(h.levels, 1)) - 1), 0L, "
        f"(acc, depth) -> acc + greatest(h.m, floor(({twice} + 1) / 2)))"
    )
    offsets = f"transform(sequence(0, int(h.levels)), i -> bigint({offset}))"
    rising = "o = array_sort(o)"
    # In floating point: damaged counts may be anything, and whole ones below 2^53 are exact.
    weight = (
        "aggregate(sequence(0, size(o) - 2), 0D, "
        "(acc, i) -> acc + power(2D, i) * (o[i + 1] - o[i]))"
    )
    whole = let(
        offsets,
        "o",
        f"length({buffer}) = 20 + 4 * h.levels + 8 + 4 * (h.slots - o[0]) AND {rising} AND {weight} = h.n",
    )
    head = let(
        f"named_struct('k', {k}, 'm', {m}, 'levels', {levels}, 'n', double({_uint(buffer, 8, 7)}))",
        "h",
        f"named_struct('k', h.k, 'm', h.m, 'levels', h.levels, 'n', h.n, 'slots', {slots})",
    )
    usual = f"{m} = {SMALLEST_LEVEL} AND {levels} BETWEEN 1 AND {MOST_LEVELS} AND {_byte(buffer, 15)} = 0"
    long_enough = f"length({buffer}) >= 28 + 4 * {levels}"
    return f"CASE WHEN {usual} AND {long_enough} THEN {let(head, 'h', whole)} ELSE false END"


def is_sketch(buffer: str) -> str:
    """True when the bytes are a complete compact KLL float sketch that merges.

    Merging a broken buffer fails the whole query, so buffers are checked first: family and
    version by header, the counts in it against each other and the length. What passes is
    merged with itself and asked for a quantile on trial, within the row.
    """
    length, preamble, version = f"length({buffer})", _byte(buffer, 0), _byte(buffer, 1)
    short = f"{preamble} = {PREAMBLE_INTS_SHORT}"
    header = f"""coalesce(CASE
      WHEN {length} < 8 OR {_byte(buffer, 2)} <> {KLL_FAMILY} THEN false
      WHEN {_byte(buffer, 3)} & {FLAG_EMPTY} = 1 THEN {short} AND {length} = 8
      WHEN {version} = {VERSION_SINGLE_ITEM} THEN {short} AND {length} = 12
      WHEN {version} <> {VERSION_FULL} OR {preamble} <> {PREAMBLE_INTS_FULL} OR {length} < 32
        THEN false
      ELSE {_is_full(buffer)} END, false)"""
    return f"CASE WHEN {header} THEN {_all_numbers(buffer)} AND {merges(buffer)} ELSE false END"


def _all_numbers(buffer: str) -> str:
    """Whether no retained value is NaN: a sketch leaves such values out.

    Everything after the header comes in four bytes, little-endian: a NaN has all bits of the
    exponent and some of the mantissa.
    """
    start = f"CASE WHEN {_byte(buffer, 1)} = {VERSION_SINGLE_ITEM} THEN 9 ELSE 21 + 4 * int({_byte(buffer, 18)}) END"
    values = f"hex(substring({buffer}, {start}))"
    return f"(length({buffer}) = 8 OR NOT {values} RLIKE '^(?:.{{8}})*(?!000080).{{4}}[89A-F].[7F]F')"


def merges(buffer: str) -> str:
    """Whether merging the buffer and reading the result succeed, tried within the row.

    ``try_to_binary`` gives NULL for whatever goes wrong while its argument is computed.
    """
    merged = f"kll_sketch_merge_float({buffer}, {buffer})"
    median = "kll_sketch_get_quantile_float(z, 0.5D)"
    some = "kll_sketch_get_n_float(z) > 0"
    tried = let(merged, "z", f"CASE WHEN {some} THEN hex(string({median})) ELSE '' END")
    return f"(try_to_binary({tried}, 'hex') IS NOT NULL)"


def sketch_count(sketch: str) -> str:
    return f"kll_sketch_get_n_float({sketch})"


def mid_ranks(probes: int) -> str:
    """The ranks (i + 1/2) / probes as a constant array; ``probes`` divides a power of ten.

    Rank queries take constants only. Composed from a sequence of digits, a long list stays a
    short text that the optimizer folds.
    """
    digits = 1
    while 10**digits % (2 * probes):
        digits += 1
    step = 10**digits // probes
    first, last = 10**digits + step // 2, 2 * 10**digits - step // 2
    numbers = f"concat(',', array_join(sequence({first}, {last}, {step}), ','))"
    return f"cast(split(substring(replace({numbers}, ',1', ',0.'), 2), ',') as array<double>)"


def probes_for(count: str, classes: list[tuple[int | None, int]], body: Callable[[int], str]) -> str:
    """``body`` for the number of probes that ``classes`` give for a count of values."""
    *some, (_, last) = classes
    whens = " ".join(f"WHEN {count} < {below} THEN {body(probes)}" for below, probes in some)
    return f"CASE {whens} ELSE {body(last)} END" if some else body(last)


def sketch_quantiles(sketch: str, classes: list[tuple[int | None, int]]) -> str:
    """Minimum, maximum and evenly spaced quantiles, more of them for larger sketches; NULL for
    an empty one."""
    n = sketch_count(sketch)
    read = lambda probes: (
        f"kll_sketch_get_quantile_float({sketch}, concat(array(0D, 1D), {mid_ranks(probes)}))"
    )
    return f"CASE WHEN {n} > 0 THEN {probes_for(n, classes, read)} END"


def sketch_pmf(quantiles: str, n: str, low: str, high: str, num_splits: Splits) -> str:
    """Share of evenly spaced quantiles in each bin; slot 0 (below the minimum) is 0.

    Where there are more than two probes for each of the ``n`` values, every value has its own
    share of the probes up to less than half a value: the share is settled to whole values.
    """
    place = grid_bin("double(v)", low, high, num_splits)
    settled = let(place, "i", settle_single("i", "double(v)", low, high, num_splits))
    bins = f"transform({quantiles}, v -> {settled})"
    part = "(size(bins) - size(array_remove(bins, slot))) / size(bins)"
    share = f"CASE WHEN size(bins) > 2 * {n} THEN round({part} * {n}) / {n} ELSE {part} END"
    return let(bins, "bins", f"transform(sequence(0, {num_splits}), slot -> {share})")


def sketch_shape(quantiles: str, n: str, num_splits: Splits) -> str:
    """Struct ``(x, pmf)`` from the minimum, the maximum and evenly spaced quantiles.
    NULL for an infinite range."""
    edges = grid_edges("s.low", "s.high", num_splits)
    pmf = sketch_pmf("s.probes", "s.n", "s.low", "s.high", num_splits)
    return let(
        let(
            quantiles,
            "z",
            f"named_struct('n', {n}, 'low', double(z[0]), 'high', double(z[1]), "
            "'probes', slice(z, 3, size(z) - 2))",
        ),
        "s",
        f"CASE WHEN s.high - s.low < double('Infinity') "
        f"THEN named_struct('x', {edges}, 'pmf', {pmf}) END",
    )
