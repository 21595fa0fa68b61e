"""Rebinning and the ten histogram distances, as SQL fragments over array columns.

Every fragment works within one row, so comparing a million keys needs no shuffle beyond
the one that built the histograms. ``p`` is the current side and ``q`` the reference side,
both already on common bins. NULL stands for "undefined".
"""

from __future__ import annotations

from collections.abc import Callable

from driftspark.functions.arrays import average_ranks, let, let_pair, total, total_of

EDGE_DIGITS = 12
PSI_FLOOR = 1e-4
INFINITY = "double('Infinity')"


# --- bins ---------------------------------------------------------------------------


def normalize_bins(x: str) -> str:
    """Arbitrary edges scaled to [0, 1]; rounded so equal edges stay equal."""
    return let(
        f"named_struct('x', {x}, 'lo', array_min({x}), 'hi', array_max({x}))",
        "s",
        f"transform(s.x, e -> round(try_divide(e - s.lo, s.hi - s.lo), {EDGE_DIGITS}))",
    )


def unit_edges(x: str) -> str:
    """Edges of an equal-step histogram scaled to [0, 1], free of rounding noise.

    A constant feature has edges c, c+step, ..., c+(n-1)*step, c: the last one wraps
    back to 0 after scaling, which later leaves its interval empty.
    """
    constant = "concat(transform(sequence(0, s.n - 1), i -> i / (s.n - 1)), array(0D))"
    return let(
        f"named_struct('x', {x}, 'n', size({x}) - 1)",
        "s",
        f"CASE WHEN s.x[0] = s.x[s.n] THEN {constant} "
        "ELSE transform(sequence(0, s.n), i -> i / s.n) END",
    )


def is_degenerate(edges: str) -> str:
    return f"(element_at({edges}, -1) <> 1D)"


def common_bins(edges_p: str, edges_q: str) -> str:
    return f"array_sort(array_union({edges_p}, {edges_q}))"


def _interval_of(start: str) -> str:
    """The last of the rising edges ``s.e`` that is not above ``start``, by halving; -1 if none.

    The final edge opens no interval.
    """
    middle = "(a.lo + a.hi) div 2"
    halve = let(
        f"int({middle})",
        "m",
        f"CASE WHEN a.hi - a.lo <= 1 THEN a WHEN s.e[m] <= {start} "
        "THEN named_struct('lo', m, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', m) END",
    )
    rounds = "sequence(1, int(ceil(log2(size(s.e)))) + 1)"
    limits = "named_struct('lo', -1, 'hi', size(s.e) - 1)"
    return f"aggregate({rounds}, {limits}, (a, round) -> {halve}, a -> a.lo)"


def rebin(hist: str, edges: str, common: str) -> str:
    """Copy each source bin's mass, undivided, to every common bin inside it.

    Rising edges are searched by halving; edges that do not rise are looked through, as a
    common bin may then lie in several of their intervals.
    """
    found = let(
        _interval_of("start"),
        "i",
        "CASE WHEN i >= 0 AND start < s.e[i + 1] THEN s.h[i] ELSE 0D END",
    )
    mass = "CASE WHEN s.e[i] <= start AND start < s.e[i + 1] THEN s.h[i] ELSE 0D END"
    every = f"aggregate(sequence(0, size(s.e) - 2), 0D, (acc, i) -> acc + {mass})"
    starts = f"slice({common}, 1, size({common}) - 1)"
    # The last edge of a constant feature falls back to 0, which closes its interval.
    inner = f"slice({edges}, 1, size({edges}) - 1)"
    return let(
        f"named_struct('e', {edges}, 'h', {hist}, 'rising', {inner} = array_sort({inner}))",
        "s",
        f"CASE WHEN s.rising THEN transform({starts}, start -> {found}) "
        f"ELSE transform({starts}, start -> {every}) END",
    )


def rebin_pair(pmf_p: str, edges_p: str, pmf_q: str, edges_q: str) -> str:
    """Struct ``(p, q)`` on common bins. Sides with the same grid need no rebinning."""
    head = lambda pmf: f"slice({pmf}, 1, size({pmf}) - 1)"
    rebinned = let(
        common_bins(edges_p, edges_q),
        "grid",
        f"named_struct('p', {rebin(pmf_p, edges_p, 'grid')}, 'q', {rebin(pmf_q, edges_q, 'grid')})",
    )
    return (
        f"CASE WHEN {edges_p} = {edges_q} AND NOT {is_degenerate(edges_p)} "
        f"THEN named_struct('p', {head(pmf_p)}, 'q', {head(pmf_q)}) ELSE {rebinned} END"
    )


# --- distances on common bins ---------------------------------------------------------


def euclidean_distance(p: str, q: str) -> str:
    return f"sqrt({total_of(p, q, '(a - b) * (a - b)')})"


def manhattan_distance(p: str, q: str) -> str:
    return total_of(p, q, "abs(a - b)")


def _dot(a: str, b: str) -> str:
    return total_of(a, b, "a * b")


def cosine_similarity(p: str, q: str) -> str:
    norms = f"sqrt({_dot('s.p', 's.p')} * {_dot('s.q', 's.q')})"
    return let_pair(p, q, "s", f"try_divide({_dot('s.p', 's.q')}, {norms})")


def pearson_correlation(p: str, q: str) -> str:
    def centred(a: str) -> str:
        return let(a, "w", let(f"{total('w')} / size(w)", "m", "transform(w, e -> e - m)"))

    norms = f"sqrt({_dot('c.p', 'c.p')}) * sqrt({_dot('c.q', 'c.q')})"
    r = let_pair(centred("s.p"), centred("s.q"), "c", f"try_divide({_dot('c.p', 'c.q')}, {norms})")
    varies = "array_min(s.p) < array_max(s.p) AND array_min(s.q) < array_max(s.q)"
    return let_pair(p, q, "s", f"CASE WHEN {varies} THEN greatest(-1D, least(1D, {r})) END")


def spearman_rank_correlation(p: str, q: str) -> str:
    return pearson_correlation(average_ranks(p), average_ranks(q))


def _as_distribution(a: str) -> str:
    return let(a, "w", let(total("w"), "t", "transform(w, e -> try_divide(e, t))"))


def _relative_entropy(p: str, q: str) -> str:
    """Sum of p*ln(p/q), with 0*ln(0) = 0 and infinity where q = 0 < p."""
    term = f"CASE WHEN a = 0D THEN 0D WHEN b = 0D THEN {INFINITY} ELSE a * ln(a / b) END"
    return total_of(p, q, term)


def jensen_shannon_divergence(p: str, q: str) -> str:
    """The distance, i.e. the square root of the divergence (natural logarithm)."""
    both = let(
        "zip_with(s.p, s.q, (a, b) -> (a + b) / 2)",
        "m",
        f"{_relative_entropy('s.p', 'm')} + {_relative_entropy('s.q', 'm')}",
    )
    root = let(both, "d", "sqrt(CASE WHEN d < 0D THEN 0D ELSE d END / 2)")
    return let_pair(_as_distribution(p), _as_distribution(q), "s", root)


def kullback_leibler_divergence(p: str, q: str) -> str:
    return let_pair(
        _as_distribution(p), _as_distribution(q), "s", _relative_entropy("s.p", "s.q")
    )


def hellinger_distance(p: str, q: str) -> str:
    """Bin masses are taken as they are, not normalized first."""
    gap = "(sqrt(a) - sqrt(b)) * (sqrt(a) - sqrt(b))"
    return f"sqrt({total_of(p, q, gap)}) / sqrt(2D)"


def wasserstein_distance(p: str, q: str) -> str:
    """Earth mover's distance between the two sets of bin heights."""
    moved = total_of("array_sort(s.p)", "array_sort(s.q)", "abs(a - b)")
    return let_pair(p, q, "s", f"{moved} / size(s.p)")


# --- PSI works on the histograms as they come --------------------------------------------


def _sampled(edges: str, pmf: str, num_buckets: int) -> str:
    """Histogram read at k/num_buckets by linear interpolation, exact at the edges;
    zeros become 1e-4."""
    at = f"k / {num_buckets}D"
    upper = f"greatest(1, least(size(g.e) - 1, size(filter(g.e, e -> e < {at}))))"
    slope = "try_divide(g.h[hi] - g.h[hi - 1], g.e[hi] - g.e[hi - 1])"
    height = let(
        upper,
        "hi",
        f"CASE WHEN g.e[hi] = {at} THEN g.h[hi] "
        f"ELSE g.h[hi - 1] + {slope} * ({at} - g.e[hi - 1]) END",
    )
    heights = let(
        f"named_struct('e', {edges}, 'h', {pmf})",
        "g",
        f"transform(sequence(0, {num_buckets}), k -> {height})",
    )
    return f"transform({heights}, y -> CASE WHEN y = 0D THEN {PSI_FLOOR}D ELSE y END)"


def psi(pmf_p: str, edges_p: str, pmf_q: str, edges_q: str, num_buckets: int = 10) -> str:
    """Population stability index over samples of both histograms. Undefined (NULL) when
    a side is a constant feature.
    """
    index = total_of(
        _sampled(edges_p, pmf_p, num_buckets),
        _sampled(edges_q, pmf_q, num_buckets),
        "(a - b) * ln(a / b)",
    )
    return f"CASE WHEN NOT ({is_degenerate(edges_p)} OR {is_degenerate(edges_q)}) THEN {index} END"


# --- how far a distance can be off, if every bin is off by at most ``e`` -----------------


def euclidean_error(p: str, e: str) -> str:
    """Both vectors move by at most e in each place."""
    return f"2 * sqrt(size({p})) * {e}"


def pearson_error(p: str, q: str, e: str) -> str:
    """Either centred vector turns by at most twice its move divided by its length; NULL where
    a vector does not vary."""
    centred = lambda a: let(
        a, "w", let(f"{total('w')} / size(w)", "m", "sqrt(aggregate(w, 0D, (acc, v) -> acc + (v - m) * (v - m)))")
    )
    return f"2 * sqrt(size({p})) * {e} * (try_divide(1D, {centred(p)}) + try_divide(1D, {centred(q)}))"


def psi_error(
    pmf_p: str, edges_p: str, pmf_q: str, edges_q: str, e: str, least: str, num_buckets: int = 10
) -> str:
    """A term is convex in both heights and never negative, so that within the square around
    them it lies between 0 and its largest corner. ``least`` is the smallest height a side has."""
    low = lambda v: f"greatest({least}, {v} - {e})"
    term = lambda a, b: f"({a} - {b}) * ln({a} / {b})"
    corners = [term(a, b) for a in (low("a"), f"(a + {e})") for b in (low("b"), f"(b + {e})")]
    return total_of(
        _sampled(edges_p, pmf_p, num_buckets),
        _sampled(edges_q, pmf_q, num_buckets),
        f"greatest({', '.join(corners)})",
    )


BINNED: dict[str, Callable[[str, str], str]] = {
    f.__name__: f
    for f in (
        euclidean_distance,
        manhattan_distance,
        cosine_similarity,
        pearson_correlation,
        spearman_rank_correlation,
        jensen_shannon_divergence,
        kullback_leibler_divergence,
        hellinger_distance,
        wasserstein_distance,
    )
}


def available_metrics() -> list[str]:
    return [*BINNED, "psi"]
