"""Array helpers as SQL fragments.

A fragment is the text of an expression. Composing text and parsing it once keeps the
nested lambdas readable and costs the driver one call instead of thousands.
"""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and call it ``name`` inside ``body``.

    The optimizer merges neighbouring projections, which would copy an expensive
    expression into every iteration of a lambda; a lambda argument is not copied.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def let_pair(p: str, q: str, name: str, body: str) -> str:
    """Like ``let`` for two values, called ``name.p`` and ``name.q``."""
    return let(f"named_struct('p', {p}, 'q', {q})", name, body)


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (acc, v) -> acc + v)"


def total_of(p: str, q: str, term: str) -> str:
    """Sum of a term over a in ``p`` and b in ``q``, taken in step."""
    return total(f"zip_with({p}, {q}, (a, b) -> {term})")


def average_ranks(a: str) -> str:
    """1-based ranks, ties sharing their average rank."""
    rank = "size(filter(r, o -> o < e)) + (size(filter(r, o -> o = e)) + 1) / 2D"
    return let(a, "r", f"transform(r, e -> {rank})")
