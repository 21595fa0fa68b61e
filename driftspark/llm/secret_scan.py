"""Secret scans through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match
must contain. One scan posts the trigrams that the rules ask for, postings are intersected
by document, and only the candidates are searched with the expressions themselves. A rule
without mandatory trigrams is searched in every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from driftspark.llm.common import bound, no_spans, small_side, span_text, spans, stored, whole

MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of a match is its value; ``keep`` says of a span whether it counts."""

    kind: str
    pattern: str
    group: int = 0
    keep: Callable[[Column], Column] | None = field(default=None, compare=False)


# The three base kinds. Runs shorter than asked for are left to the expression
# where that finds the same spans as dropping them afterwards.
BASE = [
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        lambda s: F.char_length(s["value"]) >= 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
# Further public token formats.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

# --- Boolean trigram queries --------------------------------------------------------------

Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset([frozenset()])


def _grams(words: set[str]) -> Clauses:
    """Any of the words: each asks for all its trigrams."""
    return _simplest({frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words})


def _simplest(clauses) -> Clauses:
    """Without clauses that ask for more than another one does."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _simplest({x | y for x, y in product(a, b)})


def _strings(op: str, arg) -> set[str] | None:
    """All strings that an element can match, or None if they are too many."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        chars = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        found = [_sequence_strings(b) for b in arg[1]]
        return None if None in found else set().union(*found)
    if op in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        counts = range(arg[0], arg[1] + 1)
        return {"".join(p) for n in counts for p in product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        one = _strings(str(op), arg)
        if one is None or len(found) * len(one) > MOST_ALTERNATIVES:
            return None
        found = {a + b for a, b in product(found, one)}
    return found


def _sequence_query(items) -> Clauses:
    """What every match of a sequence contains: runs of enumerable parts, and inner queries."""
    query, run = ANYTHING, {""}
    for op, arg in items:
        one = _strings(str(op), arg)
        if one is not None and len(run) * len(one) <= MOST_ALTERNATIVES:
            run = {a + b for a, b in product(run, one)}
            continue
        query, run = _both(query, _grams(run)), {""} if one is None else one
        if str(op) == "SUBPATTERN":
            query = _both(query, _sequence_query(arg[3]))
        elif str(op) == "BRANCH":
            query = _both(query, _simplest(set().union(*map(_sequence_query, arg[1]))))
        elif str(op).endswith("REPEAT") and arg[0] > 0:
            query = _both(query, _sequence_query(arg[2]))
    return _both(query, _grams(run))


def trigram_query(pattern: str) -> Clauses:
    """Lower-case trigrams of any match: one of the sets is complete in the matched text.

    An empty set asks for nothing: the pattern has no mandatory trigrams.
    """
    return _sequence_query(re._parser.parse(pattern))


# --- index, candidates, search ------------------------------------------------------------


def post_trigrams(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The stored inverted index: (gram, doc_id), sorted by gram within each file."""
    present = bound(
        F.lower(whole("text")),
        lambda low: F.array_compact(F.array(*[F.when(low.contains(g), F.lit(g)) for g in grams])),
    )
    postings = docs.select("doc_id", F.explode(present).alias("gram"))
    return stored(postings.select("gram", "doc_id").sortWithinPartitions("gram"), "postings")


def candidates(postings: DataFrame, rules: dict[str, Clauses]) -> DataFrame:
    """Stored (doc_id, rules): bit i is set if the document meets rule i's query.

    A clause's posting lists are intersected by adding up its bits per document, which is
    done map-side first; the clauses of a rule are united by a second aggregation.
    """
    wanted = [
        (i, c, 1 << g, (1 << len(clause)) - 1, gram)
        for i, clauses in enumerate(rules.values())
        for c, clause in enumerate(sorted(map(sorted, clauses)))
        for g, gram in enumerate(clause)
    ]
    table = postings.sparkSession.createDataFrame(
        wanted, "rule int, clause int, bit long, complete long, gram string"
    )
    met = (
        postings.join(F.broadcast(table), "gram")
        .groupBy("doc_id", "rule", "clause", "complete")
        .agg(F.bit_or("bit").alias("bits"))
        .filter("bits = complete")
    )
    rule_bits = F.expr("bit_or(shiftleft(1L, rule))").alias("rules")
    return stored(met.groupBy("doc_id").agg(rule_bits), "candidates")


def _search(rule: Rule) -> Column:
    text = whole("text")
    found = spans(text, rule.pattern, rule.group)
    if rule.keep:
        found = F.filter(found, rule.keep)
    return F.when(text.rlike(rule.pattern), found).otherwise(no_spans())


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and, per rule, its spans (start, end, value) as an array named by its kind.

    Spans are leftmost and do not overlap within a kind; positions count code points, the
    end is exclusive. A null text is empty, a null doc_id is an id like any other; repeated
    rows and ids are searched row by row; no rows give no rows. Other columns are ignored.

    Rows that are no candidates do not carry their text into the join, and candidates are
    joined by a broadcast while they are counted small.
    """
    rules = rules or BASE + MORE
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANYTHING}
    everywhere = [r for r in rules if r.kind not in indexed]
    grams = sorted({g for q in indexed.values() for clause in q for g in clause})
    texts = docs.select("doc_id", "text")
    if indexed:
        chosen = candidates(post_trigrams(texts, grams), indexed)
    else:
        chosen = texts.sparkSession.createDataFrame([], "doc_id long, rules long")
    chosen = small_side(chosen.withColumnRenamed("doc_id", "__id"))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    bit = {kind: 1 << i for i, kind in enumerate(indexed)}
    searched = [
        (_search(r) if r in everywhere else F.when(F.col("rules").bitwiseAND(bit[r.kind]) != 0, _search(r)).otherwise(no_spans())).alias(r.kind)
        for r in rules
    ]
    hits = texts.join(chosen, same).select("doc_id", *searched)
    full = texts.select("doc_id", *[_search(r).alias(r.kind) for r in everywhere])
    rest = full.join(chosen, same, "left_anti").select(
        "doc_id", *[(F.col(r.kind) if r in everywhere else no_spans()).alias(r.kind) for r in rules]
    )
    return hits.unionByName(rest)


def digest(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    kinds = lambda rs: [(r.kind, F.col(r.kind)) for r in rs]
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(span_text(kinds(BASE)), 256).alias("base_sha256"),
        span_text(kinds(rules or BASE + MORE)).alias("spans"),
    )
