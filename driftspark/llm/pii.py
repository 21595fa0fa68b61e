"""Personal data, and the terms around it that give it away.

Spans of four kinds are found by expressions and checks. Every checked value is a protected
entity. Over the whole corpus, the information that a term gives about an entity is
PMI(entity; term) = log2(N n(e,t) / (n(e) n(t))) with counts of different texts; as a share of the
entity's own information log2(N / n(e)) it is the term's disclosure. Terms anywhere in a text with a
mention whose disclosure is too high are generalised, and removed if it is higher still.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from driftspark.llm.common import bound, no_spans, small_side, span_text, spans, stored, whole

# The base kinds, in order. Possessive repeats and the anchors give the spans
# of the plain expressions without their backtracking over long runs: a run is entered at its
# start or where the match before ended.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# A term is a word of at least three letters, anywhere in a text with a mention: CONTEXT, its
# reach in code points, has no end.
TERM = r"\p{L}{3,}+"
CONTEXT = 2**31 - 1
# Mentions are covered by code points that no word has, and a word that touches them is no term.
# The letter outside the first plane makes the look behind step by code points.
COVER = "\uffff"
ALONE = (r"(?<![\p{L}" + "\U0001d49c" + COVER + "])", r"(?![\p{L}" + COVER + "])")
FREE_TERM = ALONE[0] + TERM + ALONE[1]
# Code points that are covered together: large blocks, and small ones in them.
COVER_BLOCKS = (1 << 16, 1 << 10)
# Shares of an entity's information, and documents that must show the pair together.
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
LEAST_DOCUMENTS = 2
COPY_SALTS = 32
# A term in a broadcast hash relation takes its bytes and about so many more.
ROW_BYTES = 64
BROADCAST_BYTES = 64 << 20


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octets_fit(s: Column) -> Column:
    """Every part is at most 255, leading zeros aside."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    fits = lambda p: (F.char_length(p) <= 3) & (F.lpad(p, 3, "0") <= "255")
    return F.forall(F.transform(F.split(s, r"\."), part), fits)


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 above 9; the sum ends in 0."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Checked spans by kind. A text that cannot hold a kind is not searched for it."""
    size = lambda s: F.char_length(_digits(s["value"]))
    card = lambda s: size(s).between(14, 19) & _luhn(_digits(s["value"]))
    # Only runs that can have 14 digits are worth a check; shorter ones never match from later on.
    long_run = r"[0-9](?:[\x20-]?[0-9]){13}"
    found = {
        "email": (text.contains("@"), spans(text, EMAIL)),
        "ip": (
            text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
            F.filter(spans(text, IP), lambda s: _octets_fit(s["value"])),
        ),
        "card": (text.rlike(long_run), F.filter(spans(text, CARD), card)),
        "phone": (
            text.contains("+"),
            F.filter(spans(text, PHONE), lambda s: size(s).between(10, 15)),
        ),
    }
    return {k: F.when(may, c).otherwise(no_spans()) for k, (may, c) in found.items()}


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), F.lower(s["value"])))


def _in_blocks(text: Column, found: Column, size: int, inner: Callable[[Column, Column], Column]) -> Column:
    """``inner`` of each run of ``size`` code points and the spans that reach into it, joined."""
    last = F.floor((F.char_length(text) - 1) / size).cast("int")

    def block(b: Column) -> Column:
        reach = F.filter(found, lambda s: (s["start"] < (b + 1) * size) & (s["end"] > b * size))
        own = F.transform(
            reach,
            lambda s: F.struct(
                F.greatest(F.lit(0), s["start"] - b * size).alias("start"),
                F.least(F.lit(size), s["end"] - b * size).alias("end"),
                F.lit("").alias("value"),
            ),
        )
        return bound(F.struct(F.substring(text, b * size + 1, F.lit(size)).alias("t"), own.alias("s")), lambda p: inner(p["t"], p["s"]))

    return F.when(F.char_length(text) == 0, text).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
    )


def _put_covers(text: Column, found: Column) -> Column:
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        at = F.greatest(acc["pos"], s["start"])  # spans of two kinds may overlap
        to = F.greatest(acc["pos"], s["end"])
        gap = F.substring(text, acc["pos"] + 1, at - acc["pos"])
        out = F.concat(acc["out"], gap, F.repeat(F.lit(COVER), to - at))
        return F.struct(to.alias("pos"), out.alias("out"))

    rest = lambda d: F.concat(d["out"], F.substring(text, d["pos"] + 1, F.char_length(text)))
    return F.when(F.size(found) == 0, text).otherwise(bound(F.aggregate(found, start, put), rest))


def _covered(text: Column, found: dict[str, Column]) -> Column:
    """The text with its mentions covered, all places as they were.

    Taken apart into blocks of blocks, as finding a place in a long text takes as long as the
    text before it.
    """
    large, small = COVER_BLOCKS
    both = F.struct(
        F.translate(text, COVER, " ").alias("t"), F.array_sort(F.concat(*found.values())).alias("s")
    )
    inner = lambda t, s: _in_blocks(t, s, small, _put_covers)
    return bound(both, lambda p: _in_blocks(p["t"], p["s"], large, inner))


def _words(pattern: str = FREE_TERM) -> Column:
    return F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))


def _free_terms() -> Column:
    return F.array_distinct(F.transform(_words(), F.lower))


def _sent(table: DataFrame, *names: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, which is stored, with a broadcast hint while its bytes are counted few."""
    size = table.agg(F.sum(sum((F.octet_length(c) for c in names), F.lit(ROW_BYTES)))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def _judged(
    rows: DataFrame, n: int, generalise_at: float, least_documents: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Stored (entity, n_e, most) of the entities that a term can give away, and ``rows`` with
    these only.

    As n(e,t) <= n(e), only a term with n(t) <= ``most`` = N^(1-g) n(e)^g can have a share of g.
    An entity of fewer than ``least_documents`` texts has no pair that counts, so that a text
    with very many addresses of its own is not paired with its words.
    """
    each = rows.select("h", F.explode("entities").alias("entity"))
    # An entity counts where it is mentioned, also if no term stands beside it.
    n_e = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    most = F.pow(F.lit(float(n)), 1 - generalise_at) * F.pow("n_e", F.lit(generalise_at)) * (1 + 1e-9)
    n_e = n_e.filter(F.col("n_e") >= least_documents)
    n_e = stored((n_e.filter(F.col("n_e") < n) if generalise_at > 0 else n_e).withColumn("most", most), "entities")
    own = each.join(_sent(n_e, "entity", limit=limit), "entity").groupBy("h").agg(F.collect_list("entity").alias("entities"))
    return n_e, stored(rows.select("h", "text").join(own, "h"), "pii-judged")


def _telling(
    texts: DataFrame,
    copies: DataFrame,
    rows: DataFrame,
    n_e: DataFrame,
    n: int,
    generalise_at: float,
    least_documents: int,
    limit: int,
) -> DataFrame:
    """Stored (entity, term, disclosure) of the pairs that are generalised or removed.

    ``n_e`` and ``rows`` are those of ``_judged``; ``n`` counts the different ones of ``texts``.
    Words too common for any entity are not paired; and no pair has more documents than its
    entity and its term.
    """
    most_texts = n_e.agg(F.max("most")).first()[0] or 0.0
    asked = rows.select(F.explode(_free_terms()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    asked = asked.filter(F.col("seen").between(least_documents, most_texts)).select("term")
    n_t = document_frequency(texts, stored(asked, "asked-terms"), copies, limit).filter(F.col("n_t") <= most_texts)
    n_t = stored(n_t, "term-counts")
    pairs = (
        rows.select("entities", F.explode(_free_terms()).alias("term"))
        .join(_sent(n_t, "term", limit=limit), "term")
        .select("term", "n_t", F.explode("entities").alias("entity"))
        .join(_sent(n_e, "entity", limit=limit), "entity")
        .filter("n_t <= most")
        .groupBy("entity", "term", "n_e", "n_t")
        .agg(F.count(F.lit(1)).alias("n_et"))
        .filter(F.col("n_et") >= least_documents)
    )
    pmi = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    own = F.log2(F.lit(float(n)) / F.col("n_e"))
    share = F.when(own > 0, pmi / own).otherwise(0.0)
    told = pairs.select("entity", "term", share.alias("disclosure"))
    return stored(told.filter(F.col("disclosure") >= generalise_at), "telling")


def _places(words: str) -> Column:
    """Spans of the given words where they stand alone in the covered text; the terms as values."""
    told = F.filter(spans(F.col("text"), FREE_TERM), lambda s: F.array_contains(words, s["value"]))
    found = F.transform(
        told,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")),
    )
    return F.when(F.size(words) > 0, found).otherwise(no_spans())


def document_frequency(
    docs: DataFrame, terms: DataFrame, copies: DataFrame | None = None, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """In how many different texts of ``docs`` each of ``terms`` occurs: all rows, whole texts.

    ``terms`` is a stored table. While its bytes are counted few it is sent to the scan, so
    that other words are not shuffled; beyond that all words are counted and joined. A text
    that ``copies``, stored (h, copies), lists as stored several times counts in every row by
    its share, so that counts are added up map-side all the same.
    """
    # Lower-casing may add marks that end a word: found first, lower-cased then, as free terms are.
    words = F.array_distinct(F.regexp_extract_all(whole("text"), F.lit(TERM), F.lit(0)))
    lowered = F.array_distinct(F.transform(words, F.lower)).alias("terms")
    rows = docs.select(F.xxhash64(whole("text")).alias("h"), lowered)
    if copies is None:
        rows = rows.withColumn("share", F.lit(1.0))
    else:
        rows = rows.join(small_side(copies, limit // ROW_BYTES), "h", "left")
        rows = rows.withColumn("share", 1.0 / F.coalesce("copies", F.lit(1)))
    seen = rows.select("share", F.explode("terms").alias("term"))
    sent = _sent(terms, "term", limit=limit)
    if sent is not terms:
        seen = seen.join(sent, "term", "left_semi")
    counted = seen.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t"))
    return counted if sent is not terms else counted.join(terms, "term", "left_semi")


def sanitise(
    docs: DataFrame,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
    least_documents: int = LEAST_DOCUMENTS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), email, ip, card, phone, and
    ``generalise`` and ``remove``: arrays of (start, end, value).

    Counts are different texts of the whole corpus: copies of one text are one witness, and
    what it tells is marked in all of them. A pair counts from ``least_documents`` texts on:
    one sighting says nothing about how often the two go together. Rows with equal text have
    equal spans. A null text is empty, a null id is an id like any other, no rows give no
    rows, other columns are ignored. Very many mentions in one text are each found, covered
    and counted in about constant time.
    """
    texts = docs.select("doc_id", "text")
    text = whole("text")
    found = texts.select(
        "doc_id", F.xxhash64(text).alias("h"), *[c.alias(k) for k, c in base_spans(text).items()],
        text.alias("text"),
    )
    anything = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    covered = F.when(anything, _covered(F.col("text"), {k: F.col(k) for k in KINDS}))
    base = stored(found.select("doc_id", "h", *KINDS, covered.alias("text")), "pii")
    entities = F.array_distinct(F.concat(*map(_entities, KINDS))).alias("entities")
    rows = base.filter("text is not null").select("h", "text", entities)
    # Copies fold within their tasks first, so that a large group of them meets nowhere.
    rows = rows.groupBy("h").agg(F.first(F.struct("text", "entities")).alias("one"))
    rows = stored(rows.select("h", "one.text", "one.entities"), "pii-mentions")
    copies = base.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = stored(copies, "pii-copies")
    different = base.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    n_e, rows = _judged(rows, different, generalise_at, least_documents, broadcast_bytes)
    telling = _telling(texts, copies, rows, n_e, different, generalise_at, least_documents, broadcast_bytes)

    terms = stored(telling.select("term").distinct(), "telling-terms")
    marked = (
        rows.select("h", "entities", F.explode(_words()).alias("word"))
        .withColumn("term", F.lower("word"))
        .join(_sent(terms, "term", limit=broadcast_bytes), "term")
        .select("h", "word", "term", F.explode("entities").alias("entity"))
        .join(_sent(telling, "entity", "term", limit=broadcast_bytes), ["entity", "term"])
        .groupBy("h", "word")
        .agg(F.max("disclosure").alias("disclosure"))
    )
    high = F.col("disclosure") >= remove_at
    per_text = marked.groupBy("h").agg(
        F.collect_list(F.when(~high, F.col("word"))).alias("__generalise"),
        F.collect_list(F.when(high, F.col("word"))).alias("__remove"),
    )
    # A third of all rows may be copies of one text: they are dealt by their ids as well.
    salts = F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))
    per_text = per_text.withColumn("__salt", salts)
    salted = base.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS)).cast("int"))
    return salted.join(per_text, ["h", "__salt"], "left").select(
        "doc_id", "h", *KINDS, *[_places(f"__{c}").alias(c) for c in ("generalise", "remove")]
    )


def sanitised_text(text: Column, row: Column) -> Column:
    """The text with its spans replaced: entities by their kind, telling terms by TERM or nothing.

    ``row`` is a struct of ``sanitise``'s span columns for this text.
    """
    to = {k: f"[{k.upper()}]" for k in KINDS} | {"generalise": "[TERM]", "remove": ""}


    def named(kind: str) -> Column:
        return F.transform(
            row[kind],
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(to[kind]).alias("to")),
        )

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["pos"]  # spans of two kinds may overlap: the first one stands
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, s["to"])).alias("out"),
        )

    done = F.aggregate(F.array_sort(F.concat(*map(named, to))), start, put)
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.char_length(text)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = [(k, F.col(k)) for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text([*base, ("generalise", F.col("generalise")), ("remove", F.col("remove"))]).alias("spans"),
    )
