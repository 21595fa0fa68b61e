"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit, a binary n-gram classifier tells the languages
with a 1 from those with a 0. Decoding takes the codeword with the least weighted loss over
all bits, where a bit weighs as much as it proved right for that language, and flags texts
whose two best codewords lie close together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 1 << 14  # hashed byte trigrams
EXHAUSTIVE = 5  # up to so many languages every split into two is a bit
BITS_PER_DOUBLING = 12  # beyond, so many bits for each doubling of the languages
SHARPNESS = 12.0  # from mean log-odds per trigram to a margin
AMBIGUOUS_BELOW = 0.05
SLICE = 1 << 20
UNKNOWN = "und"
SEED = 7


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """Rows of +1 and -1, one per language; no bit is the same for all languages."""
    if n <= EXHAUSTIVE:
        bits = range(1, 1 << (n - 1)) if n > 1 else []
        rows = [[-1] * len(bits)] + [[1 if b >> i & 1 else -1 for b in bits] for i in range(n - 1)]
        return np.array(rows, float).reshape(n, len(bits))
    rng, best, apart = np.random.default_rng(seed), None, -1
    width = int(np.ceil(BITS_PER_DOUBLING * np.log2(n)))
    for _ in range(50):  # the drawing whose closest codewords lie furthest apart
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        closest = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if closest > apart:
            best, apart = code, closest
    return best


# --- trigrams --------------------------------------------------------------------------------


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.int64)
    return ((b[:-2] * 33 + b[1:-1]) * 33 + b[2:]) * 40503 % 65521 % FEATURES


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that overlap by two bytes: all its trigrams, whatever its length."""
    for at in range(0, max(1, len(data)), SLICE):
        yield data[max(0, at - 2) : at + SLICE]


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def trigram_counts(text: str | None) -> np.ndarray:
    counts = np.zeros(FEATURES, np.int64)
    for piece in _pieces(_lowered(text)):
        counts += np.bincount(_trigrams(piece), minlength=FEATURES)
    return counts


@dataclass
class Model:
    """Everything that prediction needs; its size depends on the languages only."""

    languages: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None  # languages x bits, +1 and -1
    odds: np.ndarray | None = None  # trigrams x bits: log-odds of the bit being +1
    weights: np.ndarray | None = None  # languages x bits: how often the bit was right

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Texts x bits: the mean log-odds of all trigrams of each text, sharpened."""
        sums, sizes = np.zeros((len(texts), self.odds.shape[1])), np.ones(len(texts))
        for i, text in enumerate(texts):
            data, total = _lowered(text), 0
            for piece in _pieces(data):
                grams = _trigrams(piece)
                if len(grams) > FEATURES // 4:
                    sums[i] += np.bincount(grams, minlength=FEATURES) @ self.odds
                else:
                    sums[i] += self.odds[grams].sum(axis=0, dtype=float)
                total += len(grams)
            sizes[i] = max(1, total)
        return SHARPNESS * sums / sizes[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score, and whether the second best is too close."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        total = (self.weights[None] * loss).sum(axis=2)
        chance = np.exp(-(total - total.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = total.argmin(axis=1)
        top = np.sort(chance, axis=1)[:, ::-1]
        score = top[:, 0]
        close = top[:, 0] - top[:, 1] < AMBIGUOUS_BELOW if top.shape[1] > 1 else np.zeros(len(best), bool)
        return best, score, close

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """A language per text, ``und`` with score 0 where no letter is or none was learned."""
        letters = [bool(t) and HAS_LETTER(t) is not None for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        best, score, close = self.decode(self.margins(texts))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        scores = [float(s) if ok else 0.0 for s, ok in zip(score, letters)]
        return names, scores, [bool(c) and ok for c, ok in zip(close, letters)]


HAS_LETTER = regex.compile(r"\p{L}").search


# --- learning --------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has seen of each language: (lang, trigram, n)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            known = sums.setdefault(lang, np.zeros(FEATURES, np.int64))
            known += trigram_counts(text)
    for lang, counts in sums.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(counts[seen])],
            ["lang", "trigram", "n"],
        )


def _count_right(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, docs = np.zeros(model.codes.shape, np.int64), np.zeros(len(model.languages), np.int64)
        place = {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], int)
            agree = np.sign(model.margins(batch.column("text").to_pylist())) == model.codes[lang]
            np.add.at(right, lang, agree)
            np.add.at(docs, lang, 1)
        i, b = np.indices(right.shape)
        columns = [i.ravel(), b.ravel(), right.ravel(), np.repeat(docs, right.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["i", "b", "n", "docs"])

    return count


def train(docs: DataFrame) -> Model:
    """Learns from text and lang of every row that is not held out and has both.

    Trigram counts by language are summed over all those rows, task by task. A bit's classifier
    compares the mean trigram distributions of its two sides, so a frequent language does not
    outweigh a rare one. A second pass counts how often each bit is right for each language.
    What reaches the driver is bounded by languages x trigrams.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), "text")
    counted = known.mapInArrow(tidy(_count_trigrams), "lang string, trigram int, n long")
    rows = counted.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return Model()
    languages = sorted(rows["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((len(languages), FEATURES), 0.5)
    np.add.at(counts, (rows["lang"].map(place).to_numpy(), rows["trigram"].to_numpy()), rows["n"].to_numpy())
    share = counts / counts.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    yes, no = codes > 0, codes < 0
    odds = np.log(share.T @ (yes / np.maximum(1, yes.sum(axis=0)))) - np.log(
        share.T @ (no / np.maximum(1, no.sum(axis=0)))
    )
    model = Model(languages, codes, odds.astype(np.float32), np.ones(codes.shape))
    if codes.size:
        proved = known.mapInArrow(tidy(_count_right(model)), "i long, b long, n long, docs long")
        for r in proved.groupBy("i", "b").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect():
            model.weights[r.i, r.b] = (r.n + 1) / (r.docs + 2)
    # Each language's weights add up to the number of bits.
    model.weights *= codes.shape[1] / np.maximum(1e-9, model.weights.sum(axis=1, keepdims=True))
    return model


# --- prediction ------------------------------------------------------------------------------


def predict_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Only the text decides. A null text or one without a letter is ``und`` with score 0, and so
    is every text if no labelled row was there to learn from. Whole texts are read, however
    long. Equal rows have equal results; no rows give no rows; other columns are ignored.
    """
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, close = model.predict(batch.column("text").to_pylist())
            columns = [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(tidy(run), schema)


def identified_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` with a language: neither ``und`` nor ambiguous. No column changes."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, close = model.predict(batch.column("text").to_pylist())
            keep = [n != UNKNOWN and not c for n, c in zip(names, close)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
