"""Token ids of whole texts by a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_CHARS = 500_000
ASCII_SPACE = re.compile(r"[\t-\r ]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Printable Latin-1 and ASCII white space: what the fast way knows. A soft hyphen, a special
# token's opening and all other code points are left to the file's own tokenizer.
PLAIN = re.compile(r"[\t-\r -~\xa1-\xac\xae-\xff]*\Z").match
PLAIN_PIECE = re.compile(r"[!-~\xa1-\xac\xae-\xff]*\Z").match
WORD_END = "\x01"
# The split rule of the vocabulary with word ends and its normalizers. The
# rule in use says the same of lower-case Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PLAIN_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+"


def _word_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of every token and its id, word ends as a byte of their own, if the file is BPE
    with word ends, split as above and numbered by bytes, last bytes and merges."""
    model, normalizer, split = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    suffix = model.get("end_of_word_suffix")
    rules = [p.get("pattern", {}).get("Regex") for p in split.get("pretokenizers", [])]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")
    if (
        not suffix
        or any(model.get(k) for k in odd)
        or [n["type"] for n in normalizer.get("normalizers", [])] != NORMALIZERS
        or rules[:1] != [SPLIT]
    ):
        return None
    vocabulary = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(vocabulary.get("".join(pair)) != 512 + i for i, pair in enumerate(pairs)):
        return None
    byte_of, ranks = {c: b for b, c in _byte_alphabet().items()}, {}
    end = WORD_END.encode()
    for token, i in vocabulary.items():
        last = token.endswith(suffix) and token != suffix
        chars = token[: -len(suffix)] if last else token
        ranks[bytes(byte_of[c] for c in chars) + end * last] = i
    # The last bytes of words are taken together first, as their ids are below all merges.
    return ranks if len(ranks) == len(vocabulary) else None


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, equal to encoding each whole text.

    In a vocabulary with word ends, no token reaches over a word. Texts of Latin letters are
    split into words here by the tokenizer's own rule and merged by tiktoken, whose ranks are
    the ids. Of other texts, runs of such pieces go the same way and the rest through the
    tokenizer, piece by piece. Tokenizers of other kinds encode text by text. Nothing is kept
    from one text to the next.
    """

    def __init__(self, path: str):
        # Cores are Spark's to give out.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            ranks = _word_ranks(json.load(file))
        self.merger, self.words = None, re.compile(PLAIN_SPLIT).findall
        if ranks:
            import tiktoken

            rule = f"[^{WORD_END}]++{WORD_END}"
            self.merger = tiktoken.Encoding("words", pat_str=rule, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merger is None:
            return [self._whole(t) for t in texts]
        return [self._plain(t) if PLAIN(t) and "<|" not in t else self._mixed(t) for t in texts]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        words = self.words(text.lower())
        if not words:
            return b""
        return self.merger.encode_to_numpy(WORD_END.join(words) + WORD_END).astype("<u4").tobytes()

    def _mixed(self, text: str) -> bytes:
        """Runs of plain pieces between white space, and odd pieces one by one."""
        pieces = ASCII_SPACE.split(text)
        runs = groupby(pieces, lambda p: bool(PLAIN_PIECE(p)) and "<|" not in p)
        return b"".join(
            self._plain(" ".join(run)) if plain else b"".join(map(self._whole, run)) for plain, run in runs
        )


def in_slices(texts: Iterable[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts (null as empty) in runs of about ``most`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens): ids of the whole text; null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path)
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            sizes = [len(b) // 4 for run in in_slices(texts) for b in encoder.encode(run)]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(count), f"doc_id {kind}, n_tokens long")
