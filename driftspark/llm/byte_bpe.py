"""Token ids of whole texts by a byte-level BPE file, with the merges done by tiktoken.

A byte-level vocabulary numbers its tokens in the order of its merges, so that the ids are
the ranks that tiktoken asks for. The file's own tokenizer is taken where that does not hold,
and for a text that tiktoken refuses.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
from pyspark import cloudpickle

from driftspark.llm.tokens import _byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the split rule of byte-level vocabularies, in the form without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of every token and its id, if the file is plain byte-level BPE numbered by merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE"
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not plain or split.get("add_prefix_space") or any(model.get(k) for k in odd):
        return None
    vocabulary = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(vocabulary.get("".join(pair)) != 256 + i for i, pair in enumerate(pairs)):
        return None
    byte_of = {c: b for b, c in _byte_alphabet().items()}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}


class ByteEncoder:
    """Texts to arrays of ids, equal to encoding each text with the tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.full = Tokenizer.from_file(path)
        ids = [*added.values(), *spec["model"]["vocab"].values()]
        self.kind = "<u2" if max(ids) < 1 << 16 else "<u4"
        self.fast, ranks = None, _ranks(spec)
        if ranks and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # a run too long for its expressions
                pass
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4")
