"""Quality rules, line first.

Every line is held against punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected. Rules for the whole
text (too few words, too much repetition) reject first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from driftspark.llm.workers import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# The line rules. A share of a document's word characters above MOST_LOST rejects it.
MOST_LOST = 0.5
MOST_MARKS = 0.3
OUTER_MARKS = 3
FRAGMENT_WORDS = 3
NAVIGATION_WORDS = 8
# Each boilerplate phrase speaks for so many words of its line; a line with more stays.
BOILERPLATE_WORDS = 30
# Those of other scripts: Chinese and Japanese, Indic, Arabic, Armenian, Ethiopic, Burmese, Khmer, Tibetan.
ENDINGS = tuple(".!?…:;\"'”»)" + "。．｡！？：；」』）】》" + "।॥" + "؟۔؛" + "։՞" + "።፧" + "။" + "។៕" + "།")
SEPARATORS = re.compile(r" [|>»•·/] ?")
# Phrases of English, German, French and Spanish pages. Words that prose of the language uses
# as well (German "Suche", Spanish "inicio") are left to the rule for separators.
NAVIGATION = re.compile(
    r"\b(home|menu|login|log in|sign in|sign up|register|contact us|about us|site ?map|next|previous"
    r"|back to top|search|share|read more|skip to content"
    r"|startseite|impressum|über uns|weiterlesen|zum inhalt springen|nach oben springen"
    r"|accueil|plan du site|lire la suite|se connecter|haut de page|aller au contenu|qui sommes-nous"
    r"|iniciar sesión|mapa del sitio|leer más|volver arriba|ir al contenido|quiénes somos)\b"
)
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|uses cookies"
    r"|enable javascript|javascript is (disabled|required)|subscribe to our newsletter|click here"
    r"|lorem ipsum|powered by|copyright \(c\)|licensed under|permission is hereby granted"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen"
    r"|verwendet cookies|cookie-(einstellungen|richtlinie)|newsletter abonnieren|javascript aktivieren"
    r"|tous droits réservés|politique de confidentialité|mentions légales|conditions générales d.utilisation"
    r"|utilise des cookies|gestion des cookies|abonnez-vous à notre|activer javascript|cliquez ici"
    r"|todos los derechos reservados|política de (privacidad|cookies)|aviso legal|condiciones de uso"
    r"|utiliza cookies|suscríbete a nuestr[oa]|suscríbase a nuestr[oa]|habilitar javascript|haga clic aquí"
)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, its first place included.

    Words are numbered, and windows are numbered by joining the numbers of two shorter ones,
    so that equal numbers mean equal words: no hashing, and memory in proportion to the text.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    base = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    names, size = base, 1
    for step in [1] * (window - 1):
        # Number (window of ``size``, following word) pairs anew.
        joined = names[: len(words) - size - step + 1] * len(numbers) + base[size:]
        names = np.unique(joined, return_inverse=True)[1].reshape(-1)
        size += step
        if names.max(initial=0) + 1 == len(names):  # all different already: longer ones are, too
            return 0
    often = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def is_mark(c: str) -> bool:
    """Punctuation or a symbol; vowel signs and other combining characters belong to words."""
    return not c.isalnum() and unicodedata.category(c)[0] in "PS"


def ends_short(body: str) -> bool:
    """A sentence so short that its own quotes and ending make up much of it: No. or "So?"."""
    marks = list(map(is_mark, body))
    if all(marks) or not body.endswith(ENDINGS):
        return False
    outer = marks.index(False) + marks[::-1].index(False)
    return outer <= OUTER_MARKS and sum(marks) - outer <= MOST_MARKS * len(body)


def line_fault(line: str) -> str | None:
    """Why a line is removed: ``punctuation``, ``navigation``, ``boilerplate``, or None."""
    body = line.strip(SPACES)
    low = body.lower()
    n = len(body.split())
    phrases = sum(1 for _ in BOILERPLATE.finditer(low))
    if phrases and n <= BOILERPLATE_WORDS * phrases:
        return "boilerplate"
    parts = SEPARATORS.split(body)
    if len(parts) > 3 and n <= 4 * len(parts):
        return "navigation"
    if n <= NAVIGATION_WORDS and not body.endswith(ENDINGS) and NAVIGATION.search(low):
        return "navigation"
    marks = sum(not c.isalnum() and unicodedata.category(c)[0] in "PS" for c in body)
    if marks > MOST_MARKS * len(body) and not ends_short(body):
        return "punctuation"
    if n < FRAGMENT_WORDS and not body.endswith(ENDINGS):
        return "punctuation"
    return None


def examine(text: str | None) -> tuple:
    """The base counts, the verdict, and what the line rules removed."""
    text = text or ""
    words = words_of(text)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n, repeated = len(words), repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
    faults = [(line_fault(x), x) for x in lines]
    removed = [x for fault, x in faults if fault]
    lost = sum(len(x) - sum(x.count(c) for c in SPACES) for x in removed)
    kept = not failed and lost <= MOST_LOST * chars
    clean = "\n".join(x for fault, x in faults if not fault) if removed else text
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, len(removed), lost, clean


FIELDS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "lines_removed": "long",
    "chars_removed": "long",
}
ARROW = {"long": pa.int64(), "boolean": pa.bool_()}


def quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, the columns of FIELDS and, if asked for, ``clean_text``.

    Words lie between ASCII white space, lines between line feeds. A null text has no words and
    fails. Each row is looked at on its own, so repeated rows and null ids need nothing; no rows
    give no rows, other columns are ignored. Nothing is shuffled.
    """
    fields = FIELDS | ({"clean_text": "string"} if with_text else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [examine(t)[: len(fields)] for t in batch.column("text").to_pylist()]
            found = [
                pa.array([r[i] for r in rows], ARROW.get(kind, pa.string()))
                for i, kind in enumerate(fields.values())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} {k}" for n, k in fields.items()]])
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
