"""Quality rules, languages and URL filters."""

from __future__ import annotations

import zlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from driftspark.llm import language as lg, quality as ql, queries, url_filters as uf

# --- quality ------------------------------------------------------------------------------------


def simple_quality(text):
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    seen, duplicate = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            duplicate += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, duplicate, len(covered), failed


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "no_docs"])
def test_base_quality(source, request, plain):
    docs = request.getfixturevalue(source)
    rows = ql.quality(docs).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(got, key=repr) == sorted([(i, *simple_quality(t)) for i, t in plain(docs)], key=repr)
    assert not any(r.kept and r.base_failed for r in rows)


def test_repeated_windows():
    rng = np.random.default_rng(0)
    for _ in range(50):
        words = [bytes([97 + c]) for c in rng.integers(0, 3, rng.integers(0, 60))]
        assert ql.repeated_words(words) == simple_quality(b" ".join(words).decode())[4]


@pytest.mark.parametrize(
    "line, fault",
    [
        ("The meeting was moved to Thursday because of the storm.", None),
        ("A heading without a full stop", None),
        ("Home | About | Products | Contact", "navigation"),
        ("Sign in to search", "navigation"),
        ("They walked home in the rain.", None),
        ("© 2024 Example. All rights reserved.", "boilerplate"),
        ("This site uses cookies to work.", "boilerplate"),
        ("*** ### $$$", "punctuation"),
        ("No.", None),
        ("So?", None),
        ("« Oui ! »", None),
        ("¿Qué?", None),
        ("?!", "punctuation"),
        ("a $$$ b )", "punctuation"),
        ("Alle Rechte vorbehalten.", "boilerplate"),
        ("Tous droits réservés.", "boilerplate"),
        ("Todos los derechos reservados. Política de privacidad.", "boilerplate"),
        ("Startseite | Kontakt | Impressum", "navigation"),
        ("Accueil | Qui sommes-nous", "navigation"),
        ("Iniciar sesión", "navigation"),
        ("Die Suche nach dem verlorenen Schlüssel", None),
        ("Al inicio de la historia nadie lo sabía", None),
        ("page", "punctuation"),
        ("Yes.", None),
    ],
)
def test_line_rules(line, fault):
    assert ql.line_fault(line) == fault


def test_documents_that_lose_too_much(spark):
    prose = "The storm came in from the west.\nNobody had closed the upper windows.\nBy noon all the papers were wet."
    menu = "\n".join(f"Page{i} | About{i} | Team{i} | Jobs{i} | Press{i}" for i in range(12))
    docs = spark.createDataFrame([(1, prose), (2, prose + "\nHome | A | B | C"), (3, menu)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ql.quality(docs, with_text=True).collect()}
    assert [rows[i].kept for i in (1, 2, 3)] == [True, True, False]
    assert rows[1].clean_text == prose and rows[2].clean_text == prose and rows[2].lines_removed == 1


def test_long_line_with_a_boilerplate_phrase(spark):
    """A phrase in passing does not take the whole document with it."""
    text = " ".join(f"In y{i} the v{i} bought m{i} of b{i}." for i in range(400))
    text += " Later it had a pump powered by steam."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = ql.quality(docs, with_text=True).first()
    assert row.kept and row.lines_removed == 0 and row.clean_text == text
    assert ql.line_fault("Click here. " + " ".join(["Powered by steam, all rights reserved."] * 20)) == "boilerplate"


def test_clean_text_in_other_scripts(spark):
    hindi = "हिन्दी में लिखी हुई किताबें पढ़ना मुझे बचपन से ही बहुत पसंद है।"
    tamil = "தமிழில் எழுதிய புத்தகங்களை படிக்க எனக்கு மிகவும் பிடிக்கும் என்று நேற்று அவள் சொன்னாள்."
    chinese = "昨天我们在图书馆里读了一本很有意思的书。"
    docs = spark.createDataFrame([(1, hindi), (2, tamil), (3, f"{hindi}\n{chinese}")], "doc_id long, text string")
    assert [(r.kept, r.lines_removed) for r in ql.quality(docs).collect()] == [(True, 0)] * 3
    assert ql.line_fault(chinese) is None and ql.line_fault("。。。！！！") == "punctuation"


def test_most_documents_pass_the_line_rules(real_docs):
    rows = ql.quality(real_docs).collect()
    passed = [r.kept for r in rows if not r.base_failed]
    assert sum(passed) > 0.9 * len(passed)


# --- languages ----------------------------------------------------------------------------------


def test_held_out_accuracy(real_docs):
    truth = {r.doc_id: r for r in real_docs.collect()}
    rows = lg.predict_languages(real_docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    out = [r for r in rows if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in out)
    assert right >= 0.97 * len(out) > 10


def test_odd_texts(odd_docs, no_docs):
    rows = {r.doc_id: r for r in lg.predict_languages(odd_docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 8))
    assert rows[6].lang_pred in {"en", "fr"}
    assert lg.predict_languages(no_docs).collect() == []
    kept = lg.identified_documents(odd_docs)
    assert kept.columns == odd_docs.columns and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}
    nothing = lg.predict_languages(odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS string) lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some words", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in lg.predict_languages(docs).collect()} == {("en", 1.0)}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords(n):
    code = lg.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    assert not (np.abs(code.sum(axis=0)) == n).any()
    apart = (code.shape[1] - code @ code.T) / 2 + n * 100 * np.eye(n)
    assert apart.min() >= 1 and (n < 9 or apart.min() >= code.shape[1] / 5)


def test_weak_bits_are_outvoted():
    """Any two codewords of four languages differ in four bits: one wrong bit changes nothing."""
    code = lg.codewords(4)
    model = lg.Model(list("abcd"), code, np.zeros((1, code.shape[1])), np.ones(code.shape))
    for i, word in enumerate(code):
        for b in range(len(word)):
            margins = word.copy()
            margins[b] *= -1
            assert model.decode(2 * margins[None])[0][0] == i
    assert model.decode(np.zeros((1, code.shape[1])))[2][0]


def test_long_texts_in_pieces(monkeypatch):
    text = "zwölf Boxkämpfer jagen Viktor " * 40
    whole = lg.trigram_counts(text)
    monkeypatch.setattr(lg, "SLICE", 50)
    # Every trigram once, and the blanks that stand around a piece.
    assert (lg.trigram_counts(text) >= whole).all()


# --- URL filters --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host",
    [
        ("https://User:pw@WWW.Example.com:8080/a?b#c", "www.example.com"),
        ("http://example.com.", "example.com"),
        ("ftp://a.b.c?x", "a.b.c"),
        ("no url", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_hosts(spark, url, host):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(uf.url_host(df.url)).first()[0] == host


def active_on(log, entry, day):
    """Categories in which the entry is on the list that day, by replaying the log."""
    out = set()
    for c in {r[1] for r in log if r[0] == entry}:
        changes = [(d, not added) for e, k, d, added in log if e == entry and k == c and d and d <= day]
        if changes and not max(changes)[1]:
            out.add(c)
    return out


@pytest.mark.parametrize("broadcast_rows", [uf.BROADCAST_ROWS, 0])
def test_captures_as_of_their_day(spark, broadcast_rows):
    rng = np.random.default_rng(3)
    start = date(2024, 1, 1)
    day = lambda n: start + timedelta(int(n))
    entries = ["example.com", "bad.example.com", "org", "x.org"]
    log = [(entries[rng.integers(4)], ["adult", "ads"][rng.integers(2)], day(rng.integers(0, 200)), bool(rng.integers(2))) for _ in range(60)]
    log += [(None, "ads", day(3), True), ("x.org", "ads", None, True)]
    urls = ["http://bad.example.com/x", "http://example.com", "https://deep.x.org/1", "http://other.net", None]
    pages = [(i, urls[i % 5], day(rng.integers(0, 220)) if i % 11 else None) for i in range(200)] + [(0, urls[0], None)] * 2
    got = uf.filter_captures(
        spark.createDataFrame(pages, "page_id long, url string, fetched date"),
        spark.createDataFrame(log, "entry string, category string, day date, added boolean"),
        broadcast_rows,
    ).collect()
    assert len(got) == len(pages)
    for r in got:
        names = [r.host.split(".", i)[-1] for i in range(r.host.count(".") + 1)] if r.host else []
        active = [(-len(e), c, e) for e in names for c in (active_on(log, e, r.fetched) if r.fetched else ())]
        assert r.n_active == len(active) and r.blocked == bool(active)
        assert (r.entry, r.category) == ((min(active)[2], min(active)[1]) if active else (None, None))


def test_no_pages_and_no_list(spark, docs_dir):
    pages, log = queries.captures(spark, docs_dir), queries.list_log(spark, docs_dir)
    assert uf.filter_captures(pages.limit(0), log).collect() == []
    assert {r.blocked for r in uf.filter_captures(pages, log.limit(0)).collect()} == {False}


def test_very_long_urls_and_other_columns(spark):
    day = date(2024, 1, 5)
    deep = "a." * 200_000 + "bad.org"
    pages = [(1, f"https://{deep}/", day, "x", 9), (2, "https://bad.org/" + "p" * 1_000_000, day, "y", 9)]
    pages += [(3, "https://abad.org", day, "z", 9), (None, "https://bad.org", day, "z", 9)]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date, entry string, month int")
    log = spark.createDataFrame([("bad.org", None, day, True, "h")], "entry string, category string, day date, added boolean, host string")
    got = {r.page_id: (r.n_active, r.blocked, r.entry, r.category) for r in uf.filter_captures(captures, log).collect()}
    hit = (1, True, "bad.org", None)
    assert got == {1: hit, 2: hit, 3: (0, False, None, None), None: hit}
