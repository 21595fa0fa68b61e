"""The stages one after the other, each against what its operator says of its own input."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline as cp
import pytest

from driftspark.llm import exact_dedup, language, mixing, simhash
from driftspark.llm.common import stored, whole, word_count
from driftspark.session import shared_dir


@pytest.mark.parametrize("source", ["real_docs", "odd_docs", "no_docs"])
def test_stages(spark, source, request, docs_dir):
    docs = request.getfixturevalue(source)
    kept = {}
    for name, stage in cp.STAGES:
        given, docs = docs, stored(stage(spark, docs, docs_dir), "test")
        kept[name] = (given, docs)
        if name != "packing":
            assert docs.columns == given.columns
    ids = lambda df: sorted([r.doc_id for r in df.collect()], key=repr)
    given, out = kept["language"]
    assert ids(out) == ids(language.predict_languages(given).filter("lang_pred <> 'und' AND NOT ambiguous"))
    given, out = kept["exact_dedup"]
    assert ids(out) == ids(exact_dedup.duplicates(given).filter("kept"))
    given, out = kept["near_dedup"]
    assert out.count() == simhash.near_duplicates(given).select("component_id").distinct().count()
    given, out = kept["mixing"]
    size = word_count(whole("text"))
    taken = mixing.mix(given.select("doc_id", "source", size.alias("size"))).agg({"taken": "sum"}).first()[0]
    assert out.select(size.alias("n")).agg({"n": "sum"}).first()[0] == taken
    given, out = kept["packing"]
    assert out.select("doc_id").distinct().count() == given.select("doc_id").distinct().count()


def test_clean_documents_stay(real_docs):
    """The language stage rejects next to nothing that has letters."""
    with_letters = real_docs.filter(r"text rlike '\\p{L}'").count()
    assert language.identified_documents(real_docs).count() >= 0.98 * with_letters


def test_run(spark, docs_dir):
    assert cp.run(spark, docs_dir).count() > 0


def test_tables_are_dropped_after_use(spark, docs_dir):
    """A run leaves the tables of its last stage, which its result is read from, and no others."""
    folder = Path(shared_dir(spark))
    before = set(folder.glob("llm-*"))
    assert cp.run(spark, docs_dir).count() > 0
    left = {p.name.split("-")[1] for p in set(folder.glob("llm-*")) - before}
    assert left == {"pieces"}
