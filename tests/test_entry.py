import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "n_selected", "n_found", "egain"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(monkeypatch):
    for name in ("newstide.llm", "newstide.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    names = entry.queries()
    assert "flagship" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
