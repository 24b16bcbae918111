import collections

import corpus_pipeline
import pytest

from . import corpus

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key int, kept_id int, row int, place long, block int, copies long, word int"


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] == counts[3] <= counts[4]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    whole = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_names(spark, sf, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for schema in (corpus.SCHEMA, CLASHING):
        empty = spark.createDataFrame([], schema)
        out = stage(spark, empty, sf)
        assert not out.collect()
        docs = spark.createDataFrame(corpus.rows(), schema).repartition(3)
        out = stage(spark, docs, sf)
        assert out.count()
        if not last:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_stages_lose_no_clean_row_of_a_repeated_id(spark, sf):
    """Nulls, empty texts and ids that repeat with different texts go through every stage but the copies' own."""
    rows = corpus.docs_of([(3, "one text of its own"), (5, "another text"), (5, "a third text"), (None, "nameless text"), (6, None), (7, "")])
    docs = corpus.frame(spark, rows)
    texts = sorted(str((r.doc_id, r.text)) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        want = texts if "near" not in name and "substring" not in name and "mixing" not in name else None
        got = sorted(str((r.doc_id, r.text)) for r in docs.collect())
        if want:
            assert got == want, name
        # the empty text and the null one are one text: the smaller id stays
        assert set(texts) - set(got) <= {"(7, '')"}, name


def test_every_query_is_registered():
    from newstide.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
