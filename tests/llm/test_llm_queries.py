from __future__ import annotations

import pytest

from skysieve.llm import langid, queries

from ..oracle import connection, same

COLUMNS = {
    "p1_found": ["first_record_no", "repeat_record_no"], "p4_found": ["first_event_id", "other_event_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "line_no", "lang_code"],
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        same(df, connection(sf_dir), queries.SQL[name])
    else:
        assert df.count() > 0
    assert df.columns == COLUMNS.get(name, df.columns)


def test_every_document_has_its_language(spark, sf_dir):
    rows = queries.p8_languages(spark, sf_dir).toPandas()
    main = rows[rows.line_no == 0].set_index("doc_id")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    assert sorted(main.index) == sorted(texts.index)
    worded = texts.map(lambda t: any(map(langid.words_of, langid.tokens_of(t or ""))))
    assert (main.lang_code.notna() == worded[main.index]).all() and (main.confidence.notna() == main.lang_code.notna()).all()
