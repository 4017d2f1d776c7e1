"""Which rows stay where ids repeat, and joins of hot keys."""

import corpus_pipeline as C
from fieldgrid.llm import common, neardup, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string"


def kept(spark, rows, find):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], DOCS)
    out = neardup.keep_one_each(docs, find)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_repeated_ids_with_other_texts_lose_none(spark):
    a, b, c = ("the quick brown fox " * 9, "eine ganz andere zeile " * 9, "y una tercera cosa nueva " * 9)
    for find in (neardup.near_duplicates, similar.similar):
        assert kept(spark, [(1, a), (5, a), (5, b), (7, b)], find) == sorted([(1, a), (5, b)], key=repr)
        assert kept(spark, [(5, b), (5, a), (5, b), (5, c), (6, c)], find) == sorted([(5, a), (5, b), (5, c)], key=repr)
        assert kept(spark, [(None, a), (None, a), (2, None), (3, ""), (3, "")], find) == sorted([(None, a), (None, a), (2, None)], key=repr)


def test_stage_keeps_a_row_of_each_text(spark):
    rows = [(i % 40, f"w{i // 4} " * 30) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], DOCS)
    out = C.near_dedup_stage(spark, docs, "").collect()
    assert {r.text for r in out} == {t for _, t in rows} and len(out) == 100


def test_join_of_hot_keys(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(9000)], "k long, v long")
    unique = spark.range(9000).selectExpr("id AS k", "id * 2 AS w")
    got = sorted(map(tuple, common.join_unique(rows, unique, "k").select("k", "v", "w").collect()))
    assert got == sorted((k, v, 2 * k) for k, v in map(tuple, rows.collect()))
    assert common.join_unique(rows.limit(0), unique, "k").count() == 0
