"""Pipeline stages: repeated ids, the same rows however the table is dealt, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
A = " ".join(f"word{i}" for i in range(60))
B = " ".join(f"other{i}" for i in range(60))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows,want", [
    ([(1, A), (2, A + " more"), (3, B)], [(1, A), (3, B)]),
    ([(1, A), (2, A + " more"), (2, B), (None, A), (None, A), (4, None), (5, "")], [(1, A), (2, B), (None, A), (None, A), (4, None), (5, "")]),
    ([(7, A), (7, A), (7, B), (8, B + " x"), (9, None), (9, None), (9, "")], [(7, A), (7, B), (9, None), (9, "")]),
    ([(5, A), (5, A + " y"), (6, A + " z")], None),
    ([], []),
])
def test_near_copies(spark, rows, want):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], COLUMNS)
    got = kept(corpus_pipeline.near_copies(spark, docs, SF))
    if want is None:
        assert len(got) == 1 and got[0][0] == 5
    else:
        assert got == sorted(want, key=str)


def test_the_same_rows_however_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        found = []
        for n in (1, 4, 16):
            dealt = docs.repartition(n, F.xxhash64("text", F.lit(n)))
            found.append(kept(stage(spark, dealt, SF)))
        assert found[0] == found[1] == found[2] and 0 < len(found[0]) <= docs.count(), name


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
