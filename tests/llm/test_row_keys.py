"""Stages decide on rows: rows without an id, repeated rows and shared ids are told apart."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kelpforge.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string"
A, B, C = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_one_row_of_each_text_stays(spark, drop):
    told = lambda rows: sorted((str(r.doc_id), r.text) for r in drop(spark.createDataFrame(rows, SCHEMA)).collect())
    assert told([(None, A), (None, B), (1, A)]) == [("1", A), ("None", B)]
    assert told([(1, A), (1, A), (2, B), (2, B)]) == [("1", A), ("2", B)]
    assert told([(1, A), (2, A), (2, B)]) == [("1", A), ("2", B)]
    assert told([(None, A), (None, A), (None, C)]) == [("None", A), ("None", C)]
    assert told([(1, A), (5, A), (5, B), (None, A), (None, C)]) == [("1", A), ("5", B), ("None", C)]


def test_one_of_identical_rows_is_kept(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame([(1, A)] * 3 + [(2, A), (None, B), (None, B)], SCHEMA)).collect()
    assert sorted((r.kept, str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [
        (False, "1", "1", 4), (False, "1", "1", 4), (False, "2", "1", 4), (False, "None", "None", 2), (True, "1", "1", 4), (True, "None", "None", 2)
    ]


def test_rows_with_clashing_names_and_maps_are_decided(spark):
    docs = spark.createDataFrame([(1, A, {"k": 1}), (1, A, {"k": 1}), (1, A, {"k": 2})], SCHEMA + ", grp map<string,int>").withColumn("__lost", F.lit(1)).withColumn("row", F.lit(2))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 1
    assert simhash.drop_near_duplicates(docs.withColumn("__row", F.lit(3))).count() == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([A, B, C, A + " ", "", None])), min_size=1, max_size=8))
def test_no_text_vanishes(spark, rows):
    """Each distinct text without white space is left once by both stages, whatever the ids."""
    docs = spark.createDataFrame(rows, SCHEMA)
    bare = lambda t: "".join((t or "").split())
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        assert sorted(bare(r.text) for r in drop(docs).collect()) == sorted({bare(t) for _, t in rows})


def test_longest_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "ab")]
    assert [r.text for r in exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()] == ["a  b"]


def test_leak_without_an_id_goes(spark):
    sf = "/root/testdata/sf0.01"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(None, item), (None, A), (1, item), (1, B)], SCHEMA)
    assert sorted(r.text for r in corpus_pipeline.remove_benchmark_leaks(spark, docs, sf).collect()) == [A, B]
