"""Queries that must use every row of their tables."""

from pyspark.sql import functions as F

from kelpforge.plans import catalog, records  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_pages_hold_every_vector_in_bounded_lists(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    gram = catalog.QUERIES["page_gram_matrix"](spark, SF)
    assert gram.select("item_a").distinct().count() == vectors.count()
    assert gram.groupBy("item_a").count().agg(F.max("count")).first()[0] <= 60
    pages = {r.page for r in vectors.select(F.expr("concat(label, ':', vec_id div 200)").alias("page")).collect()}
    assert {r.page for r in catalog.QUERIES["list_diversity"](spark, SF).collect()} == pages
