"""Invariants of the operator outputs on the sf0.01 tables."""

from pyspark.sql import functions as F

from citeline.plans.catalog import QUERIES
from citeline.sources.tables import read_table
from paths import SF_CHECK


def q(spark, name):
    return QUERIES[name](spark, SF_CHECK)


def test_clean_text_is_one_line(spark):
    assert q(spark, "page_clean_text").where(F.col("clean_text").contains("\n")).count() == 0


def test_citation_numbers_dense_per_run(spark):
    for name, col in (("page_sources", "citation_index"), ("source_citations", "index")):
        g = q(spark, name).groupBy("research_id").agg(F.count("*").alias("n"), F.min(col).alias("lo"),
                                                        F.max(col).alias("hi"),
                                                        F.countDistinct(col).alias("d"))
        assert g.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).count() == 0


def test_registry_unique_urls(spark):
    df = q(spark, "source_citations")
    assert df.count() == df.select("research_id", "url").distinct().count()


def test_budgets_hold(spark):
    top = q(spark, "doc_top_paragraphs").groupBy("doc_id").agg(F.sum(F.length("piece")).alias("n"))
    assert top.where(F.col("n") > 5000).count() == 0
    ctx = q(spark, "context_compress").collect()
    for r in ctx:
        lines = r.context.split("\n")
        assert len(r.context) <= 8000 or sum(len(x) for x in lines) <= 8000


def test_ttl_decides_every_request(spark):
    n = read_table(spark, SF_CHECK, "events").count()
    out = q(spark, "cache_ttl")
    assert out.count() == n and out.select("event_id").distinct().count() == n


def test_section_context_budget(spark):
    # every selected block but the last fits the 3000-character budget
    for r in q(spark, "section_context").collect():
        blocks = [b for b in r.context.split("\n[") if b]
        assert len(blocks) <= 10
