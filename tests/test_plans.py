"""Plan checks: text operators stay JVM-side, scans are pruned, windows are
partitioned, per-document operators do not shuffle."""

import pytest

from citeline.plans.catalog import QUERIES
from paths import SF_SMALL

PYTHON_OK = {"cache_ttl", "cache_ttl_stream", "result_links"}     # the TTL fold and the HTML tokenizer
NO_SHUFFLE = {"page_clean_text", "page_metadata", "page_main_content", "doc_paragraph_score",
              "doc_top_paragraphs", "doc_main_content", "list_items", "outline_sections", "text_urls",
              "page_links", "search_urls", "cache_keys"}


def plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK - {"page_ingest_stream", "report_catalogue"}))
def test_no_python_and_no_global_window(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", sorted(NO_SHUFFLE))
def test_row_local_operators_do_not_shuffle_by_key(spark, name):
    p = plan(spark, name)
    assert "hashpartitioning" not in p.lower()


def test_scan_reads_only_needed_columns(spark):
    p = plan(spark, "page_links")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p
    p = plan(spark, "cache_keys")
    assert "html" not in p.split("ReadSchema", 1)[1].split("\n", 1)[0]


def test_numbering_and_windows_never_single_partition(spark):
    """A single-partition exchange may only carry rows that a global aggregate has combined in
    every task already, never the rows themselves nor one row per block."""
    for name in ("page_sources", "source_citations", "section_context", "section_drafts", "context_compress", "conv_turns"):
        lines = plan(spark, name).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate(keys=[]" in lines[i + 1], (name, line, lines[i + 1])


def test_relevance_neither_explodes_texts_nor_shuffles_pairs(spark):
    """Keywords meet whole texts; before the top-10 is limited in each task nothing is exchanged."""
    p = plan(spark, "section_context")
    assert "WindowGroupLimit" in p and "Partial" in p
    assert plan(spark, "section_relevance").count("Generate explode") == 1
