"""Context assembly for the text generator: result formatting (C3) and the
context compressor (B3), both under character budgets.

Each run's context is bounded, so only a bounded prefix of a run's sources
is ever gathered into one row, however many sources the run has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.arrays import budget_exclude, ordered_values
from citeline.operators.ordering import number_within
from citeline.operators.relevance import snippet_of
from citeline.operators.running import running_totals
from citeline.session import written

COMPRESS_MAX = 8000
COMPRESS_SNIPPET = 1500
RESULTS_SHOWN = 5
RESULT_SNIPPET = 500
NL = "\n"


def source_block(ci: str, title: str, snippet) -> "F.Column":
    """``[n] title\\nsnippet\\n\\n`` (one compressor block)."""
    return F.concat(F.lit("["), F.col(ci).cast("string"), F.lit("] "), F.col(title), F.lit(NL),
                    snippet, F.lit(NL + NL))


def compress_context(sources: DataFrame, run: str = "research_id", ci: str = "citation_index",
                     title: str = "title", content: str = "content",
                     max_chars: int = COMPRESS_MAX, snippet_chars: int = COMPRESS_SNIPPET,
                     key: str = "seq") -> DataFrame:
    """One context string per run.

    Blocks of sources with a snippet (the content's first characters, else the first of
    ``snippets``) are concatenated in citation order.  A context of at most ``max_chars`` characters is returned whole;
    a longer one keeps whole lines while the running total of line lengths
    (newlines not counted) stays within ``max_chars``.

    Running totals over the blocks' lengths (line characters, and all) choose the
    blocks of which any line can survive; only their texts are read and gathered.
    Sources without ``ci`` are numbered here by ``key``.
    """
    if key not in sources.columns:      # numbered sources: the number is the key
        key = ci
    heading = F.coalesce(F.col(title), F.lit(""))
    snippet = snippet_of(sources, snippet_chars, content)
    ids = list(dict.fromkeys([run, key, *([ci] if ci in sources.columns else [])]))
    lens = sources.select(*ids, (F.length(heading) + F.length(snippet)).alias("_chars"), F.length(snippet).alias("_snip"),
                          F.regexp_count(F.concat(heading, snippet), F.lit(NL)).alias("_breaks"))
    if ci not in sources.columns:
        lens = number_within(lens, [run], [key], ci, block_of=key)
    whole = F.length(F.col(ci).cast("string")) + F.lit(len("[] " + NL + NL + NL)) + F.col("_chars")
    blocks = lens.where(F.col("_snip") > 0).select(
        *dict.fromkeys([run, key, ci]), whole.alias("_whole"), (whole - F.lit(3) - F.col("_breaks")).alias("_line"))
    placed = written(running_totals(blocks, [run], [ci], {"_all": "_whole", "_upto": "_line"}), "blocks")
    totals = placed.groupBy(run).agg(F.max("_all").alias("total_chars"))
    head = placed.where(F.col("_upto") - F.col("_line") <= max_chars).select(*dict.fromkeys([run, key, ci]))
    text = sources.select(*dict.fromkeys([run, key]), heading.alias("_title"), snippet.alias("_snippet"))
    found = head.join(text, list(dict.fromkeys([run, key]))).select(run, ci, source_block(ci, "_title", F.col("_snippet")).alias("block"))
    gathered = found.groupBy(run).agg(
        F.array_join(ordered_values(F.collect_list(F.struct(F.col(ci), F.col("block"))), "block"), "")
        .alias("text"))
    lines = F.split(F.col("text"), NL, -1)
    return (gathered.join(totals, run)
            .select(run, F.when(F.col("total_chars") <= max_chars, F.col("text"))
                    .otherwise(F.array_join(budget_exclude(lines, max_chars), NL)).alias("context")))


def format_results(results: DataFrame, group: list[str], order: list[str], title: str = "title",
                   url: str = "url", snippet: str = "snippet", shown: int = RESULTS_SHOWN,
                   snippet_chars: int = RESULT_SNIPPET, citation: str | None = None) -> DataFrame:
    """The first ``shown`` results of each group, numbered locally 1..n:
    ``[i] title\\nURL: url\\nsnippet[:500]\\n`` joined by newlines.

    The local ``[i]`` is not the report's citation number; with ``citation``
    (the results' citation-number column) a ``citations`` array maps each
    local number to it."""
    w = Window.partitionBy(*group).orderBy(*order)
    top = results.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= shown)
    part = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), F.col(title), F.lit(NL + "URL: "),
                    F.col(url), F.lit(NL), F.left(F.coalesce(F.col(snippet), F.lit("")), F.lit(snippet_chars)),
                    F.lit(NL))
    aggs = [F.array_join(ordered_values(F.collect_list(F.struct(F.col("_i"), part.alias("p"))), "p"), NL)
            .alias("results_text")]
    if citation:
        aggs.append(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("local"),
                                                         F.col(citation).alias("citation_index"))))
                    .alias("citations"))
    return top.groupBy(*group).agg(*aggs)


# Fixed value: title prefix of a deep-dive section.
DIVE_PREFIX = "Exploration approfondie: "
DIVE_TOPICS = 3


def deep_dive(subtopic_text: "DataFrame", results: DataFrame, run: str = "research_id") -> DataFrame:
    """DD1: one level of deep dive.

    ``subtopic_text`` (run, text): the generator's sub-topic list, parsed by
    the L4 rule (first three); ``results`` (run, sub_no, seq, title, url,
    snippet): sources found for each sub-topic.  Returns (run, sub_no,
    subtopic, section_title, info) where ``info`` is the result block (C3)
    handed to the section writer."""
    from citeline.operators.parse import subtopic_items

    subs = subtopic_text.select(run, F.posexplode(F.slice(subtopic_items(F.col("text")), 1, DIVE_TOPICS))
                                .alias("sub_no", "subtopic"))
    info = format_results(results, [run, "sub_no"], ["seq"])
    return (subs.join(info, [run, "sub_no"], "left")
            .select(run, F.col("sub_no").cast("long").alias("sub_no"), "subtopic",
                    F.concat(F.lit(DIVE_PREFIX), F.col("subtopic")).alias("section_title"),
                    F.coalesce("results_text", F.lit("")).alias("info")))
