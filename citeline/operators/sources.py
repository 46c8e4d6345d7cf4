"""Fetch and source registry (S5, S6, U3, C1, C2, C9, SO1).

A research run requests URLs in an order ``(step, seq)``; the corpus of
fetched pages is a table keyed by URL.  Fetching is a join; the registry is
first-seen dedup + join + extraction + dense numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators.ordering import first_seen, number_within
from citeline.operators.pages import extract_pages

ERROR_TEXT = "[ERROR: not in corpus]"
SNIPPET = 1000
CONTENT_MAX = 5000
LIST_TITLE, LIST_DESCRIPTION = 100, 200


def fetch(urls: DataFrame, corpus: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Each distinct requested URL with ``ok`` and its content, or an
    error string where the corpus has no page (the batch never aborts).

    The corpus must be unique on ``url`` (see ``latest_per_key``).  The join
    shuffles only when the request side is too large to broadcast; AQE decides
    from the runtime size."""
    req = urls.select(url).distinct()
    got = corpus.select(F.col(url), F.col(body).alias("_body"))
    return (req.join(got, url, "left")
            .select(url, F.col("_body").isNotNull().alias("ok"),
                    F.coalesce(F.col("_body"), F.lit(ERROR_TEXT)).alias("content")))


def fetch_with_fallback(urls: DataFrame, preferred: DataFrame, plain: DataFrame, url: str = "url",
                        body: str = "html") -> DataFrame:
    """Content from the preferred corpus (rendered), else the plain one,
    with the ``origin`` that served it."""
    req = urls.select(url).distinct()
    a = preferred.select(F.col(url), F.col(body).alias("_a"))
    b = plain.select(F.col(url), F.col(body).alias("_b"))
    j = req.join(a, url, "left").join(b, url, "left")
    return j.select(url,
                    F.when(F.col("_a").isNotNull(), F.lit("preferred"))
                    .when(F.col("_b").isNotNull(), F.lit("plain")).alias("origin"),
                    F.coalesce("_a", "_b", F.lit(ERROR_TEXT)).alias("content"))


def register_sources(requests: DataFrame, corpus: DataFrame, run: str = "research_id",
                     order: tuple[str, str] = ("step", "seq"), url: str = "url", body: str = "html",
                     max_chars: int = CONTENT_MAX) -> DataFrame:
    """U3 + S5 + C1 + C2: the numbered source registry of every run.

    A URL counts once per run, at its first request (marked seen before the
    fetch, so a failed one is not retried); failed fetches are dropped and
    citation numbers are dense over the successful sources in arrival order.
    """
    first = first_seen(requests.select(run, *order, url), [run, url], list(order))
    asked = corpus.select(url, body).join(first.select(url).distinct(), url, "left_semi")
    numbers = number_within(first.join(asked.select(url).distinct(), url, "left_semi"), [run], list(order), "citation_index")
    pages = numbers.join(first_seen(asked, [url], [body]), url)  # a URL twice in the corpus is one source
    ext = extract_pages(pages, body, max_chars).drop(body)
    return ext.withColumn("snippets", F.array(F.left(F.col("content"), F.lit(SNIPPET))))


def source_list(sources: DataFrame, run: str = "research_id") -> DataFrame:
    """The report's source list (index, url, short title, short description)."""
    return sources.select(run, F.col("citation_index").alias("index"), "url",
                          F.left("title", F.lit(LIST_TITLE)).alias("title"),
                          F.left("description", F.lit(LIST_DESCRIPTION)).alias("description"))
