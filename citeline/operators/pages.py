"""Page corpus operators: clean text, metadata, main content.

All of them are narrow projections: one page row in, one row out, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.operators.paragraphs import main_content_expr

PARAGRAPH_MIN = 40


def with_clean_text(df: DataFrame, html: str = "html", out: str = "clean_text") -> DataFrame:
    """T2+T3: boilerplate-free single-line text of each page."""
    return df.withColumn(out, tx.clean_text(F.col(html)))


def with_metadata(df: DataFrame, html: str = "html", out: str | None = None) -> DataFrame:
    """Title / description / publish_date, as columns or one struct."""
    h = F.col(html)
    cols = [tx.page_title(h).alias("title"), tx.page_description(h).alias("description"),
            tx.page_publish_date(h).alias("publish_date")]
    if out:
        return df.withColumn(out, F.struct(*cols))
    return df.select("*", *cols)


def main_content_compat(clean: "F.Column", max_chars: int) -> "F.Column":
    """T12 as the reference composes it.

    The cleaner collapses every whitespace run (newlines included) to one
    space, so a cleaned page is always exactly one paragraph: it is kept whole
    when longer than 40 characters and then cut by the budget.
    """
    return F.when(F.length(clean) > PARAGRAPH_MIN, F.left(clean, F.lit(max_chars))).otherwise(F.lit(""))


def with_main_content(df: DataFrame, html: str = "html", out: str = "content",
                      max_chars: int = 15000, mode: str = "compat",
                      clean_col: str | None = None) -> DataFrame:
    """Main content of each page.

    ``mode='compat'`` reproduces the reference exactly (see above).
    ``mode='blocks'`` keeps the page's blocks apart (``block_text``), so
    paragraphs are split, scored, ranked and cut by the budget.
    """
    if mode == "blocks":
        return df.withColumn(out, main_content_expr(tx.block_text(F.col(html)), sep="\n\n", max_chars=max_chars))
    clean = F.col(clean_col) if clean_col else tx.clean_text(F.col(html))
    return df.withColumn(out, main_content_compat(clean, max_chars))


def extract_pages(df: DataFrame, html: str = "html", max_chars: int = 15000) -> DataFrame:
    """T3+T7+T12 in one projection: the extraction step of a fetched page."""
    clean = tx.clean_text(F.col(html))
    h = F.col(html)
    return df.select(
        "*",
        tx.page_title(h).alias("title"),
        tx.page_description(h).alias("description"),
        tx.page_publish_date(h).alias("publish_date"),
        main_content_compat(clean, max_chars).alias("content"),
    )
