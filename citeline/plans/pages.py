"""Queries over the page corpus: cleaning, metadata, main content, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.operators import pages as pg
from citeline.operators import paragraphs as para
from citeline.operators.ordering import number_within
from citeline.plans import sqltext as sq
from citeline.plans.registry import query
from citeline.sources.tables import read_table, spread

SOURCE_CONTENT_MAX = 5000   # the researcher extracts page content with this budget
BLOCKS_MAX = 1500           # a budget that most pages exceed


def site_col(url: str = "url"):
    return F.regexp_extract(F.col(url), sq.SITE_RE, 1)


def load_pages(spark, base, *cols):
    return spread(read_table(spark, base, "pages", *(cols or ("page_id", "url", "html"))))


@query("page_clean_text", f"""
SELECT page_id, {sq.clean('html')} AS clean_text FROM pages
""")
def page_clean_text(spark, base):
    return pg.with_clean_text(load_pages(spark, base, "page_id", "html")).drop("html")


@query("page_metadata", f"""
SELECT page_id, {sq.title('html')} AS title, {sq.description('html')} AS description,
       {sq.publish_date('html')} AS publish_date FROM pages
""")
def page_metadata(spark, base):
    return pg.with_metadata(load_pages(spark, base, "page_id", "html")).drop("html")


@query("page_main_content", f"""
SELECT page_id, {sq.main_compat(sq.clean('html'), SOURCE_CONTENT_MAX)} AS content FROM pages
""")
def page_main_content(spark, base):
    return (pg.with_main_content(load_pages(spark, base, "page_id", "html"), max_chars=SOURCE_CONTENT_MAX)
            .drop("html"))


SQL_BLOCKS = f"""
WITH kept AS ({sq.paragraphs_cte("(SELECT page_id, " + sq.blocks("html") + " AS t FROM pages)", "page_id", "t", sq.NL + " || " + sq.NL)}),
ranked AS (SELECT page_id, pos, p, {sq.score('p')} AS score,
                  row_number() OVER (PARTITION BY page_id ORDER BY {sq.score('p')} DESC, pos) AS rnk FROM kept),
top AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY page_id ORDER BY rnk
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM ranked WHERE rnk <= 30)
SELECT page_id, rnk::BIGINT AS rank, pos::BIGINT AS pos, score::BIGINT AS score,
       left(p, ({BLOCKS_MAX} - before)::BIGINT) AS piece
FROM top WHERE before <= {BLOCKS_MAX}"""


@query("page_blocks_top", SQL_BLOCKS)
def page_blocks_top(spark, base):
    """T12 by blocks: T8+T9+T10+B1 on the page's blocks of text."""
    blocks = load_pages(spark, base, "page_id", "html").select("page_id", tx.block_text(F.col("html")).alias("blocks"))
    out = para.top_paragraphs(blocks, "page_id", "blocks", "\n\n", BLOCKS_MAX)
    return out.select("page_id", *[F.col(c).cast("long") for c in ("rank", "pos", "score")], "piece")


@query("page_blocks_content", f"""
WITH pieces AS ({SQL_BLOCKS})
SELECT p.page_id, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY rank), '') AS content
FROM pages p LEFT JOIN pieces USING (page_id) GROUP BY p.page_id""")
def page_blocks_content(spark, base):
    """T12 by blocks: the page's main content as one text."""
    pages = load_pages(spark, base, "page_id", "html")
    return pg.with_main_content(pages, max_chars=BLOCKS_MAX, mode="blocks").drop("html")


@query("page_sources", f"""
SELECT {sq.site('url')} AS research_id,
       (row_number() OVER (PARTITION BY {sq.site('url')} ORDER BY page_id))::BIGINT AS citation_index,
       page_id, url, {sq.title('html')} AS title, {sq.description('html')} AS description,
       {sq.publish_date('html')} AS publish_date,
       {sq.main_compat(sq.clean('html'), SOURCE_CONTENT_MAX)} AS content
FROM pages
""")
def page_sources(spark, base):
    """Flagship: numbered, cleaned source list per site."""
    x = (pg.extract_pages(load_pages(spark, base), max_chars=SOURCE_CONTENT_MAX)
         .withColumn("research_id", site_col()).drop("html"))
    return number_within(x, ["research_id"], ["page_id"], "citation_index", block_of="page_id").select(
        "research_id", "citation_index", "page_id", "url", "title", "description", "publish_date", "content")


@query("cache_keys", """
SELECT page_id, url, left(sha256(url), 16) AS cache_key FROM pages
""")
def cache_keys(spark, base):
    """Cache key of every page URL."""
    return read_table(spark, base, "pages", "page_id", "url").withColumn("cache_key", tx.cache_key(F.col("url")))


def tagged_html():
    """Each page with a description meta tag (content before name, value = its
    URL) and a date meta tag (month from its id) in front of its HTML."""
    month = F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0")
    return F.concat(F.lit('<meta content="'), F.col("url"), F.lit('" name="description">'),
                    F.lit('<meta name="date" content="2024-'), month, F.lit('-01T00:00:00Z">'), F.col("html"))


SQL_TAGGED = ("'<meta content=\"' || url || '\" name=\"description\">' || '<meta name=\"date\" content=\"2024-' "
              "|| lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-01T00:00:00Z\">' || html")


@query("page_metadata_tagged", f"""
SELECT page_id, {sq.title('h')} AS title, {sq.description('h')} AS description,
       {sq.publish_date('h')} AS publish_date
FROM (SELECT page_id, {SQL_TAGGED} AS h FROM pages)""")
def page_metadata_tagged(spark, base):
    """T4-T7 on pages carrying description and date meta tags."""
    p = load_pages(spark, base, "page_id", "url", "html").select("page_id", tagged_html().alias("html"))
    return pg.with_metadata(p).drop("html")
