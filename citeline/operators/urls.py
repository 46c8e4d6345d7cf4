"""URL operators: extraction from text (U1), per-query cap (U2), search-URL
templating (S8) and link extraction from result pages (S7).  All narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.functions import text as tx

URL_TRAIL = "[.,;:]+$"
# A tag's inside: quoted values may hold '>' and quotes of the other kind.
_INSIDE = "(?:\"[^\"]*\"|'[^']*'|[^'\">])*"
ANCHOR = tx.java_flags("is") + "<a(?:" + tx.WS + _INSIDE + ")?>.*?</a>"
OPEN_TAG = tx.java_flags("is") + "^<a(?:" + tx.WS + _INSIDE + ")?>"
INNER = tx.java_flags("is") + "^<a(?:" + tx.WS + _INSIDE + ")?>(.*)</a>$"
# One attribute after another, values in either quote or bare; a name is taken whole, so data-href is not href.
ATTRIBUTE = ("[^=/\"'<>" + tx.WS[1:-1] + "]+(?:" + tx.WS + "*=" + tx.WS + "*(?:\"[^\"]*\"|'[^']*'|[^\"'>" + tx.WS[1:-1] + "]+))?")
# The search page address, its result-link class and the count read.
SEARCH_BASE = "https://html.duckduckgo.com/html/?q="
RESULT_CLASS = "result__a"
RESULTS = 5


def extract_urls(text: Column, cap: int | None = None) -> Column:
    """U1 (+U2): http(s) URLs in order, trailing ``.,;:`` removed; first ``cap``."""
    urls = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tx.P["url"]), 0),
                       lambda u: F.regexp_replace(u, URL_TRAIL, ""))
    return F.slice(urls, 1, cap) if cap else urls


def search_url(query: Column, base: str = SEARCH_BASE) -> Column:
    """Base URL + query with spaces replaced by '+' (no other encoding)."""
    return F.concat(F.lit(base), F.replace(query, F.lit(" "), F.lit("+")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an opening tag's first attribute ``name``, entities decoded; empty
    if it has none."""
    inside = F.regexp_replace(tag, "^<[^" + tx.WS[1:-1] + "/>]*|/?>$", "")
    own = F.filter(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 0),
                   lambda x: F.lower(F.regexp_extract(x, "^[^=" + tx.WS[1:-1] + "]+", 0)) == name)
    value = F.regexp_replace(F.try_element_at(own, F.lit(1)), "^[^=]*(?:=" + tx.WS + "*|$)", "")
    bare = F.regexp_replace(value, "^\"([^\"]*)\"$|^'([^']*)'$", "$1$2")
    return tx.py_strip(F.coalesce(tx.unescape(bare), F.lit("")))


def link_text(anchor: Column) -> Column:
    """Text of an element with every text fragment stripped, joined without
    separator (``get_text(strip=True)``)."""
    frags = F.split(F.regexp_extract(anchor, INNER, 1), "<[^>]*>", -1)
    return F.array_join(F.filter(F.transform(frags, lambda f: tx.py_strip(tx.unescape(f))), lambda s: s != ""), "")


def extract_links(df: DataFrame, html: str, keys: list[str], n: int = RESULTS,
                  css_class: str | None = RESULT_CLASS, require_http: bool = True) -> DataFrame:
    """The first ``n`` links (of class ``css_class``) of each page, then
    only those whose href starts with 'http' (the limit comes first).  Row by row on the JVM;
    ``select_links`` takes the class on elements of any name."""
    found = F.transform(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 0),
                        lambda a: F.struct(a.alias("a"), F.regexp_extract(a, OPEN_TAG, 0).alias("tag")))
    if css_class:
        found = F.filter(found, lambda x: F.array_contains(F.split(attribute(x["tag"], "class"), tx.WS + "+"), css_class))
    links = F.transform(F.slice(found, 1, n), lambda x: F.struct(
        attribute(x["tag"], "href").alias("url"), link_text(x["a"]).alias("title")))
    out = (df.select(*keys, F.posexplode(links).alias("pos", "l"))
           .select(*keys, F.col("pos").cast("long").alias("pos"), "l.url", "l.title",
                   (F.col("l.url").startswith("http")).alias("is_http")))
    return out.where(F.col("is_http")) if require_http else out


SEARCHED_QUERIES = 2      # only the first two queries of a turn are searched


def plan_requests(responses: DataFrame, run: str = "research_id", step: str = "step",
                  turn: str = "turn_no", query_no: str = "query_no", text: str = "text",
                  cap: int = 3, searched: int = SEARCHED_QUERIES) -> DataFrame:
    """SO1 + U2: URL requests in arrival order from search responses.

    ``responses``: one row per query (run, step, turn, query number from 0,
    response text).  Queries past the first ``searched`` of a turn are not
    searched; each response contributes its first ``cap`` URLs (the cap comes
    before any dedup).  ``seq`` = (turn * searched + query) * cap + position
    is exact and increasing because query < searched and position < cap —
    a narrow projection plus ``posexplode``.  Where several personas are
    interviewed in one step, a ``persona_no`` column orders them first (turn
    numbers of 32 bits).  ``seq`` is unique within a step, not across steps.
    """
    kept = responses.where(F.col(query_no) < searched)
    order = F.col(turn).cast("long")
    if "persona_no" in responses.columns:
        order = F.coalesce(F.col("persona_no").cast("long"), F.lit(0)) * (1 << 32) + order
    urls = kept.select(run, step, order.alias("_order"), query_no,
                       F.posexplode(extract_urls(F.col(text), cap)).alias("_pos", "url"))
    seq = (F.col("_order") * searched + F.col(query_no)) * cap + F.col("_pos")
    return urls.select(run, step, seq.alias("seq"), "url")
