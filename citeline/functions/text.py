"""Column expressions for text cleaning and metadata (JVM built-ins only).

Every pattern here is valid in both java.util.regex (Spark) and RE2 (the
DuckDB oracle).  Python's ``\\s``/``\\d``/``str.strip`` are Unicode-aware,
Java's are ASCII-only, so whitespace and digits are spelled out explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (= Python `\s`).
WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
      "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
NOT_WS = "[^" + WS[1:]
# The same set as single characters (for translate): tab..CR, 0x1c-0x20, NEL,
# NBSP, ogham space, U+2000-U+200A, line/paragraph separators, narrow NBSP,
# medium mathematical space, ideographic space.
WS_CHARS = ("\t\n\x0b\x0c\r" + "".join(map(chr, range(0x1C, 0x21))) + "\x85\xa0\u1680"
            + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
DIGIT = "\\p{Nd}"

# HTML entities decoded by the cleaner, in the order they are applied.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]

# The words that earn a paragraph two relevance points.
SIGNAL_WORDS = ["study", "research", "found", "according", "published", "report"]

# The elements that start and end a block of text.
BLOCK_ELEMENTS = ["address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
                  "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
                  "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
                  "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"]
BLOCK_MARK = "\x01"    # stands for a block edge while white space collapses; not white space itself

TITLE_MAX, DESCRIPTION_MAX, DATE_MAX = 300, 500, 30
UNTITLED = "Untitled"


def java_flags(flags: str) -> str:
    """Inline flags for Java: case-insensitive matching must also be Unicode."""
    return "(?" + flags + ("u" if "i" in flags else "") + ")"


def re2_flags(flags: str) -> str:
    return "(?" + flags + ")"


def patterns(flavor: str = "java") -> dict[str, str]:
    """All regexes, rendered for Java (Spark) or RE2 (DuckDB oracle)."""
    f = java_flags if flavor == "java" else re2_flags
    q = "[\"']"
    return {
        "style": f("is") + WS + "*<style[^>]*>.*?</style>" + WS + "*",
        "script": f("is") + WS + "*<script[^>]*>.*?</script>" + WS + "*",
        "tag": "<[^>]+>",
        "comment": f("s") + "<!--.*?-->",
        "block_tag": f("i") + "</?(?:" + "|".join(BLOCK_ELEMENTS) + ")(?:" + WS[:-1] + "/][^>]*)?>",
        "block_edge": " ?\\x01[ \\x01]*",
        "numeric_entity": "&#" + DIGIT + "+;",
        "ws_run": WS + "+",
        "title": f("is") + "<title[^>]*>(.*?)</title>",
        "desc_name_first": f("i") + "<meta[^>]+name=" + q + "description" + q
        + "[^>]+content=" + q + "([^\"']+)" + q,
        "desc_content_first": f("i") + "<meta[^>]+content=" + q + "([^\"']+)" + q
        + "[^>]+name=" + q + "description" + q,
        "date": f("i") + "<meta[^>]+(?:property|name)=" + q + "(?:article:published_time|date)" + q
        + WS + "+content=" + q + "([^\"']+)" + q,
        "four_digits": DIGIT + "{4}",
        "signal": f("i") + "(" + "|".join(SIGNAL_WORDS) + ")",
        "word": NOT_WS + "+",
        "edge_ws": "^" + WS + "+|" + WS + "+$",
        "url": "https?://[^" + WS[1:-1] + ")\\]\"]+",
    }


P = patterns("java")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, P["edge_ws"], "")


def unescape(c: Column) -> Column:
    """The five entities of the cleaner decoded, ``&amp;`` last, so that nothing is
    decoded twice; ``&nbsp;`` gives a no-break space and ``&#39;`` an apostrophe."""
    for ent, ch in [("&nbsp;", "\u00a0"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    """Every tag becomes one space."""
    return F.regexp_replace(c, P["tag"], " ")


def _decoded(t: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    t = strip_tags(t)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.regexp_replace(t, P["numeric_entity"], " ")
    return F.regexp_replace(t, P["ws_run"], " ")


def block_text(c: Column) -> Column:
    """Page text with a blank line between blocks.

    As T3, but comments go whole, and block tags leave a mark before white
    space collapses, so what stood in different blocks stays apart.  Tags inside
    scripts, styles and comments mark nothing."""
    t = F.translate(c, BLOCK_MARK, " ")
    for name in ("comment", "style", "script"):
        t = F.regexp_replace(t, P[name], " ")
    t = _decoded(F.regexp_replace(t, P["block_tag"], BLOCK_MARK))
    t = F.regexp_replace(t, P["block_edge"], "\n\n")
    return F.trim(t, F.lit(" \n"))


def clean_text(c: Column) -> Column:
    """style/script removal, tag strip, entity decode, whitespace collapse.

    Collapsing *all* whitespace leaves a single line, so the final per-line
    strip and blank-line join reduce to trimming the (single) edge spaces.
    """
    t = F.regexp_replace(c, P["style"], " ")
    t = F.regexp_replace(t, P["script"], " ")
    return F.trim(_decoded(t))


def page_title(html: Column) -> Column:
    """T4: first <title> content, cleaned, cut to 300; empty -> 'Untitled'."""
    t = F.left(clean_text(F.regexp_extract(html, P["title"], 1)), F.lit(TITLE_MAX))
    return F.when(t == "", F.lit(UNTITLED)).otherwise(t)


def page_description(html: Column) -> Column:
    """T5: meta description, name-before-content first; not entity-decoded."""
    a = F.regexp_extract(html, P["desc_name_first"], 1)
    b = F.regexp_extract(html, P["desc_content_first"], 1)
    return F.left(F.when(a != "", a).otherwise(b), F.lit(DESCRIPTION_MAX))


def page_publish_date(html: Column) -> Column:
    """Article:published_time / date meta directly followed by content."""
    return F.left(F.regexp_extract(html, P["date"], 1), F.lit(DATE_MAX))


def words(c: Column) -> Column:
    """``s.split()``: whitespace-separated words.  Every whitespace character
    becomes a plain space (``translate``), then a one-character split (Java's
    fast path, no regex) and empty pieces are dropped."""
    spaced = F.translate(c, WS_CHARS, " " * len(WS_CHARS))
    return F.array_remove(F.split(spaced, " ", -1), "")


def word_count(c: Column) -> Column:
    """``len(s.split())`` with Unicode whitespace."""
    return F.size(words(c))


def cache_key(url: Column) -> Column:
    """First 16 hex characters of sha256(utf-8 url)."""
    return F.substring(F.sha2(url, 256), 1, 16)
