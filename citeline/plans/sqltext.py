"""SQL spellings of the text operators, for the DuckDB oracle.

Built from the same pattern constants as the Spark side (RE2 flavour), but
written as plain SQL: window functions and ``unnest`` instead of the array
expressions the Spark operators use.
"""

from __future__ import annotations

from citeline.functions.text import DATE_MAX, DESCRIPTION_MAX, ENTITIES, TITLE_MAX, UNTITLED, patterns

R = patterns("re2")
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    t = f"regexp_replace({x}, {lit(R['style'])}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(R['script'])}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(R['tag'])}, ' ', 'g')"
    for ent, ch in ENTITIES:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    t = f"regexp_replace({t}, {lit(R['numeric_entity'])}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(R['ws_run'])}, ' ', 'g')"
    return f"trim({t})"


def blocks(x: str) -> str:
    t = f"translate({x}, chr(1), ' ')"
    for name in ("comment", "style", "script"):
        t = f"regexp_replace({t}, {lit(R[name])}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(R['block_tag'])}, chr(1), 'g')"
    t = f"regexp_replace({t}, {lit(R['tag'])}, ' ', 'g')"
    for ent, ch in ENTITIES:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    t = f"regexp_replace({t}, {lit(R['numeric_entity'])}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(R['ws_run'])}, ' ', 'g')"
    return f"trim(regexp_replace({t}, {lit(R['block_edge'])}, chr(10) || chr(10), 'g'), ' ' || chr(10))"


def title(h: str) -> str:
    inner = f"regexp_extract({h}, {lit(R['title'])}, 1)"
    t = f"left({clean(inner)}, {TITLE_MAX})"
    return f"(CASE WHEN {t} = '' THEN {lit(UNTITLED)} ELSE {t} END)"


def description(h: str) -> str:
    a = f"regexp_extract({h}, {lit(R['desc_name_first'])}, 1)"
    b = f"regexp_extract({h}, {lit(R['desc_content_first'])}, 1)"
    return f"left(CASE WHEN {a} <> '' THEN {a} ELSE {b} END, {DESCRIPTION_MAX})"


def publish_date(h: str) -> str:
    return f"left(regexp_extract({h}, {lit(R['date'])}, 1), {DATE_MAX})"


def main_compat(clean_expr: str, max_chars: int) -> str:
    return f"(CASE WHEN length({clean_expr}) > 40 THEN left({clean_expr}, {max_chars}) ELSE '' END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(R['edge_ws'])}, '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(R['word'])}))"


def score(p: str) -> str:
    return (f"((CASE WHEN regexp_matches({p}, {lit(R['four_digits'])}) THEN 1 ELSE 0 END)"
            f" + (CASE WHEN length({p}) > 200 THEN 1 ELSE 0 END)"
            f" + (CASE WHEN regexp_matches({p}, {lit(R['signal'])}) THEN 2 ELSE 0 END)"
            f" + (CASE WHEN {words(p)} > 30 THEN 1 ELSE 0 END))")


def site(url: str) -> str:
    return f"regexp_extract({url}, {lit(SITE_RE)}, 1)"


# The site (scheme-less authority) of a URL; the same pattern is used by Spark.
SITE_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def paragraphs_cte(table: str, key: str, text: str, sep_sql: str) -> str:
    """(key, pos, p) for every paragraph longer than 40 characters."""
    return (f"SELECT {key}, pos, p FROM (SELECT {key}, unnest(string_split(coalesce({text}, ''), {sep_sql})) AS p,"
            f" generate_subscripts(string_split(coalesce({text}, ''), {sep_sql}), 1) - 1 AS pos FROM {table})"
            f" WHERE length(p) > 40")
