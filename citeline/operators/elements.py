"""Links on elements of any name (S7), by tag balance.

Pages that do not hold the class name at all are filtered on the JVM; the
others are tokenized in Arrow batches by the standard library's HTML tokenizer,
which knows quoting, bare values and entities.  A selected element's text
reaches to its own closing tag, whatever is nested in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.operators.urls import RESULT_CLASS, RESULTS

# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Selected(HTMLParser):
    """Elements of one class in document order: ``[href, text pieces]``."""

    def __init__(self, css_class: str):
        super().__init__(convert_charrefs=True)
        self.css_class, self.open, self.found = css_class, [], []

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))              # the first of repeated attributes counts
        chosen = None
        if self.css_class in (values.get("class") or "").split():
            chosen = [values.get("href") or "", []]
            self.found.append(chosen)
        if tag not in VOID:
            self.open.append((tag, chosen))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):     # unclosed inner elements end with the outer one
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if (piece := data.strip()) and not any(t in ("script", "style") for t, _ in self.open[-1:]):
            for _, chosen in self.open:
                if chosen:
                    chosen[1].append(piece)


def select_links(df: DataFrame, html: str, keys: list[str], n: int = RESULTS, css_class: str = RESULT_CLASS,
                 require_http: bool = True) -> DataFrame:
    """(keys, pos, url, title): the first ``n`` elements of ``css_class`` on each page, then
    only those whose href starts with 'http' (the limit comes first).

    Text pieces are stripped and joined without separator.  Null pages have no
    links; an element without href has an empty one."""
    def links(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, pos, urls, titles = [], [], [], []
            for i, page in enumerate(batch.column(html).to_pylist()):
                parser = _Selected(css_class)
                parser.feed(page)
                parser.close()
                for k, (href, pieces) in enumerate(parser.found[:n]):
                    rows.append(i)
                    pos.append(k)
                    urls.append(href)
                    titles.append("".join(pieces))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int64()), pa.array(urls, pa.string()),
                                              pa.array(titles, pa.string())], [*keys, "pos", "url", "title"])

    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("pos", T.LongType()),
                           T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])
    found = df.select(*keys, html).where(F.contains(html, F.lit(css_class))).mapInArrow(links, schema)
    return found.where(F.startswith("url", F.lit("http"))) if require_http else found
