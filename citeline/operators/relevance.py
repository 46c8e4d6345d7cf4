"""Section-to-source relevance (C4, A2, C7), context selection
and section assembly (SEC).

Relevance: a section's keywords are its lower-cased title words longer than
three characters (repeats count again); a source scores one point per
keyword occurring anywhere in lower(content || title || description).

A run's outline is short, its sources are many.  So all sections of a run become one row
(titles cut into keywords) that meets each of the run's sources once: the
source's text is tested for the run's distinct keywords and every section that
sees the source is scored from those found.  Nothing is exploded but the
scores above zero; they feed a top-10 that Spark limits in every task
before the shuffle.  The outlines are written and counted.  Few are broadcast, and the distinct words of
a source are looked up in them by the keywords' first characters: the work grows with the text, however
many keywords its run has.  Else both sides shuffle, and AQE splits a run with most sources, as the
outline side has one row per run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeline.functions import text as tx
from citeline.functions.arrays import ordered_values
from citeline.operators.ordering import first_n
from citeline.operators.running import numbered
from citeline.session import written

KEYWORD_MIN = 3        # keywords are strictly longer than this
BROADCAST_WORDS = 1_000_000  # outlines of at most this many words are broadcast; more meet the sources in a shuffle
TOP_SOURCES = 10
SNIPPET = 1000
BUDGET = 3000
FALLBACK_SOURCES = 5
FALLBACK_SNIPPET = 500
# Fixed value: the context used when a section has no usable source.
NO_INFO = "Information non disponible pour cette section."


def keywords(title: str) -> Column:
    """A title's keywords, repeats kept."""
    return F.filter(tx.words(F.lower(F.coalesce(F.col(title), F.lit("")))), lambda w: F.length(w) > KEYWORD_MIN)


def outlines(sections: DataFrame, run: str = "research_id", sec: str = "sec_id", title: str = "title") -> DataFrame:
    """One row per run: ``outline`` (its sections with step and keywords) and the
    distinct ``keywords`` of all of them."""
    section = F.struct(F.col(sec).alias("sec"), F.col("step"), keywords(title).alias("words"))
    return (sections.groupBy(run).agg(F.collect_list(section).alias("outline"))
            .withColumn("keywords", F.array_distinct(F.flatten(F.col("outline.words")))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


WORDS_KEPT = 200_000   # words whose keywords a task remembers
HITS_AT_ONCE = 500_000  # scores that a task puts out in one batch


class _Outline:
    """The sections of a run: keywords by their first characters, and where each of them counts."""

    def __init__(self, outline):
        self.sections = [o["sec"] for o in outline]
        self.steps = np.array([np.iinfo(np.int64).min if o["step"] is None else o["step"] for o in outline], np.int64)
        self.counted = np.array([o["step"] is not None for o in outline], bool)
        places = defaultdict(list)
        for at, o in enumerate(outline):
            for word in o["words"]:
                places[word].append(at)
        self.places = [np.array(p, np.int64) for p in places.values()]
        self.starts = defaultdict(list)
        for number, word in enumerate(places):
            self.starts[word[:KEYWORD_MIN + 1]].append((word, number))
        self.known: dict[str, tuple] = {}

    def inside(self, word: str) -> tuple:
        """Numbers of the keywords that occur in ``word``."""
        found = self.known.get(word)
        if found is None:
            found = tuple({n for i in range(len(word) - KEYWORD_MIN) for k, n in self.starts.get(word[i:i + KEYWORD_MIN + 1], ())
                           if word.startswith(k, i)})
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = found
        return found

    def scores(self, body: str) -> np.ndarray:
        """Score of every section: a keyword has no white space, so it occurs in a text if it occurs in one of its words."""
        present = {n for word in set(body.split()) for n in self.inside(word)}
        if not present:
            return np.zeros(len(self.sections), np.int64)
        return np.bincount(np.concatenate([self.places[n] for n in present]), minlength=len(self.sections))


def _few_outlines(lists: DataFrame, sources: DataFrame, run: str, sec: str, src: str, body: Column, asof: bool) -> DataFrame:
    """(run, src, step, hits) for sources of runs whose outlines fit a broadcast."""
    shared = sources.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in lists.select(run, "outline").collect()})
    rows = sources.where(F.col(run).isNotNull()).select(run, src, "step", body.alias("_body"))
    kind = lists.schema["outline"].dataType.elementType["sec"].dataType
    hit = T.StructType([T.StructField("sec", kind), T.StructField("score", T.LongType())])
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("hits", T.ArrayType(hit))])
    names, sec_type = schema.names, to_arrow_type(kind)

    def emit(batches: Iterator[pa.RecordBatch]):
        opened: dict = {}
        for batch in batches:
            runs, steps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            kept, secs, scores, total = [], [], [], 0

            def out():
                sizes = np.cumsum([0] + [len(x) for x in scores])
                flat = pa.StructArray.from_arrays([pa.array([v for part in secs for v in part], sec_type),
                                                   pa.array(np.concatenate(scores).astype(np.int64))], ["sec", "score"])
                hits = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in range(3)), hits], names)

            for at, (key, step, text) in enumerate(zip(runs, steps, batch.column(3))):
                if key not in shared.value or (asof and step is None):
                    continue
                if key not in opened:
                    opened[key] = _Outline(shared.value[key])
                outline = opened[key]
                found = outline.scores(text.as_py())
                seen = np.flatnonzero((found > 0) & outline.counted & (outline.steps >= step) if asof else found > 0)
                if len(seen):
                    kept.append(at)
                    secs.append([outline.sections[i] for i in seen])
                    scores.append(found[seen])
                    total += len(seen)
                if total >= HITS_AT_ONCE:
                    yield out()
                    kept, secs, scores, total = [], [], [], 0
            if kept:
                yield out()
    return rows.mapInArrow(emit, schema)


def scored_sources(sections: DataFrame, sources: DataFrame, run: str = "research_id", sec: str = "sec_id",
                   src: str = "seq", asof: bool = True) -> DataFrame:
    """(run, sec, src, step, score) of every visible source with a score above
    zero; ``step`` is the source's.  Row by row after the join on the run."""
    found = ["content", "title", "description"]
    body = F.lower(F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in found]))
    seen = F.filter("outline", lambda o: o["step"] >= F.col("step")) if asof else F.col("outline")

    lists = written(outlines(sections, run, sec), "outlines")
    n_words = lists.agg(F.sum(F.size("keywords") + 2 * F.size(F.flatten("outline.words")))).first()[0] or 0
    if n_words <= BROADCAST_WORDS:
        scored = _few_outlines(lists, sources, run, sec, src, body, asof)
    else:
        def scores(present: Column) -> Column:
            def score(o: Column) -> Column:
                return F.size(F.filter(o["words"], lambda w: F.array_contains(present, w))).cast("long")
            return F.filter(F.transform(seen, lambda o: F.struct(o["sec"].alias("sec"), score(o).alias("score"))),
                            lambda x: x["score"] > 0)

        present = _let(body, lambda b: F.filter("keywords", lambda k: F.contains(b, k)))
        scored = sources.select(run, src, "step", *found).join(lists, run).select(run, src, "step", _let(present, scores).alias("hits"))
    hits = scored.select(run, src, "step", F.explode("hits").alias("hit"))
    return hits.select(run, F.col("hit.sec").alias(sec), src, "step", F.col("hit.score").alias("score"))


def section_relevance(sections: DataFrame, sources: DataFrame, run: str = "research_id",
                      sec: str = "sec_id", src: str = "seq", asof: bool = True) -> DataFrame:
    """C4+A2+C7: (run, sec, src, score) for every visible source with score > 0.

    ``sections``: run, sec, step, title.  ``sources``: run, src, step, content,
    title, description.  With ``asof`` a section only sees sources whose
    ``step`` is at most its own (the registry grows while sections are written).
    """
    return scored_sources(sections, sources, run, sec, src, asof).drop("step")


def _block(ci, title, snippet):
    return F.concat(F.lit("["), F.col(ci).cast("string"), F.lit("] "), F.col(title), F.lit("\n"), snippet, F.lit("\n"))


def snippet_of(sources: DataFrame, chars: int, content: str = "content") -> Column:
    """The first ``chars`` characters of the content; without content the
    first entry of ``snippets`` as it is, if there is such a column; else empty."""
    text = F.coalesce(F.col(content), F.lit(""))
    other = F.coalesce(F.try_element_at("snippets", F.lit(1)), F.lit("")) if "snippets" in sources.columns else F.lit("")
    return F.when(text != "", F.left(text, F.lit(chars))).otherwise(other)


def section_context(sections: DataFrame, sources: DataFrame, run: str = "research_id",
                    sec: str = "sec_id", src: str = "seq", asof: bool = True) -> DataFrame:
    """C5+B2+C6: (run, sec, context) for every section.

    Top 10 sources by score (ties: arrival order), snippets of 1000
    characters (see ``snippet_of``); empty snippets use a slot but no budget; blocks are taken
    while the characters taken before stay within 3000 (the crossing block is
    kept).  With nothing selected: the first five visible sources (500
    characters of content, non-empty), else a fixed sentence.

    ``sources`` arrive in order of (``step``, ``src``).  Citation numbers dense per
    run in that order are read from ``citation_index`` if there, else numbered here on the key
    columns.  Texts are read twice: for scoring, and for the few sources that a section may cite.
    """
    by = Window.partitionBy(run, sec).orderBy(F.desc("score"), "step", src)
    top = (scored_sources(sections, sources, run, sec, src, asof).withColumn("_rk", F.row_number().over(by))
           .where(F.col("_rk") <= TOP_SOURCES).select(run, sec, src, "_rk"))
    arrival = sources.select(run, src, "step")
    first = (arrival.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy("step", src)))
             .where(F.col("_k") <= FALLBACK_SOURCES))
    spare = sections.select(run, sec, F.col("step").alias("_at")).join(first, run)
    if asof:
        spare = spare.where(F.col("step") <= F.col("_at"))
    wanted = top.unionByName(spare.select(run, sec, src, (F.col("_k") + TOP_SOURCES).alias("_rk")))

    numbers = (sources.select(run, src, "citation_index") if "citation_index" in sources.columns
               else numbered(arrival, [run], ["step", src], "citation_index").drop("step"))
    text = sources.select(run, src, "title", snippet_of(sources, SNIPPET).alias("_long"),
                          F.left(F.coalesce("content", F.lit("")), F.lit(FALLBACK_SNIPPET)).alias("_short"))
    cited = (wanted.join(numbers, [run, src]).join(text, [run, src])
             .withColumn("_snip", F.when(F.col("_rk") <= TOP_SOURCES, F.col("_long")).otherwise(F.col("_short")))
             .where(F.length("_snip") > 0))
    # ten and five rows a section at most; the budget starts anew for the spare ones, which never reach it
    before = F.coalesce(F.sum(F.when(F.col("_rk") <= TOP_SOURCES, F.length("_snip")).otherwise(F.lit(0))).over(
        Window.partitionBy(run, sec).orderBy("_rk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = cited.withColumn("_before", before).where((F.col("_before") <= BUDGET) | (F.col("_rk") > TOP_SOURCES))
    block = F.struct(F.col("_rk"), _block("citation_index", "title", F.col("_snip")).alias("b"))
    joined = lambda rows: F.array_join(ordered_values(rows, "b"), "\n")
    texts = kept.groupBy(run, sec).agg(
        F.collect_list(F.when(F.col("_rk") <= TOP_SOURCES, block)).alias("_sel"),
        F.collect_list(F.when(F.col("_rk") > TOP_SOURCES, block)).alias("_fb"))
    context = F.when(F.size("_sel") > 0, joined(F.col("_sel"))).when(F.size("_fb") > 0, joined(F.col("_fb")))
    return (sections.select(run, sec).join(texts, [run, sec], "left")
            .select(run, sec, F.coalesce(context, F.lit(NO_INFO)).alias("context")))


def assemble_sections(sections: DataFrame, run: str, order: str, title: str, body: str,
                      max_chars: int | None = None) -> DataFrame:
    """SEC + A3: ``## title\\n\\nbody`` per section, joined by blank lines in
    order; with ``max_chars`` only the leading part is built (every piece
    has at least 5 characters, so at most max_chars // 5 + 1 pieces)."""
    piece = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body))
    d = sections.select(run, order, piece.alias("_p"))
    if max_chars is not None:
        d = first_n(d, [run], [order], max_chars // 5 + 1, block_of=order)
    text = F.array_join(ordered_values(F.collect_list(F.struct(F.col(order), F.col("_p"))), "_p"), "\n\n")
    if max_chars is not None:
        text = F.left(text, F.lit(max_chars))
    return d.groupBy(run).agg(text.alias("sections_text"))
