"""A whole research run as table-to-table Spark jobs, for many runs at once.

The reference turns one question into one report by calling a generator and
fetching pages in a loop.  Here the generator's answers are tables and the
pages are a corpus; every step is one of the operators, keyed by
``research_id``:

* ``persona_text``  (research_id, text)                      -> L2 personas
* ``turns``         (research_id, persona_no, turn_no, question, answer)
                                                              -> D3/D4 findings
* ``search_text``   (research_id, step, turn_no, query_no, text)
                    step 0 = interviews, step i = section i's search
                                                              -> U1/U2/SO1 requests
* ``outline_text``  (research_id, text)                      -> L5 sections
* ``corpus``        (url, html)                              -> S5/C1/C2 sources

Section ``i`` has step ``i``, so it sees the interview sources and the
sources found by sections 1..i (C7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.operators import dialogue as dl
from citeline.operators import parse as ps
from citeline.operators import relevance as rv
from citeline.operators import reports as rp
from citeline.operators import sources as so
from citeline.operators import urls as ur

RUN = "research_id"
URLS_PER_INTERVIEW_QUERY, URLS_PER_SECTION_QUERY = 3, 2


def research_tables(persona_text: DataFrame, turns: DataFrame, search_text: DataFrame,
                    outline_text: DataFrame, corpus: DataFrame, questions: DataFrame,
                    generated_at: str = "1970-01-01T00:00:00Z") -> dict[str, DataFrame]:
    personas = persona_text.select(RUN, F.posexplode(ps.persona_items(F.col("text"))).alias("persona_no", "persona"))
    found = dl.findings(turns, [RUN, "persona_no", "turn_no"])
    interview = ur.plan_requests(search_text.where(F.col("step") == 0), cap=URLS_PER_INTERVIEW_QUERY)
    section_search = ur.plan_requests(search_text.where(F.col("step") > 0), cap=URLS_PER_SECTION_QUERY)
    sources = so.register_sources(interview.unionByName(section_search), corpus)
    sections = (ps.outline_sections(outline_text, [RUN], "text")
                .select(RUN, F.col("sec_no").alias("sec_id"), F.col("sec_no").alias("step"), "level", "title"))
    # the citation number is unique per run; a step's request numbers are not
    registry = sources.select(RUN, F.col("citation_index").cast("long").alias("seq"), "step", "citation_index",
                              "title", "description", "content", "snippets")
    relevance = rv.section_relevance(sections, registry)
    context = rv.section_context(sections, registry)
    stats = rp.run_stats(questions.select(RUN), RUN, personas=personas, dialogues=personas,
                         sections=sections, total_sources=sources, total_findings=found)
    summary = dl.first_findings(found, RUN, ["persona_no", "turn_no", "pos"], 10, "report")
    reports = rp.report_records(stats, questions.select(RUN, "question"), summary, generated_at=generated_at)
    return {"personas": personas, "findings": found, "sources": sources, "source_list": so.source_list(sources),
            "sections": sections, "relevance": relevance, "context": context, "stats": stats,
            "reports": reports}
