"""DataFrame -> DataFrame operators, one module per family.

pages       T2-T7, T12   cleaning, metadata, main content of HTML pages
paragraphs  T8-T10, B1   paragraph split, score, top-30, budget
context     B3, C3, DD1  context compressor, result blocks, deep dive
dialogue    D1-D4, L6    turns, stop phrases, history, findings
parse       L2-L5        persona / query / sub-topic lists, outlines
urls        U1, U2, S7, S8  URL extraction, request planning, links, search URLs
sources     S5, S6, U3, C1, C2, C9  fetch, fallback, source registry, source list
relevance   C4-C7, A2, SEC  containment join, as-of, context selection, sections
ordering    C2 helpers   block-wise numbering, first-seen, bounded first-n
cache       S2-S4        TTL cache (gap segments; bucket composition), last write wins
reports     A1, RPT, S9-S12  run stats, report records, report store and catalogue
prompts     L1, C13, L7  prompt rendering, prompt budgets, response status
tree        A4           knowledge-tree rollup
"""
