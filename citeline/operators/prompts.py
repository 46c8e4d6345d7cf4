"""Prompt rendering (L1), prompt budgets (C13) and response status.

Prompts are data: a template and parameter columns give a ``prompts``
table; generator answers come back as a ``responses`` table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prompt templates, verbatim (placeholders in braces).
TEMPLATES = {
    "gen_personas": """Tu es un chercheur qui prepare un article Wikipedia-like sur le sujet suivant.

Trouve des pages Wikipedia sur des sujets proches. Pour chaque sujet connexe, definis UNE perspective (persona) d'expert qui pourrait contribuer a l'article.

SUJET : {topic}

Format (une ligne par expert) :
1. Expert en [domaine]: Se concentre sur [aspect specifique]
2. Expert en [domaine]: Se concentre sur [aspect specifique]
...""",
    "journalist_ask": """Tu es un journaliste scientifique chevronne. Tu interviewes un expert pour obtenir des informations precises sur le sujet.

SUJET : {topic}
TA PERSPECTIVE : {persona}
HISTORIQUE DE LA CONVERSATION :
{history}

Pose une nouvelle question pertinente, non posee precedemment. Quand tu n'as plus de questions, reponds : "Merci beaucoup pour votre aide !"
Question :""",
    "question_to_queries": """Tu cherches a repondre a la question suivante en utilisant une recherche web.

SUJET : {topic}
QUESTION : {question}

Genere 2-3 requetes de recherche precises pour trouver les meilleures informations. Format :
- requete 1
- requete 2
- requete 3""",
    "expert_answer": """Tu es un expert. Utilise les informations collectees pour repondre a la question.

SUJET : {topic}
QUESTION : {question}
INFORMATIONS COLLECTEES :
{info}

Reponds de maniere factuelle, en citant chaque source avec [1], [2] etc. Si l'information est insuffisante, dis-le clairement.
Ne mentionne pas les numeros de source dans le texte si tu n'as pas d'information correspondante.
Reponse :""",
    "draft_outline": """Genere le plan d'un rapport academique sur le sujet suivant.

SUJET : {topic}

Format :
# Titre de section
## Titre de sous-section
...

Genere un plan complet et structure. Ne mets pas le titre du sujet lui-meme dans le plan.""",
    "refine_outline": """Ameliore le plan d'un rapport academique en utilisant les informations collectees.

SUJET : {topic}
INFORMATIONS COLLECTEES (resume) :
{info}
PLAN ACTUEL :
{outline}

Genere un plan ameliore et plus complet. Format identique (markdown avec # et ##).""",
    "write_section": """Redige une section de rapport academique.

SUJET : {topic}
SECTION A REDIGER : {section}
INFORMATIONS PERTINENTES :
{info}

Redige la section en utilisant des citations inline [1], [2] etc.
Sois rigoureux, precis, et accessible. Explique les termes techniques.
Utilise le format markdown pour la structure (## sous-titres, **gras**, listes).
N'invente pas d'informations. Si les sources sont insuffisantes, indique-le.
Section :""",
    "synthesize_report": """Synthetise un rapport de recherche complet et structure.

SUJET : {question}
PLAN DU RAPPORT :
{outline}
CONTENU DES SECTIONS :
{sections}

Genere le rapport final en markdown avec :
1. RESUME EXECUTIF (4-5 phrases, pour le grand public)
2. Corps du rapport (toutes les sections)
3. CONCLUSION ET PERSPECTIVES
4. SOURCES (liste des URLs avec descriptions)

Le rapport doit etre :
- Academique mais accessible (expliquer les termes techniques)
- Factuel et source (chaque affirmation doit etre etayee)
- Structure avec titres, sous-titres, et transitions
- Adapte a l'export PDF (pas de contenu dynamique, pas d'emoji)

Utilise le format markdown complet.""",
    "expand_subtopics": """A partir des decouvertes suivantes sur le sujet "{topic}", identifie les sous-themes qui meritent d'etre approfondis.

DECOUVERTES :
{findings}

Genere 2-3 sous-questions precises, une par ligne. Chaque question doit explorer un angle complementaire.""",
    "search_urls": "Cherche sur le web et donne-moi {num_urls} URLs de sources fiables pour repondre a : {query}. "
                   "Retourne UNIQUEMENT les URLs, une par ligne, format: - https://...",
}

# Character budgets applied to prompt parameters.
BUDGETS = {
    ("journalist_ask", "history"): -2000,      # last 2000 characters
    ("expert_answer", "info"): 2000,
    ("refine_outline", "info"): 2000,
    ("write_section", "info"): 3000,
    ("synthesize_report", "outline"): 1000,
    ("synthesize_report", "sections"): 8000,
    ("expand_subtopics", "findings"): 1500,
}

_FIELD = re.compile(r"\{(\w+)\}")


def _java_format(template: str) -> tuple[str, list[str]]:
    names = _FIELD.findall(template)
    fmt = _FIELD.sub("%s", template.replace("%", "%%"))
    return fmt, names


def render(name: str, **params: Column) -> Column:
    """L1: fill a template with parameter columns (budgets applied).  Values
    are substituted in one pass, so a value containing '{x}' stays as is."""
    fmt, names = _java_format(TEMPLATES[name])
    args = []
    for n in names:
        c = F.coalesce(params[n].cast("string"), F.lit(""))
        b = BUDGETS.get((name, n))
        if b is not None:
            c = F.right(c, F.lit(-b)) if b < 0 else F.left(c, F.lit(b))
        args.append(c)
    return F.format_string(fmt, *args)


# L7 ------------------------------------------------------------------------
MAX_ATTEMPTS = 3


def resolve_responses(attempts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The outcome of each prompt from its attempt log.

    ``attempts``: key, attempt (0-based), http_status, finished_reason,
    error, text.  The first completed attempt within three gives the text.
    Otherwise the third attempt decides: HTTP 429 -> 'max retries exceeded';
    any other HTTP failure (no status, or none of 2xx) -> bridge error, whatever
    its error text; an answered request whose error mentions 429/rate -> 'max
    retries exceeded'; any other -> the generator's error message.  ``status`` is
    typed; ``compat_text`` is the string the reference hands on as text."""
    a = attempts.where(F.col("attempt") < MAX_ATTEMPTS)
    err = F.coalesce(F.col("error"), F.lit(""))
    rate = err.contains("429") | F.lower(err).contains("rate")
    answered = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    kind = (F.when(answered & (F.col("finished_reason") == "completed"), "completed")
            .when(F.col("http_status") == 429, "rate_limited").when(~answered, "http_error")
            .when(rate, "rate_limited").otherwise("error"))
    a = a.withColumn("_kind", kind)
    g = a.groupBy(key).agg(
        F.min(F.when(F.col("_kind") == "completed", F.col("attempt"))).alias("_first_ok"),
        F.max_by(F.struct("_kind", "error", "http_status"), F.col("attempt")).alias("_last"),
        F.count(F.lit(1)).alias("attempts"))
    done = a.where(F.col("_kind") == "completed").select(key, F.col("attempt").alias("_first_ok"), "text")
    g = g.join(done, [key, "_first_ok"], "left")
    last = F.col("_last._kind")
    status = F.when(F.col("_first_ok").isNotNull(), "completed").otherwise(last)
    compat = (F.when(F.col("_first_ok").isNotNull(), F.col("text"))
              .when(last == "rate_limited", F.lit("[LLM ERROR: max retries exceeded]"))
              .when(last == "http_error", F.concat(F.lit("[BRIDGE ERROR: HTTP "),
                                                   F.coalesce(F.col("_last.http_status").cast("string"), F.lit("none")), F.lit("]")))
              .otherwise(F.concat(F.lit("[LLM ERROR: "), F.coalesce(F.col("_last.error"), F.lit("")), F.lit("]"))))
    return g.select(key, status.alias("status"), "attempts",
                    F.when(F.col("_first_ok").isNotNull(), F.col("text")).alias("text"),
                    compat.alias("compat_text"))
