"""List and outline parsers (responses fixture)."""

from pyspark.sql import functions as F

from citeline.operators import parse as ps


def items(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_persona_list(spark):
    text = ("1. Expert en histoire: contexte\n  2.Expert en droit: regles  \n10. Expert en art: formes\n"
            "Un-numbered persona line\nshort\n100. Expert dix: z")
    assert items(spark, ps.persona_items, text) == ["Expert en histoire: contexte", "Expert en droit: regles",
                                                   "Expert en art: formes"]
    assert items(spark, ps.persona_items, "tiny\n") == [ps.DEFAULT_PERSONA]
    # 100. has no '.' in its first three characters, so it is kept whole
    assert items(spark, ps.persona_items, "100. Expert dix: z") == ["100. Expert dix: z"]


def test_query_and_subtopic_lists(spark):
    text = "- requete un\n--  - deux trois\n-abc\n - ab\n- quatre cinq\n- six"
    assert items(spark, ps.query_items, text) == ["requete un", "deux trois", "quatre cinq"]
    assert items(spark, ps.subtopic_items, "- sous-question numero un\n- court\n- autre sous-question") == [
        "sous-question numero un", "autre sous-question"]


def test_outline(spark):
    text = "# Intro\n  ## Part A  \n### Detail\n#### Too deep\n#x\n# \nplain\n##  Spaced"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [(r.sec_no, r.level, r.title) for r in ps.outline_sections(df, ["id"], "t").orderBy("sec_no").collect()]
    assert got == [(1, 1, "Intro"), (2, 2, "Part A"), (3, 3, "Detail"), (4, 2, "Spaced")]
