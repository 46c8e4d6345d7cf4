"""Paragraph scoring, top-30 and the three budget rules (paragraph_cases)."""

from pyspark.sql import functions as F

from citeline.functions.arrays import budget_exclude, budget_truncate
from citeline.operators import paragraphs as para


def scores(spark, paras):
    text = "\n".join(paras)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r.pos, r.score) for r in para.paragraph_scores(df, "doc_id", "text", "\n").orderBy("pos").collect()]


def test_length_and_score_boundaries(spark):
    p40, p41 = "a" * 40, "b" * 41
    p200, p201 = "c" * 200, "d" * 201
    w30 = " ".join(["w1"] * 30) + "x" * 20          # 30 words, > 40 chars
    w31 = " ".join(["w1"] * 31)
    year = "in the year 1999 something happened here ok"
    study = "A STUDY about things that are long enough."
    got = scores(spark, [p40, p41, p200, p201, w30, w31, year, study])
    assert got == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 1), (7, 2)]


def test_top_30_stable_and_budget(spark):
    # 35 equal-score paragraphs: the first 30 in document order survive
    paras = [f"{i:03d}" + "p" * 60 for i in range(35)]
    df = spark.createDataFrame([(1, "\n".join(paras))], "doc_id int, text string")
    rows = para.top_paragraphs(df, "doc_id", "text", "\n", max_chars=10_000).orderBy("rank").collect()
    assert [r.pos for r in rows] == list(range(30))
    # a high-score paragraph moves to the front
    paras[20] = "2024 research " + "q" * 200
    df = spark.createDataFrame([(1, "\n".join(paras))], "doc_id int, text string")
    rows = para.top_paragraphs(df, "doc_id", "text", "\n", max_chars=10_000).orderBy("rank").collect()
    assert rows[0].pos == 20 and rows[0].score == 4 and rows[1].pos == 0


def test_budget_exactly_met_keeps_empty_crossing_piece(spark):
    df = spark.createDataFrame([(["a" * 50, "b" * 50, "c" * 50],)], "p array<string>")
    out = df.select(budget_truncate(F.col("p"), 100).alias("o")).first().o
    assert out == ["a" * 50, "b" * 50, ""]
    out = df.select(budget_truncate(F.col("p"), 101).alias("o")).first().o
    assert out == ["a" * 50, "b" * 50, "c"]
    out = df.select(budget_truncate(F.col("p"), 20).alias("o")).first().o
    assert out == ["a" * 20]


def test_main_content_join(spark):
    text = "\n".join(["x" * 45, "short", "y" * 45])
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = para.with_main_content(df, "text", "c", "\n", max_chars=60).first().c
    assert got == "x" * 45 + "\n\n" + "y" * 15


def test_budget_exclude(spark):
    df = spark.createDataFrame([(["aaaa", "", "bbbb", "cc", ""],)], "p array<string>")
    assert df.select(budget_exclude(F.col("p"), 8).alias("o")).first().o == ["aaaa", "", "bbbb"]
    assert df.select(budget_exclude(F.col("p"), 10).alias("o")).first().o == ["aaaa", "", "bbbb", "cc", ""]
    assert df.select(budget_exclude(F.col("p"), 3).alias("o")).first().o == []
