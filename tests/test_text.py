"""Cleaning and metadata on the html_cases fixture (boundary cases)."""

from pyspark.sql import functions as F

from citeline.functions import text as tx
from citeline.operators import pages as pg
from citeline.operators.paragraphs import main_content_expr


def run(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")
    return [r[0] for r in df.orderBy("id").select(expr(F.col("s"))).collect()]


def test_clean_text_cases(spark):
    cases = {
        "<html><head><style>p{x}</style><script>var a='<b>';</script></head>"
        "<body><p>Hello&nbsp;&amp;lt; World</p></body></html>": "Hello < World",
        "x <SCRIPT type='a'>alert(1)</SCRIPT> y": "x y",
        "a <Style>\n.c{}\n</STYLE>\n b": "a b",
        "a<script>var x": "a var x",                       # unclosed script: only the tag goes
        "q&#39;s &#x27; &apos; &quot;z&quot;": 'q s &#x27; &apos; "z"',
        "one\xa0two\x1cthree four\n\n five ": "one two three four five",
        "&lt;b&gt;bold&lt;/b&gt;": "<b>bold</b>",
        "   ": "",
        "<p>٣٤٥ &#٣٤;x</p>": "٣٤٥ x",   # Unicode digits in entities
    }
    assert run(spark, tx.clean_text, list(cases)) == list(cases.values())


def test_metadata_cases(spark):
    html = [
        '<meta name="description" content="Desc one"><title>T1</title><title>T2</title>',
        "<meta content='Desc two' name='description'>",
        '<META NAME="description" CONTENT="It\'s here">',
        '<meta name="description" content="">',
        '<meta property="article:published_time" content="2024-05-01T10:00:00+00:00:00:00:00">',
        '<meta name="date"\n content="2023-01-01">',
        '<meta content="2022-02-02" name="date">',
        "<TITLE>A &amp; B\n c</TITLE>",
        "<title>" + "x" * 400 + "</title>",
        "<title>   </title>",
    ]
    df = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    rows = pg.with_metadata(df).orderBy("id").collect()
    assert [r.title for r in rows] == ["T1", "Untitled", "Untitled", "Untitled", "Untitled", "Untitled",
                                       "Untitled", "A & B c", "x" * 300, "Untitled"]
    assert [r.description for r in rows] == ["Desc one", "Desc two", "It", "", "", "", "", "", "", ""]
    assert [r.publish_date for r in rows][4:7] == ["2024-05-01T10:00:00+00:00:00:0", "2023-01-01", ""]


def test_main_content_modes_agree(spark):
    html = ["<p>" + "word " * 20 + "</p>", "<p>short text</p>", "<p>" + "y" * 6000 + "</p>", "<p>" + "z" * 41 + "</p>"]
    df = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    a = pg.with_main_content(df, max_chars=5000, mode="compat").orderBy("id").collect()
    b = df.withColumn("content", main_content_expr(tx.clean_text(F.col("html")), "\n\n", 5000)).orderBy("id").collect()
    assert [r.content for r in a] == [r.content for r in b]
    assert [len(r.content) for r in a] == [99, 0, 5000, 41]


def test_cache_key(spark):
    import hashlib
    url = "https://example.com/a?b=c"
    got = run(spark, tx.cache_key, [url])[0]
    assert got == hashlib.sha256(url.encode()).hexdigest()[:16]


def test_whitespace_sets_match_python():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(tx.WS_CHARS) == every


def test_words_like_python_split(spark):
    samples = ["", "   ", " a  b\tc\n", "x y\xa0\x1cz　", "one"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "id int, s string")
    got = [r.w for r in df.orderBy("id").select(tx.words(F.col("s")).alias("w")).collect()]
    assert got == [s.split() for s in samples]


def test_block_text_keeps_blocks_apart(spark):
    html = ("<body><script>var a='<p>x</p>';</script><p>One <b>bold</b>&nbsp;word<br/>two</p><!-- <p>gone</p> --><DIV class=x>Three"
            "</DIV><picture>in</picture>line<ul><li>a</li><li> </li><li>b&lt;p&gt;</li></ul>\x01tail")
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "no tags\n at all")], "id long, html string")
    got = {r.id: r.t for r in df.select("id", tx.block_text(F.col("html")).alias("t")).collect()}
    assert got[1] == "One bold word\n\ntwo\n\nThree\n\nin line\n\na\n\nb<p>\n\ntail"
    assert got[2] is None and got[3] == "" and got[4] == "no tags at all"


def test_block_mode_ranks_paragraphs(spark):
    low, high = "w " * 30, "a study of 2024 " + "word " * 40
    df = spark.createDataFrame([(1, f"<p>{low}</p><p>short</p><p>{high}</p>")], "id long, html string")
    assert pg.with_main_content(df, max_chars=5000, mode="blocks").first().content == f"{high.strip()}\n\n{low.strip()}"
