"""URL extraction, links, fetch, registry (requested_urls, serp_html fixtures)."""

from pyspark.sql import functions as F

from citeline.operators import sources as so
from citeline.operators import urls as ur
from citeline.operators.elements import select_links
from citeline.operators.ordering import number_within


def test_extract_urls_terminators(spark):
    text = ('see (https://a.com/x). and [http://b.org/y] "https://c.net/z"; https://d.io/p.,;: '
            'and https://e.com/q\nhttps://f.com')
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ur.extract_urls(F.col("t")).alias("u")).first().u == [
        "https://a.com/x", "http://b.org/y", "https://c.net/z", "https://d.io/p", "https://e.com/q", "https://f.com"]
    assert df.select(ur.extract_urls(F.col("t"), 3).alias("u")).first().u == [
        "https://a.com/x", "http://b.org/y", "https://c.net/z"]


def test_links_limit_before_http_filter(spark):
    html = ('<div><a class="result__a" href="//proto.rel/1">One</a>'
            '<A CLASS="x result__a" HREF="https://two.com">T<b>w</b> o </A>'
            '<a class="other" href="https://skip.com">skip</a>'
            '<a class="result__a" href="http://three.com"> Three </a></div>')
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = [(r.url, r.title) for r in ur.extract_links(df, "html", ["id"], n=2).collect()]
    assert got == [("https://two.com", "Two")]       # first two of the class, then http only
    got = [(r.url, r.title) for r in ur.extract_links(df, "html", ["id"], n=5).orderBy("pos").collect()]
    assert got == [("https://two.com", "Two"), ("http://three.com", "Three")]


LINKS = [('<a data-href="d" data-class="result__a" href="https://skip">skip</a>'
          '<a title="href=\'https://no\' > x" class=\'a result__a\' href="https://one?x=1&amp;y=\'2\'">O<i> n </i>e</a>'
          '<a href=https://two class=result__a>t&lt;w&amp;lt;o</a>', [("https://one?x=1&y='2'", "One"), ("https://two", "t<w&lt;o")]),
         ("<a class='result__a'>none</a>", []), ("", []), (None, []), ("<a class='result__a' href='https://open'>never closed", None)]


def test_links_by_attribute_boundaries(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(LINKS)], "id int, html string")
    plain = ur.extract_links(df, "html", ["id"]).orderBy("id", "pos").collect()
    balanced = select_links(df, "html", ["id"]).orderBy("id", "pos").collect()
    for i, (_, want) in enumerate(LINKS):
        if want is not None:
            assert [(r.url, r.title) for r in plain if r.id == i] == want
            assert [(r.url, r.title) for r in balanced if r.id == i] == want
    assert [(r.url, r.title) for r in balanced if r.id == 4] == [("https://open", "never closed")]


def test_links_of_nested_elements(spark):
    html = ('<div class="result__a" href="http://outer">a<div>b<div>c</div></div><p>d</div>e'
            '<li class="result__a" href="http://li">x<script>no()</script><br>y')
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = [(r.url, r.title) for r in select_links(df, "html", ["id"]).orderBy("pos").collect()]
    assert got == [("http://outer", "abcd"), ("http://li", "xy")]


def test_search_url(spark):
    df = spark.createDataFrame([("climat et océans 2024",)], "q string")
    assert df.select(ur.search_url(F.col("q")).alias("u")).first().u == \
        "https://html.duckduckgo.com/html/?q=climat+et+océans+2024"


CORPUS = [("http://a", "<title>A</title><p>" + "a" * 60 + "</p>"), ("http://b", "<title>B</title>"),
          ("http://c", "<title>C</title><meta name='description' content='dc'>")]


def test_fetch_and_fallback(spark):
    corpus = spark.createDataFrame(CORPUS, "url string, html string")
    req = spark.createDataFrame([("http://a",), ("http://a",), ("http://zz",)], "url string")
    got = {r.url: (r.ok, r.content) for r in so.fetch(req, corpus).collect()}
    assert got["http://zz"] == (False, so.ERROR_TEXT) and got["http://a"][0] and len(got) == 2
    rendered = spark.createDataFrame([("http://zz", "# md")], "url string, html string")
    fb = {r.url: r.origin for r in so.fetch_with_fallback(req, rendered, corpus).collect()}
    assert fb == {"http://a": "plain", "http://zz": "preferred"}


def test_registry_dedup_failures_and_numbering(spark):
    corpus = spark.createDataFrame(CORPUS, "url string, html string")
    req = spark.createDataFrame([
        ("r", 0, 1, "http://b"), ("r", 0, 2, "http://missing"), ("r", 0, 3, "http://a"),
        ("r", 1, 1, "http://b"), ("r", 1, 2, "http://missing"), ("r", 2, 0, "http://c"),
        ("s", 0, 1, "http://a")], "research_id string, step int, seq long, url string")
    reg = so.register_sources(req, corpus).orderBy("research_id", "citation_index").collect()
    assert [(r.research_id, r.citation_index, r.url) for r in reg] == [
        ("r", 1, "http://b"), ("r", 2, "http://a"), ("r", 3, "http://c"), ("s", 1, "http://a")]
    assert reg[1].snippets == ["A " + "a" * 60] and reg[2].description == "dc"   # title text stays in the body


def test_number_within_blocks_equal_window(spark):
    rows = [("hot", s % 3, s) for s in range(500)] + [("cold", 0, s) for s in range(0, 50, 7)]
    df = spark.createDataFrame(rows, "k string, step int, seq long")
    a = number_within(df, ["k"], ["step", "seq"], "n", block_of="seq", block_size=16)
    b = number_within(df, ["k"], ["step", "seq"], "n")
    assert sorted(a.collect()) == sorted(b.collect())
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_plan_requests_then_registry(spark):
    resp = spark.createDataFrame([
        ("r", 0, 1, 0, "- http://b\n- http://missing\n- http://a\n- http://c"),   # 4 URLs: cap 3
        ("r", 0, 1, 1, "- http://c"),
        ("r", 0, 1, 2, "- http://never"),                                           # third query: not searched
        ("r", 1, 1, 0, "- http://b  - http://a."),                                  # section search: duplicates
    ], "research_id string, step int, turn_no int, query_no int, text string")
    req = ur.plan_requests(resp)
    assert [r.url for r in req.orderBy("step", "seq").collect()] == [
        "http://b", "http://missing", "http://a", "http://c", "http://b", "http://a"]
    corpus = spark.createDataFrame(CORPUS, "url string, html string")
    reg = so.register_sources(req, corpus).orderBy("citation_index").collect()
    assert [(r.citation_index, r.url) for r in reg] == [(1, "http://b"), (2, "http://a"), (3, "http://c")]


from citeline.operators.sources import register_sources  # noqa: E402


def test_first_n_above_group_limit_threshold(spark):
    from citeline.operators.ordering import first_n
    n = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")) + 200
    df = spark.createDataFrame([("a", i) for i in range(3000)] + [("b", i) for i in range(10)],
                               "k string, seq long")
    got = first_n(df, ["k"], ["seq"], n, block_of="seq")
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts == {"a": n, "b": 10}
    assert got.where("k = 'a'").agg(F.max("seq")).first()[0] == n - 1


def test_spread_only_when_few_splits(spark):
    from citeline.sources.tables import spread
    one = spark.range(100).coalesce(1)
    many = spark.range(100).repartition(16)
    assert spread(one).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(many).rdd.getNumPartitions() == 16


def test_numbering_by_any_order_reads_one_range_shuffle(spark):
    """A group with most rows spreads over the ranges; numbers are dense, null keys are a group."""
    from citeline.operators.running import numbered, running_totals
    rows = [("hot" if i % 10 else None, (i * 7919) % 5003, i % 3, i % 5 or None) for i in range(5003)]
    df = spark.createDataFrame(rows, "k string, a long, b long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["k"], [F.desc("a"), "b"], "n").collect()
        sums = running_totals(df, ["k"], ["b", "a"], {"total": "v", "rows": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, total = {}, {}
    for key in ("hot", None):
        mine = [r for r in rows if r[0] == key]
        want.update({(key, r[1]): i + 1 for i, r in enumerate(sorted(mine, key=lambda r: (-r[1], r[2])))})
        run = 0
        for i, r in enumerate(sorted(mine, key=lambda r: (r[2], r[1]))):
            run += r[3] or 0
            total[(key, r[1])] = (run, i + 1)
    assert {(r.k, r.a): r.n for r in got} == want
    assert {(r.k, r.a): (r.total, r.rows) for r in sums} == total


def test_url_twice_in_the_corpus_is_one_citation(spark):
    corpus = spark.createDataFrame([("u1", "<title>a</title>x"), ("u1", "<title>b</title>y"), ("u2", "<title>c</title>z"),
                                    ("u2", "<title>c</title>z")], "url string, html string")
    req = spark.createDataFrame([("r", 0, 0, "u2"), ("r", 0, 1, "gone"), ("r", 1, 0, "u1"), ("r", 1, 1, "u2")],
                                "research_id string, step long, seq long, url string")
    got = sorted((r.citation_index, r.url, r.title) for r in register_sources(req, corpus).collect())
    assert got == [(1, "u2", "c"), (2, "u1", "a")]
