"""Turn assembly, stop phrases, history and findings (turns fixture)."""

from citeline.operators import dialogue as dl


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_stop_phrase_and_max_turns(spark):
    rows = [
        (1, 0, "user", "  Q one?"), (1, 1, "assistant", "A1"),
        (1, 2, "user", "Merci beaucoup pour votre aide !"), (1, 3, "assistant", "De rien"),
        (1, 4, "user", "Q late"), (1, 5, "assistant", "A late"),
        (2, 0, "user", "merci, next"), (2, 1, "assistant", "A"),       # lower-case: not a stop
        (2, 2, "user", "Q2"), (2, 3, "assistant", "B"),
        (2, 4, "user", "Q3"), (2, 5, "assistant", "C"),                # third turn: over max 2
        (3, 0, "user", " Thank you"), (3, 1, "assistant", "x"),   # stripped before the test
        (4, 0, "system", "sys"), (4, 1, "user", "Q"), (4, 2, "user", "Q again"), (4, 3, "assistant", "A"),
    ]
    got = {(r.conv_id, r.turn_no): (r.question, r.answer) for r in dl.assemble_turns(conv(spark, rows)).collect()}
    assert got == {(1, 1): ("Q one?", "A1"), (2, 1): ("merci, next", "A"), (2, 2): ("Q2", "B"),
                   (4, 1): ("Q again", "A")}


def test_history_last_2000_chars(spark):
    rows = []
    for t in range(3):
        rows += [(1, 2 * t, "user", f"q{t}"), (1, 2 * t + 1, "assistant", "a" * 1500)]
    turns = dl.assemble_turns(conv(spark, rows), max_turns=3)
    h = {r.turn_no: r.history for r in dl.with_history(turns).collect()}
    assert h[1] == ""
    assert h[2] == "\nQ: q0\nR: " + "a" * 1500 + "\n"
    full = "\nQ: q0\nR: " + "a" * 1500 + "\n" + "\nQ: q1\nR: " + "a" * 1500 + "\n"
    assert h[3] == full[-2000:] and len(h[3]) == 2000


def test_findings_first_three_pieces_then_length(spark):
    ans = ("Short one. This sentence is longer than twenty! Exactly twenty chars.. "
           "Fourth sentence is long enough but too late.")
    turns = spark.createDataFrame([(1, 1, ans), (1, 2, "")], "conv_id long, turn_no long, answer string")
    got = [(r.pos, r.finding) for r in dl.findings(turns, ["conv_id", "turn_no"]).orderBy("pos").collect()]
    # "Exactly twenty chars.." splits after the second dot: 21 characters, kept
    assert got == [(1, "This sentence is longer than twenty"), (2, "Exactly twenty chars.")]
    piece21 = "a" * 21
    turns = spark.createDataFrame([(1, 1, f"{piece21}. {'b' * 20}? x")], "conv_id long, turn_no long, answer string")
    assert [r.finding for r in dl.findings(turns, ["conv_id", "turn_no"]).collect()] == [piece21]


def test_first_findings(spark):
    f = spark.createDataFrame([(1, i, f"f{i}") for i in range(12)], "research_id long, k long, finding string")
    out = dl.first_findings(f, "research_id", ["k"], 10, "s").first().s
    assert out.split("\n") == [f"- f{i}" for i in range(10)]


def test_history_reaches_exactly_as_far_back_as_its_characters(spark):
    rows = [("k", i, "q" * (i % 7 * 40) or None, "" if i % 5 == 0 else chr(97 + i % 26) * (i * 13 % 400)) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id string, turn_no long, question string, answer string")
    for chars in (1, 9, 50, 2000, 10 ** 6):
        got = {r.turn_no: r.history for r in dl.with_history(df, chars=chars).collect()}
        text = ""
        for _, n, q, a in rows:
            assert got[n] == text[-chars:]
            text += f"\nQ: {q or ''}\nR: {a}\n"
    assert len(text) > 2000


def test_turns_pair_over_gaps(spark):
    rows = [("k", 0, "user", " a? "), ("k", 3, "assistant", "A"), ("k", 7, "user", "b?"), ("k", 8, "user", "c?"),
            ("k", 20, "assistant", "C"), ("k", 21, "assistant", "ignored")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = [(r.turn_no, r.turn, r.question, r.answer) for r in dl.assemble_turns(df).orderBy("turn_no").collect()]
    assert got == [(1, 0, "a?", "A"), (2, 8, "c?", "C")]
