"""Subtitles as turns, windows of long texts and their merged envelopes, by hand-worked cases."""

from pyspark.sql import functions as F

from memlake.operators.envelopes import KEYWORDS, SUMMARY, merged_envelopes, text_windows
from memlake.sources.subtitles import speech_lines, spoken_turns, transcripts

VTT = """WEBVTT

NOTE made by hand
STYLE
1
00:00:01.000 --> 00:00:02.000
<v Dana>Hello <b>there</b>

2
00:00:02.000 --> 00:00:03.000
<v Dana>how are you?
fine: I hope

00:00:03.000 --> 00:00:04.000
<v Dr. Lee Smith>Well.
<v >nobody
One thing was clear to all: it shipped
Dana: yes
Hello, you: not a name,
42
"""


def test_subtitles(spark):
    files = spark.createDataFrame([(1, VTT.replace("\n", "\r\n")), (2, ""), (3, None), (4, "just words\nand more"), (5, "Ann: a\nAnn: b\nBob: <i></i>\nAnn: c")], "file_id long, text string")
    got = [(x.turn, x.speaker, x.start, x.text) for x in spoken_turns(files).where("file_id = 1").orderBy("turn").collect()]
    assert got == [
        (1, "Dana", "00:00:01.000", "Hello there how are you?"),
        (2, "fine", "00:00:02.000", "I hope"),
        (3, "Dr. Lee Smith", "00:00:03.000", "Well."),
        (4, None, "00:00:03.000", "nobody One thing was clear to all: it shipped"),
        (5, "Dana", "00:00:03.000", "yes"),
        (6, "Hello, you", "00:00:03.000", "not a name,"),
    ]
    assert speech_lines(files).where("file_id = 1").agg(F.max("cue")).first()[0] == 3
    whole = {x.file_id: x for x in transcripts(files).collect()}
    assert set(whole) == {1, 4, 5} and list(whole[1].speakers) == ["Dana", "fine", "Dr. Lee Smith", "Hello, you"]
    assert (whole[4].text, whole[4].turns, whole[4].warning) == ("just words and more", 1, "no speaker attribution found")
    assert (whole[5].text, whole[5].turns) == ("Ann: a b c", 1)


def test_windows(spark):
    texts = {1: "a" * 25, 2: "a" * 9 + "\n\n" + "b" * 30, 3: "x" * 18 + ". y" + "z" * 10, 4: "", 5: None, 6: " " * 45 + "q", 7: "short", 8: "p" * 17 + "\n\n\n" + "r" * 6}
    got = {}
    for x in text_windows(spark.createDataFrame(list(texts.items()), "data_id long, text string"), 20).orderBy("data_id", "ordinal").collect():
        got.setdefault(x.data_id, []).append((x.ordinal, x.span_start, x.span_end))
    assert got == {1: [(0, 0, 20), (1, 20, 25)], 2: [(0, 0, 20), (1, 20, 40), (2, 40, 41)], 3: [(0, 0, 20), (1, 20, 31)], 6: [(0, 40, 46)], 7: [(0, 0, 5)], 8: [(0, 0, 20), (1, 20, 26)]}


ENVELOPE = "data_id long, ordinal int, title string, summary string, keywords array<string>, entities array<struct<name string, type string>>, relations array<struct<subject string, predicate string, object string, confidence double>>"


def test_envelopes(spark):
    parts = [
        (1, 0, "First", " one ", ["Alpha", "", "beta"], [("Ann", "person"), (" ", "person"), ("Rome", None)], [("Ann", "lives_in", "Rome", 0.4), ("Ann", "", "x", 1.0)]),
        (1, 1, "Second", "two", ["ALPHA", "gamma"], [("ANN", "person"), ("Ann", "event")], [("ann", "lives_in", "ROME", 0.9), ("Bob", "knows", "Ann", None)]),
        (1, 2, None, None, None, None, None),
        (1, 24, "Late", "late", ["late"], [("Late", "event")], []),
        (2, 0, "Long", "s" * (SUMMARY + 5), [f"k{i}" for i in range(60)], [], []),
        (3, 1, "Only later", "", [], None, []),
    ]
    got = {x.data_id: x for x in merged_envelopes(spark.createDataFrame(parts, ENVELOPE)).collect()}
    one = got[1]
    assert (one.title, one.summary, list(one.keywords), one.windows_read) == ("First", "one\n\ntwo", ["Alpha", "beta", "gamma"], 3)
    assert [tuple(e) for e in one.entities] == [("Ann", "person"), ("Rome", "other"), ("Ann", "event")]
    assert [tuple(r) for r in one.relations] == [("Ann", "lives_in", "Rome", 0.9), ("Bob", "knows", "Ann", None)]
    assert len(got[2].keywords) == KEYWORDS and got[2].summary == "s" * SUMMARY + "…" and got[2].entities is None
    assert (got[3].title, got[3].summary, list(got[3].keywords)) == ("Only later", "", [])
    assert merged_envelopes(spark.createDataFrame([], ENVELOPE)).count() == 0


def test_chunks_leave_a_task_in_pieces(spark):
    """More chunks than one piece holds, from texts that no plan carries beside their chunks."""
    from memlake.functions.chunking import PIECE, chunks, spans

    text = "word " * (PIECE // 12)
    rows = spark.range(8).select(F.col("id").alias("data_id"), F.when(F.col("id") % 4 != 3, F.lit(text)).alias("text")).coalesce(1)
    cut = chunks(rows)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "ArrowEvalPython" not in plan
    want = [(i, n, a, b, text[a:b]) for i in range(8) if i % 4 != 3 for n, (a, b) in enumerate(spans(text))]
    assert sorted(map(tuple, cut.collect())) == want
