import pytest
from pyspark.sql import functions as F

from clipmill.functions import text as T
from clipmill.sources import clips


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (T.normalize_to_ascii, {"a—b": "a-b", "wait…": "wait.", "“x” ‘y’": "\"x\" 'y'", "a   b": "a b", "": "", "é": ""}),
        (T.strip_source_suffix, {"Chat - Claude - Brave": "Chat", "Page - https://x.com - Brave": "Page", "plain title": "plain title", "": "", "a - http://b - https://c": "a", "x - Arc - Arc": "x - Arc", "Talk— Claude": "Talk"}),
        (T.group_key, {"ab": None, "My Untitled Page": None, "Some page - Brave": "Some page", "é!": "é!"}),
        (lambda c: T.truncate_bytes(c, 4), {"café": "caf", "abc": "abc", "abcd": "abcd", "🎉🎉": "🎉", "a🎉": "a", "日本": "日", "abcdé": "abcd", "": ""}),
        (T.strip_markers, {"\x01a\x02b\x03": "ab"}),
        (T.length_tier, {"": "short", "x" * 1200: "medium", "é" * 1750: "long", "é" * 1749: "medium"}),
        (T.normalize_tag, {"  My Tag ": "my-tag"}),
        (T.fold, {"ÀÉß Ñandú": "aeß nandu", "é": "e"}),
    ],
)
def test_scalars(spark, function, pairs):
    assert apply(spark, function, list(pairs)) == list(pairs.values())


def test_lines(spark):
    assert apply(spark, T.lines, ["", "a", "a\n", "a\r\nb", "\n", "a\n\n"]) == [[], ["a"], ["a"], ["a", "b"], [""], ["a", ""]]


def test_claims(spark):
    answer = "Here are the claims:\n\nPlain one\n- dashed\n* starred\n1. numbered\n[label] text\n[standalone]\n1234. long number\nNote: no\n---"
    assert apply(spark, T.claims, [answer]) == [["Plain one", "dashed", "starred", "numbered", "text", "[standalone]", "1234. long number"]]


def test_snippets_similar(spark):
    words = "one two three four five six seven eight nine"
    cases = [("a b", " a b "), (words, words.replace("nine", "ten")), ("alpha beta gamma delta epsilon", words), ("one two three four", words), ("\x02one\x03 x", "one x")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r[0] for r in df.select(T.snippets_similar(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True]


def test_diff(spark):
    df = spark.createDataFrame([("a\n  b\n\nc\nc", "b\nd")], "x string, y string")
    assert df.select(T.diff_side(F.col("x"), F.col("y")), T.diff_side(F.col("y"), F.col("x"))).first()[:] == ("a\nc\nc", "d")


def test_sniffing(spark):
    assert apply(spark, T.looks_like_markdown, ["# A\n- b", "# A", "x\n" * 100 + "# A\n# B", "**a**\n[x](y)\n|a|"]) == [True, False, False, True]
    assert apply(spark, T.looks_like_mail_summary, ["x\nEMAIL\nFrom: a\nDate: b", "x\nEMAIL\nfrom a", "\nFrom: a\nDate: b"]) == [True, False, False]


def test_clip_headers_and_dates(spark):
    assert apply(spark, clips.source_header, ["# source:   padded title  \nx", "## source: x", "# source: only", "#source: x"]) == ["padded title", None, "only", None]
    assert apply(spark, clips.without_header, ["# source: a\nb\nc", "b\nc", "# source: a"]) == ["b\nc", "b\nc", ""]
    dates = apply(spark, clips.clip_date, ["/a/20240315_14-30-00.txt", "/a/20240315_143000.md", "/a/notes.txt", "/a/20241315_143000.md"])
    assert [d and d.isoformat(" ") for d in dates] == ["2024-03-15 14:30:00", "2024-03-15 14:30:00", None, None]


def test_doctypes(spark):
    titles = ["Channel - general - Slack - Brave", "My Chat - Claude - Brave", "Random Page Title", "Mail - x - Outlook", "Zoom"]
    assert apply(spark, lambda c: clips.by_title(c, F.lit("txt")), titles) == ["slack", "claude", None, "email", "meeting_transcript"]
    assert apply(spark, lambda c: clips.detect(c, F.lit("md"), F.lit("x")), ["plain"]) == ["markdown"]
    assert apply(spark, lambda c: clips.detect(F.lit("t"), F.lit("txt"), c), ["# A\n## B", "plain"]) == ["claude", None]  # the first type of that parser
