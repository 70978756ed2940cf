import random

from clipmill.functions import chunking as C


def loop(n):
    """Word windows as a plain loop over focal starts."""
    if n <= 400:
        return [(0, n)] if n else []
    out, focal = [], 0
    while focal < n:
        if n - focal <= 300 and out:
            out[-1] = (out[-1][0], n)
            break
        out.append((max(focal - 100, 0), min(focal + 300, n)))
        focal += 100
    return out


def test_windows_match_the_loop(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 1500).select(F.col("id").cast("int").alias("n"))
    for r in df.select("n", C.windows(F.col("n")).alias("w")).collect():
        assert [(w.first_word, w.end_word) for w in r.w] == loop(r.n), r.n
    assert loop(401) == [(0, 300), (0, 401)] and loop(745) == [(0, 300), (0, 400), (100, 500), (200, 600), (300, 745)]


def test_chunks():
    assert C.chunks_of("") == C.chunks_of(" \n ") == C.chunks_of(None) == []
    assert C.chunks_of(" é word ") == [{"chunk_index": 0, "start_char": 0, "end_char": 7, "body": "é word"}]
    rng = random.Random(1)
    text = " ".join(rng.choice(["wörd", "end.", "x!", "para\n\ngraph"]) for _ in range(1200))
    raw, got = text.encode(), C.chunks_of(text)
    ends = set(C.boundaries(text).tolist())
    assert [c["chunk_index"] for c in got] == list(range(len(got))) and len(got) == len(loop(len(text.split())))
    for c in got:
        assert raw[c["start_char"] : c["end_char"]].decode().strip() == c["body"].strip()
        for at in (c["start_char"], c["end_char"]):  # a sentence end, or a word's start where the nearest end lies on the wrong side
            assert at in ends or (raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace())
    assert got[0]["start_char"] == 0 and got[-1]["end_char"] == len(raw)


def test_boundaries_and_snap():
    text = "One. Two!x Three?\n \nFour é. End"
    assert [text.encode()[:b].decode()[-3:] for b in C.boundaries(text)] == ["", "ne.", "ee?", "\n \n", " é.", "End"]
    ends = C.boundaries("a. " + "b" * 20 + ". c")
    assert C.snapped(ends, 3, True) == 2 and C.snapped(ends, 13, True) == 2 and C.snapped(ends, 13, False) in (2, 24)
    far = C.boundaries("x" * 2000)
    assert C.snapped(far, 1000, True) == 1000


def test_chunked(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "entry_id int, body string")
    assert [(r.entry_id, r.chunk_index, r.body) for r in C.chunked(df).collect()] == [(1, 0, "a b")]
