from clipmill.functions import parsers as P


def brief(entries, *keys):
    return [tuple(e[k] for k in keys) for e in entries]


def test_markdown():
    text = "intro\n\n# One\nbody\n\n```\n# not a heading\n```\n## Two\n\n#tag\nx\n####### seven\n# \n### Last"
    got = P.markdown(text)
    assert brief(got, "heading_level", "heading_title", "body") == [(None, None, "intro"), (1, "One", "body\n\n```\n# not a heading\n```"), (2, "Two", ""), (1, "tag", "x\n####### seven\n# "), (3, "Last", "")]
    assert brief(got, "start_line", "end_line")[:2] == [(1, 2), (3, 8)]
    assert brief(P.markdown("only text\n"), "body", "heading_level") == [("only text", None)]
    assert P.markdown("\n\n") == []


def test_mail_summary():
    text = "From: A\nDate: d1\nTo: z\nSubject: s1\n\nfirst\nEMAIL\nfrom: B\n\nsecond [x | Outlook]\n### EMAIL\nno header\nEMAIL\nSubject: only\n"
    assert brief(P.mail_summary(text), "author", "timestamp", "heading_title", "body") == [("A", "d1", "s1", "first"), ("B", None, None, "second"), (None, None, None, "no header"), (None, None, "only", "Subject: only")]
    assert P.mail_summary("") == []


def test_chat_brackets():
    text = "# source: x\nAnn Lee  [4:56 PM]\nhello\n:pray:\n2\n\nBob  [5:02 PM] inline\n[5:03 PM] more\n3 replies\nBob  [5:10 PM]\nlast\nCy  [6:00 PM]\n"
    assert brief(P.chat(text), "author", "body") == [("Ann Lee", "hello"), ("Bob", "inline\nmore\nlast")]
    joined = P.chat("Ann Lee  [4:56 PM] one. Bob  [4:57 PM] two")
    assert brief(joined, "author", "body") == [("Ann Lee", "one."), ("Bob", "two")]


def test_chat_times_on_lines_of_their_own():
    text = "Ann :star:\n  Today at 4:56 PM\nhello\n\nBob\n4:58 PM\nhi\n5:01\nagain\n12 replies"
    assert brief(P.chat(text), "author", "body") == [("Ann", "hello"), ("Bob", "hi\nagain")]
    assert P.chat("no times at all") == []


def test_email_chain():
    text = 'Top Person\nhi there\n\nFrom: "Kim, David" <k@x.y>\nSent: Friday, January 16, 2026 3:30 PM\nTo: a\nSubject: s\n\nolder\n\n\n\nend\nFrom: Zed\nDate: soon\n\noldest'
    assert brief(P.email_chain(text), "author", "timestamp", "body") == [("Zed", "soon", "Date: soon\n\noldest"), ("Kim, David", "2026-01-16T15:30:00", "older\n\nend"), ("Top Person", None, "hi there")]
    marked = "Subject\nLopez, Ana\n\n​\nKim​\nThe body"
    assert brief(P.email_chain(marked), "author", "body") == [("Lopez, Ana", "The body")]
    assert P.email_chain("A\nkeep\nDrop me", frozenset({"drop me"}))[0]["body"] == "keep"
    assert P.display_name("'Ann' via List <l@x>") == "Ann"


def test_dates_of_mail():
    told = {
        "January 16, 2026, 3:30 PM": "2026-01-16T15:30:00", "Jan 16, 2026, at 3:30\u202fPM": "2026-01-16T15:30:00", "Fri, 16 Jan 2026 15:30:00 +0000": "2026-01-16T15:30:00",
        "Friday, 16 January 2026 at 09:05 GMT": "2026-01-16T09:05:00", "2026-01-16T15:30:59Z": "2026-01-16T15:30:59", "2026-01-16 15:30": "2026-01-16T15:30:00", "1/16/2026 3:30 pm": "2026-01-16T15:30:00",
        "16/1/2026, 15:30": "2026-01-16T15:30:00", "16.01.2026 15:30": "2026-01-16T15:30:00", "Sept. 3rd 2025": "2025-09-03T00:00:00", "Jan 16, 2026 15:30 PM": "2026-01-16T15:30:00", "Jan 1, 2026 12:05 AM": "2026-01-01T00:05:00",
        "Wed, 7 May 2025 10:00:00 -0700 (PDT)": "2025-05-07T10:00:00", "Fri, 16 Jan 2026 15:30 EST": "2026-01-16T15:30:00",
    }
    assert {raw: P.iso_time(raw) for raw in told} == told
    for raw in ("soon", "yesterday at 3:30 PM", "Jan 16 3:30 PM", "February 30, 2026 1:00 PM", "16 Jan 2026 25:00", "3:30 PM", "", "1 2 3 Jan 2026", "Jan 2026 - call"):
        assert P.iso_time(f" {raw} ") == raw


def test_segment_and_transcript(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "# A\nb"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.position, r.heading_title, r.body) for r in P.segment(df, "markdown").collect()] == [(1, 0, "A", "b")]
    js = '{"segments":[{"start":0.5,"end":2,"text":" hi "},{"start":1,"end":2,"text":" "},{"start":3}]}'
    rows = P.transcript_segments(spark.createDataFrame([(js,)], "j string"), "j", F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    assert [(r.segment, r.duration, r.segment_text, r.timestamp.microsecond) for r in rows] == [(0, 1.5, "hi", 500000)]
    entries = spark.createDataFrame([("a@b", "x", None), (None, " ", "soon"), ("Al", "ok", "2024-01-01T00:00:00")], "author string, body string, timestamp string")
    assert sorted(r.issue for r in P.email_issues(entries).collect()) == ["email in author", "empty body", "null author", "unparsed timestamp"]
