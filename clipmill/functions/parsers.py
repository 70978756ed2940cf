"""Parsers that segment a text into entries.

Each takes a text and gives a list of entries (dicts of ``ENTRY``). They keep
state from line to line, so they run as Arrow UDFs over batches of texts.
"""

from __future__ import annotations

import calendar
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import groupby, zip_longest
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("author", T.StringType()), T.StructField("timestamp", T.StringType()),
        T.StructField("body", T.StringType()), T.StructField("is_quote", T.BooleanType()), T.StructField("heading_level", T.IntegerType()), T.StructField("heading_title", T.StringType()),
    ]
)
Entry = dict


def entry(body: str, author: str | None = None, timestamp: str | None = None, level: int | None = None, title: str | None = None, lines: tuple[int, int] = (0, 0)) -> Entry:
    return {"start_line": lines[0], "end_line": lines[1], "author": author, "timestamp": timestamp, "body": body, "is_quote": False, "heading_level": level, "heading_title": title}


def text_lines(text: str) -> list[str]:
    """Lines without their ends; no empty one after a last line end."""
    out = [x.removesuffix("\r") for x in text.split("\n")]
    return out[:-1] if out[-1] == "" else out


def without_blank_edges(lines: list[str], blank: Callable[[str], bool] = lambda x: not x.strip()) -> list[str]:
    filled = [i for i, x in enumerate(lines) if not blank(x)]
    return lines[filled[0] : filled[-1] + 1] if filled else []


def whole(text: str) -> list[Entry]:
    return [entry(text, lines=(1, len(text_lines(text))))] if text.strip() else []


# --- Markdown --------------------------------------------------------------------------------------

HEADING = re.compile(r"^\s*(#{1,6})(?!#)(.*)$", re.S)


def heading(line: str) -> tuple[int, str] | None:
    """Level and title; no blank is needed after the marks, but a title is."""
    m = HEADING.match(line)
    return (len(m[1]), m[2].strip()) if m and m[2].strip() else None


def markdown(text: str) -> list[Entry]:
    """Sections by heading; lines in code fences are never headings. A heading without a body is an entry too."""
    sections: list[tuple[int, tuple[int, str] | None, list[str]]] = [(1, None, [])]
    fenced = False
    for number, line in enumerate(text_lines(text), 1):
        is_fence = line.lstrip().startswith(("```", "~~~"))
        fenced ^= is_fence
        found = None if is_fence or fenced else heading(line)
        if found:
            sections.append((number, found, []))
        else:
            sections[-1][2].append(line)
    out, last = [], len(text_lines(text))
    for k, (start, head, body) in enumerate(sections):
        joined = "\n".join(without_blank_edges(body))
        if head or joined:
            end = sections[k + 1][0] - 1 if k + 1 < len(sections) else last
            out.append(entry(joined, level=head and head[0], title=head and head[1], lines=(start, end)))
    return out


# --- summaries of mail -----------------------------------------------------------------------------

MAIL_BREAK = re.compile(r"\n(?:EMAIL\r?|#EMAIL|##EMAIL|### EMAIL)(?=\n)")
MAIL_TAIL = re.compile(r"\s*\[[^\n]*?\|\s*Outlook\]\s*$")


def mail_summary(text: str) -> list[Entry]:
    """Messages between delimiter lines, each with From, Date and Subject lines before its body."""
    out = []
    for part in MAIL_BREAK.split(text):
        rows = text_lines(part.strip())
        found: dict[str, str] = {}
        start = 0
        for i, line in enumerate(rows):
            name = line.partition(":")[0].lower() if ":" in line else ""
            if name in ("from", "date", "subject"):
                found[name] = line.partition(":")[2].strip()
            elif not line.strip() and found:
                start = i + 1
                break
            elif name not in ("to", "cc"):
                start = i
                break
        body = MAIL_TAIL.sub("", "\n".join(rows[start:])).strip()
        if rows and (body or "from" in found or "date" in found):
            out.append(entry(body, found.get("from"), found.get("date"), title=found.get("subject")))
    return out


# --- spans -----------------------------------------------------------------------------------------


class Span(NamedTuple):
    """Where a message opens in a text: what is cut out for its heading, and what the heading says."""

    start: int
    end: int
    author: str | None  # None: the author of the message before
    timestamp: str | None = None


def bodies(text: str, spans: list[Span]) -> Iterator[tuple[Span, str]]:
    """Each span with the text up to the next one; a span without an author has that of the span before."""
    author = None
    for span, following in zip_longest(spans, spans[1:]):
        author = author if span.author is None else span.author
        yield span._replace(author=author), text[span.end : following.start if following else len(text)]


def after_header(text: str) -> str:
    return text.partition("\n")[2] if text.startswith("# source:") else text


# --- chat ------------------------------------------------------------------------------------------

# How clipboards of a chat program write times, dates and noise.
CLOCK = r"\d{1,2}:\d{2}(?:\s*(?:AM|PM))?"
DAY = r"(?:Today|Yesterday|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d+(?:st|nd|rd|th)?)\s+at\s+"
EMOJI = r":[\w+\-]+:"
REPLY_COUNT = r"\d+[\s\xa0]*repl(?:y|ies)\s*"
# Lines that are no text: how many replies there are, reactions, their numbers, pictures, cards of links.
REPLIES_LINE = r"\d+\s+repl(?:y|ies)"
NUMBER_LINE = r"\d+"
PICTURE_LINE = r"image\.png"
CARD_LINE = r"(?:GitLab|GitHub|Stack Overflow|Wikipedia)(?:GitLab|GitHub)?"
NOISE = (REPLIES_LINE, EMOJI, NUMBER_LINE, PICTURE_LINE, CARD_LINE)
# What stands beside a name: reactions anywhere, a count of replies behind it or run together with it.
EMOJI_RUN = rf"(?:{EMOJI}\s*)+"
COUNT_BEHIND = rf"{REPLY_COUNT}$"
COUNT_BEFORE = rf"^{REPLY_COUNT}(?=[A-Z])"

BRACKET = re.compile(rf"(?P<gap>[ \xa0\t\f\v]{{2,}})?\[{CLOCK}\]")
LAST_NAME = re.compile(r"(?:[@\w][\w'-]*[ \xa0\t]+){0,3}[@\w][\w'-]*\s*$")
TIME_LINE = re.compile(rf"^\s*?(?:{EMOJI}\s*)*(?P<what>(?:{DAY})?{CLOCK}|\d+\s+(?:minute|hour)s?\s+ago)[^\S\n]*$", re.M)
OPENING_TIME = re.compile(rf"(?:{DAY})?\d{{1,2}}:\d{{2}}\s*(?:AM|PM)|\d.*ago", re.S)


def is_noise(line: str) -> bool:
    return any(re.fullmatch(kind, line.strip()) for kind in NOISE)


def undecorated(name: str) -> str:
    for kind in (EMOJI_RUN, COUNT_BEHIND, COUNT_BEFORE):
        name = re.sub(kind, "", name.strip())
    return name.strip()


def bracket_spans(text: str) -> list[Span]:
    """Times in brackets behind a name: one to a line, or several run together; a bracket at the start of a line goes on."""
    spans: list[Span] = []
    for at, line in lines_at(text):
        marks = list(BRACKET.finditer(line))
        named = [m for m in marks if m["gap"] and line[: m.start()].strip()]
        if not named and spans and marks and marks[0].start("gap") < 0 == marks[0].start():
            spans.append(Span(at, at + marks[0].end(), None))
        for m in named:
            found = LAST_NAME.search(line, 0, m.start()) if len(named) > 1 else None
            begin = found.start() if found else 0 if len(named) == 1 else m.start()
            spans.append(Span(at + begin, at + m.end(), undecorated(line[begin : m.start()])))
    return spans


def lines_at(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def time_line_spans(text: str) -> list[Span]:
    """Times on lines of their own below a name; a bare clock goes on with the message before."""
    spans: list[Span] = []
    for m in TIME_LINE.finditer(text):
        upto = text.rfind("\n", 0, m.start("what"))  # ends the line of the name
        begin = text.rfind("\n", 0, max(upto, 0)) + 1
        name = text[begin:upto] if upto >= 0 else ""
        open_body = not spans or (begin >= spans[-1].end and text[spans[-1].end : begin].strip())
        if open_body and undecorated(name) and not is_noise(name) and OPENING_TIME.fullmatch(m["what"].strip()):
            spans.append(Span(begin, m.end(), re.sub(rf"(?:{EMOJI}\s*)+", "", name.strip()).strip()))
        elif spans and re.fullmatch(CLOCK, text[upto + 1 : m.end()].strip()):
            spans.append(Span(upto + 1, m.end(), None))
    return spans


def chat(text: str) -> list[Entry]:
    """Messages of a copied chat; neighbouring ones of one author are one entry."""
    text = after_header(text).strip()
    spans = bracket_spans(text) or time_line_spans(text)
    said: list[tuple[str, str]] = []
    for span, raw in bodies(text, spans):
        kept = without_blank_edges([x for x in raw.split("\n") if not is_noise(x)])
        body = re.sub(rf"\[{CLOCK}\]", "\n", "\n".join(kept)).strip()
        if span.author and body:
            said.append((span.author, body))
    runs = groupby(said, key=itemgetter(0))
    return [entry("\n".join(body for _, body in run), author) for author, run in runs]


# --- chains of mail --------------------------------------------------------------------------------

# Header fields, invisible characters, the mark that ends the recipients of a copied mail.
FIELD = re.compile(r"^(?P<name>From|Date|Sent|To|Cc|Subject):(?P<value>.*)$", re.M)
INVISIBLE = r"[\s\u200b\xa0\ue000-\uf8ff]"
WIDE_BLANKS = {0x200B: None, 0xA0: " ", 0x202F: " "}
MARK = "\u200b"
NEAR = 6  # lines within which a header's second field must stand

ADDRESS = re.compile(r"""(?:"(?P<quoted>[^"]+)"\s*<.*|(?P<plain>[^<]+?)\s*(?:<.*)?)$""")
LIST_POST = re.compile(r"'(?P<name>.+?)'\s+via\s+.+")
MONTHS = {name[:n].lower(): k for k, name in enumerate(calendar.month_name) if k for n in (3, 4, len(name))}
WEEKDAYS = {name[:n].lower() for name in calendar.day_name for n in (2, 3, 4, 5, len(name))}
PIECE = re.compile(
    r"(?P<clock>\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?|(?P<dashed>\d{4}-\d{1,2}-\d{1,2})T?|(?P<slashed>\d{1,2}/\d{1,2}/\d{4})|(?P<dotted>\d{1,2}\.\d{1,2}\.\d{4})"
    r"|(?P<zone>[+-]\d{2}:?\d{2}|\([A-Za-z ]+\)|(?<=\d)Z\b|\b(?:UTC|GMT|[A-Z]{2,3}[SD]?T)\b)|(?P<word>[A-Za-z]+)\.?|(?P<number>\d+)(?:st|nd|rd|th)?|[\s,]+|(?P<other>.)"
)


def invisible(line: str) -> bool:
    return re.fullmatch(rf"{INVISIBLE}*", line) is not None


def display_name(value: str) -> str:
    """The name in an address; that of the poster where a list sent it on."""
    m = ADDRESS.match(value.strip())
    name = ((m["quoted"] or m["plain"]) if m else "").strip()
    via = LIST_POST.match(name)
    return via["name"].strip() if via else name


def iso_time(raw: str) -> str:
    """ISO time of a date in words or numbers, or the trimmed input where it isn't one.

    Day, month and year may stand in any order and need no clock (then midnight);
    weekdays, ``at`` and time zones are passed over, the time is that on the sender's
    clock. Of 3/4/2026 the month is first, unless only the other order is a date.
    """
    date: dict[str, int] = {}
    numbers, clock, half = [], None, None
    for piece in PIECE.finditer(raw):
        kind, text = piece.lastgroup, piece.group(piece.lastgroup) if piece.lastgroup else ""
        word = text.lower()
        if kind == "other" or kind in date or (kind == "clock" and clock):
            return raw.strip()
        if kind == "clock":
            clock = [int(x) for x in text.split(":")]
        elif kind == "dashed":
            date |= zip(("year", "month", "day"), map(int, text.split("-")), strict=True)
        elif kind == "slashed":
            date |= zip(("month", "day", "year"), map(int, text.split("/")), strict=True)
        elif kind == "dotted":
            date |= zip(("day", "month", "year"), map(int, text.split(".")), strict=True)
        elif kind == "number":
            numbers.append(int(text))
        elif kind == "word" and word in MONTHS and "month" not in date:
            date["month"] = MONTHS[word]
        elif kind == "word" and word in ("am", "pm") and clock:
            half = word
        elif kind == "word" and word not in WEEKDAYS and word != "at":
            return raw.strip()
    for number in numbers:
        date.setdefault("year" if number > 31 else "day", number)
    if len(date) < 3 or len(numbers) > 2:
        return raw.strip()
    if date["month"] > 12 >= date["day"]:
        date["month"], date["day"] = date["day"], date["month"]
    hour, *rest = clock or [0, 0]
    if half and hour <= 12:  # a clock of 24 hours may be followed by PM
        hour = hour % 12 + (12 if half == "pm" else 0)
    try:
        return datetime(date["year"], date["month"], date["day"], hour, *rest).isoformat()
    except ValueError:
        return raw.strip()


def mail_spans(text: str) -> list[Span]:
    """Header blocks of quoted messages: a From field with another field close below, read up to its Subject."""
    fields = list(FIELD.finditer(text))
    row = lambda m: text.count("\n", 0, m.start())
    opens = [k for k, m in enumerate(fields) if m["name"] == "From" and re.match(r"\s+\S", m["value"])]
    opens = [k for k in opens if any(f["name"] != "From" and row(f) - row(fields[k]) <= NEAR for f in fields[k + 1 : k + 1 + NEAR])]
    spans = []
    for k, following in zip(opens, [*opens[1:], len(fields)], strict=False):
        block = fields[k + 1 : following]
        subject = next((i for i, f in enumerate(block) if f["name"] == "Subject"), None)
        times = [f["value"].strip() for f in block[:subject] if f["name"] in ("Date", "Sent") and f["value"].strip()]
        last = fields[k] if subject is None else block[subject]
        spans.append(Span(fields[k].start(), last.end(), display_name(fields[k]["value"]), iso_time(times[-1]) if times else None))
    return spans


def top_message(text: str) -> tuple[str | None, str]:
    """(author, body) of what stands above all quoted messages.

    The author is the last line of text before the mark that ends the recipients;
    without a mark, the first line of all. The body starts at the next line of text.
    """
    rows = text.split("\n")
    mark = next((i for i, row in enumerate(rows) if MARK in row), None)
    said = [i for i, row in enumerate(rows) if MARK not in row and not invisible(row)]
    if mark is None:
        author, start = (said[0], next(iter(said[1:]), 0)) if said else (None, 0)
    else:
        author = next((i for i in reversed(said) if i < mark), None)
        start = next((i for i in said if i > mark), len(rows))
    return (None if author is None else rows[author].strip()), "\n".join(rows[start:])


def tidy_body(text: str, dropped: frozenset[str] = frozenset()) -> str:
    rows = [x.rstrip().translate(WIDE_BLANKS) for x in text.split("\n")]
    rows = without_blank_edges([x for x in rows if not dropped or folded(x) not in dropped], invisible)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows))


def folded(line: str) -> str:
    """A line as worklists name it: lower case, blanks squeezed."""
    return " ".join(line.replace(MARK, " ").split()).lower()


def email_chain(text: str, strip: frozenset[str] = frozenset()) -> list[Entry]:
    """Messages of a chain, the oldest first; lines whose folded form is in ``strip`` go."""
    text = after_header(text)
    spans = mail_spans(text)
    author, top = top_message(text[: spans[0].start] if spans else text)
    found = [entry(tidy_body(top, strip), display_name(author))] if author else []
    found += [entry(tidy_body(body, strip), span.author, span.timestamp) for span, body in bodies(text, spans)]
    return found[::-1]


# --- transcripts -----------------------------------------------------------------------------------

TRANSCRIPT = "segments array<struct<start:double,end:double,text:string>>"


def transcript_segments(df: DataFrame, json: str, start: Column) -> DataFrame:
    """One row per spoken segment: index, timestamp, duration, text. Rows that miss a field or have no text go."""
    parsed = df.withColumn("__s", F.from_json(json, TRANSCRIPT)["segments"])
    full = F.filter("__s", lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (F.trim(s["text"]) != ""))
    placed = parsed.select(*df.columns, F.posexplode(full).alias("segment", "__x"))
    at = F.timestamp_millis(F.unix_millis(start) + (F.col("__x.start") * 1000).cast("long"))
    return placed.select(*df.columns, "segment", at.alias("timestamp"), (F.col("__x.end") - F.col("__x.start")).alias("duration"), F.trim("__x.text").alias("segment_text"))


PARSERS: dict[str, Callable[[str], list[Entry]]] = {"whole": whole, "markdown": markdown, "copilot_email": mail_summary, "chat": chat, "email": email_chain}


def script_parser(script: str, timeout: int = 600) -> Callable[[str], list[Entry]]:
    """A parser that runs ``python3 script FILE`` and reads ``{"entries": [{"body": ...}]}``; blank bodies go.

    The file is the standard input, so nothing is written; the script must be
    readable on all executors. A text on which the script fails is an error.
    """

    def parse(text: str) -> list[Entry]:
        done = subprocess.run(["python3", script, "/dev/stdin"], input=text.encode(), capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise ValueError(f"{script}: {done.stderr.decode(errors='replace')[-500:]}")
        told = enumerate(json.loads(done.stdout)["entries"], 1)
        return [entry(e["body"], e.get("author"), e.get("timestamp"), e.get("heading_level"), e.get("heading_title"), (n, n)) for n, e in told if e["body"].strip()]

    return parse


def attempt(df: DataFrame, parser: str | Callable[[str], list[Entry]], text: str = "text") -> DataFrame:
    """``df`` with ``entries`` and ``error``: of a text on which the parser fails only the error is told."""
    function = PARSERS[parser] if isinstance(parser, str) else parser

    @F.pandas_udf(T.StructType([T.StructField("entries", T.ArrayType(ENTRY)), T.StructField("error", T.StringType())]))
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for t in texts:
            try:
                rows.append((function(t) if t else [], None))
            except Exception as e:  # any failure is that of this one text
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["entries", "error"])

    return df.withColumn("__p", parse(F.col(text))).select(*df.columns, "__p.*")


def segment(df: DataFrame, parser: str | Callable[[str], list[Entry]], text: str = "text") -> DataFrame:
    """``df`` with a row per entry: position and the fields of ``ENTRY``. Blank bodies of own parsers go; a null text has none."""
    function = PARSERS[parser] if isinstance(parser, str) else parser

    @F.pandas_udf(T.ArrayType(ENTRY))
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t) if t else [] for t in texts])

    return df.select("*", F.posexplode(parse(F.col(text))).alias("position", "__e")).select(*df.columns, "position", "__e.*")


def email_issues(entries: DataFrame) -> DataFrame:
    """Rows of ``entries`` (author, body, timestamp) with ``issue``: what looks wrong in them."""
    author, body = F.col("author"), F.coalesce(F.col("body"), F.lit(""))
    of_author = (
        F.when(author.isNull() | (author == ""), "null author").when(author.rlike("[<@]"), "email in author").when(F.length(author) > 60, "long author")
        .when(F.length(author) < 2, "short author").when(~author.rlike("[a-zA-Z]"), "non-alpha author")
    )
    of_body = F.when(F.trim(body) == "", "empty body").when(F.length(body) > 5000, "long body")
    of_time = F.when(F.col("timestamp").isNotNull() & ~F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T"), "unparsed timestamp")
    return entries.select("*", F.explode(F.array_compact(F.array(of_author, of_body, of_time))).alias("issue"))


def line_candidates(entries: DataFrame, entry_key: list[str]) -> DataFrame:
    """Normalised body lines with the number of entries that hold them."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\s\x{200B}\x{A0}]+", " ")))
    lines = F.array_distinct(F.transform(F.split("body", "\n"), plain))
    return entries.select(*entry_key, F.explode(lines).alias("line")).filter("line <> ''").groupBy("line").agg(F.count("*").alias("n_entries"))
