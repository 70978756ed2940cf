"""Overlapping chunks of a text, snapped to sentence ends.

Windows have a closed form, so the word windows are plain expressions; offsets
count UTF-8 bytes of the trimmed text and snapping looks at byte distances, which
an Arrow UDF does with sorted arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim, words

# Sizes in words and bytes.
FOCUS, STRIDE, WHOLE, SNAP = 300, 100, 400, 500
BACK = FOCUS // 3
PART = 1 << 22  # characters of chunks that a batch holds
CHUNK = pa.schema([("chunk_index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("body", pa.string())])
CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("body", T.StringType())]))
WORD, STOP, GAP = re.compile(r"\S+"), re.compile(r"[.!?](?=\s|\Z)"), re.compile(rb"\n(?=[ \t\r\x0c]*(\n))")


def windows(n: Column) -> Column:
    """Array of (chunk_index, first_word, end_word) for a text of n words; none for none."""
    many = F.transform(
        F.sequence(F.lit(0), F.ceil((n - FOCUS) / STRIDE).cast("int") - 1),
        lambda i: F.struct(
            i.alias("chunk_index"),
            F.greatest(i * STRIDE - BACK, F.lit(0)).alias("first_word"),
            F.when(i == F.ceil((n - FOCUS) / STRIDE).cast("int") - 1, n).otherwise(F.least(i * STRIDE + FOCUS, n)).alias("end_word"),
        ),
    )
    one = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("first_word"), n.alias("end_word")))
    return F.when(n == 0, F.slice(one, 1, 0)).when(n <= WHOLE, one).otherwise(many)


def word_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per window of each text, before snapping."""
    counted = df.withColumn("n_words", F.size(words(F.coalesce(F.col(text), F.lit("")))))
    return counted.select("*", F.inline(windows(F.col("n_words"))))


def boundaries(text: str) -> np.ndarray:
    """Byte offsets of sentence ends, of ends of blank lines, of start and end; sorted and distinct."""
    raw = text.encode()
    at = {0, len(raw)} | {m.start(1) + 1 for m in GAP.finditer(raw)}
    if len(raw) == len(text):
        at |= {m.end() for m in STOP.finditer(text)}
    else:
        offset = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        at |= {int(offset[m.end()]) for m in STOP.finditer(text)}
    return np.array(sorted(at), np.int64)


def snapped(ends: np.ndarray, at: int, earlier: bool) -> int:
    """The nearest boundary within reach, or the place itself; of two as near, the earlier or the later."""
    k = int(np.searchsorted(ends, at))
    near = [int(e) for e in ends[max(k - 1, 0) : k + 1] if abs(int(e) - at) <= SNAP]
    return min(near, key=lambda e: (abs(e - at), e if earlier else -e), default=at)


def chunks_of(text: str | None) -> list[dict]:
    """Chunks of one text as (chunk_index, start_char, end_char, body)."""
    text = (text or "").strip()
    spans = [m.span() for m in WORD.finditer(text)]
    raw, n = text.encode(), len(spans)
    if not n:
        return []
    if n <= WHOLE:
        return [{"chunk_index": 0, "start_char": 0, "end_char": len(raw), "body": text}]
    offset = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if len(raw) != len(text) else np.arange(len(text) + 1)
    ends, out = boundaries(text), []
    count = -(-(n - FOCUS) // STRIDE)
    for i in range(count):
        first, stop = max(STRIDE * i - BACK, 0), min(STRIDE * i + FOCUS, n)
        begin = int(offset[spans[first][0]])
        end = len(raw) if stop >= n else int(offset[spans[stop][0]])
        begin = min(begin, snapped(ends, begin, True))
        end = min(max(end, snapped(ends, end, False)), len(raw))
        body = raw[begin:end].decode().strip()
        if i == count - 1 and end < len(raw):  # the last one takes what is left, as it is
            end, body = len(raw), raw[begin:].decode()
        out.append({"chunk_index": i, "start_char": begin, "end_char": end, "body": body})
    return out


def chunks_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., text) with their chunks in place of the text, sent on every ``PART`` bytes: chunks overlap, so they are three times the text."""
    for batch in batches:
        at, held, rows = 0, 0, []
        rest, texts = batch.select(batch.schema.names[:-1]), batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            found = chunks_of(texts[i].as_py())
            rows.append(found)
            held += sum(len(c["body"]) for c in found)
            if held >= PART or i + 1 == batch.num_rows:
                counts = [len(x) for x in rows]
                kept = rest.slice(at, len(rows)).take(pa.array(np.repeat(np.arange(len(rows)), counts)))
                made = pa.Table.from_pylist([c for x in rows for c in x], CHUNK)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(made.column(c).combine_chunks() for c in CHUNK.names)], [*kept.schema.names, *CHUNK.names])
                at, held, rows = i + 1, 0, []


def chunked(df: DataFrame, text: str = "body") -> DataFrame:
    """One row per chunk of each row; rows without words give none. A column ``body`` gives way to the chunks'."""
    rest = df.select(*[c for c in df.columns if c != "body"]) if text == "body" else df
    kinds = T.StructType([*rest.schema.fields, *CHUNKS.elementType.fields])
    return df.select(*rest.columns, F.col(text).alias("__text")).mapInArrow(chunks_in_parts, kinds)


def sentence_count(c: Column) -> Column:
    """Sentence ends of the trimmed text: marks that white space or the end follows."""
    return F.regexp_count(trim(c), F.lit(r"(?U)[.!?](?=\s|\z)"))
