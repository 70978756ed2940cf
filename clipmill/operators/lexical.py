"""Prefix search with BM25 over postings."""

from __future__ import annotations

import math
import re
import unicodedata
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import search_tokens
from .filters import Filters, author_like, dates, without_tags

if TYPE_CHECKING:
    from .text_index import TextIndex

# Ranking constants, size of the hit list and of a snippet.
K1, B, IDF_FLOOR, HITS, SNIPPET = 1.2, 0.75, 1e-6, 200, 12


def fold_query(text: str) -> list[str]:
    """Prefix terms of a query; punctuation separates."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return list(dict.fromkeys(re.findall(r"[^\W_]+", plain)))


def postings(chunks: DataFrame, key: str = "chunk_id", body: str = "body") -> DataFrame:
    """(key, term, tf, dl) of all chunks."""
    tokens = chunks.select(key, F.explode(F.array(search_tokens(F.col(body)))).alias("tokens"))
    counted = tokens.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return counted.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def lengths(chunks: DataFrame, key: str = "chunk_id", body: str = "body") -> DataFrame:
    return chunks.select(key, F.size(search_tokens(F.col(body))).alias("dl"))


def prefix_hits(index: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, q, tf, dl): how often completions of each prefix occur in each chunk that has one."""
    any_of = F.lit(False)
    for t in terms:
        any_of = any_of | F.col("term").startswith(t)
    fitting = F.filter(F.array(*[F.struct(F.lit(i).alias("q"), F.col("term").startswith(t).alias("fits")) for i, t in enumerate(terms)]), lambda x: x["fits"])
    rows = index.filter(any_of).select(key, "tf", "dl", F.explode(fitting).alias("x"))
    return rows.groupBy(key, F.col("x.q").alias("q")).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def bm25(index: DataFrame, sizes: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """(key, rank) of chunks that have all prefixes; smaller is better.

    Frequencies count chunks per prefix, not per term; the corpus figures are those
    of all chunks, before any filter. A query without terms has no hits.
    """
    terms = fold_query(query)
    if not terms:
        return sizes.select(key, F.lit(0.0).alias("rank")).limit(0)
    hits = prefix_hits(index, terms, key)
    corpus = sizes.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))
    per_term = hits.groupBy("q").agg(F.count("*").alias("n"))  # a row per query term
    raw = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(per_term), "q").join(F.broadcast(corpus))
    return scored.groupBy(key).agg(F.count("*").alias("found"), (-F.sum(part)).alias("rank")).filter(F.col("found") == len(terms)).select(key, "rank")


def search(chunks: DataFrame, index: DataFrame, sizes: DataFrame, tags: DataFrame, query: str, filters: Filters | None = None, most: int = HITS) -> DataFrame:
    """The best ``most`` hits with their chunk columns; filters apply before the cut."""
    filters = filters or Filters()
    hits = bm25(index, sizes, query).join(chunks, "chunk_id")
    if filters.author:
        hits = hits.filter(author_like(F.col("author"), filters.author))
    if filters.project:
        hits = hits.filter(F.col("project") == filters.project)
    hits = without_tags(dates(hits, filters), tags, filters.excluded_tags)
    return hits.orderBy("rank", "chunk_id").limit(most)


def search_index(chunks: DataFrame, index: TextIndex, tags: DataFrame, query: str, filters: Filters | None = None, most: int = HITS) -> DataFrame:
    """``search`` over a stored index: texts are read for the ``most`` hits alone."""
    filters = filters or Filters()
    shown = chunks.drop("body")
    if filters.author:
        shown = shown.filter(author_like(F.col("author"), filters.author))
    if filters.project:
        shown = shown.filter(F.col("project") == filters.project)
    shown = without_tags(dates(shown, filters), tags, filters.excluded_tags)
    hits = index.search(query, most, shown if filters.project or filters.any_after_search else None)
    ids = [r.chunk_id for r in hits.select("chunk_id").collect()]  # ``most`` at most
    return chunks.filter(F.col("chunk_id").isin(*ids) if ids else F.lit(False)).join(F.broadcast(hits), "chunk_id").orderBy("rank", "chunk_id")


def snippets(hits: DataFrame, query: str, body: str = "body") -> DataFrame:
    """``hits`` with ``snippet``: the twelve tokens with most distinct terms, terms in marks \\x02 \\x03, cuts as \\x01."""
    terms = tuple(fold_query(query))

    def plain(word: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()

    def cut(text: str | None) -> str:
        spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        which = [next((i for i, t in enumerate(terms) if plain(text[a:b]).startswith(t)), -1) for a, b in spans]
        starts = range(max(1, len(spans) - SNIPPET + 1))
        begin = max(starts, key=lambda s: (len({w for w in which[s : s + SNIPPET] if w >= 0}), sum(w >= 0 for w in which[s : s + SNIPPET]), -s), default=0)
        part = list(zip(spans, which, strict=True))[begin : begin + SNIPPET]
        if not part:
            return text or ""
        out, at = [], part[0][0][0] if begin else 0
        for (a, b), w in part:
            out += [text[at:a], f"\x02{text[a:b]}\x03" if w >= 0 else text[a:b]]
            at = b
        whole = begin + SNIPPET >= len(spans)
        return ("\x01" if begin else "") + "".join(out) + (text[at:] if whole else "\x01")

    @F.pandas_udf(T.StringType())
    def make(bodies: pd.Series) -> pd.Series:
        return pd.Series([cut(b) for b in bodies])

    return hits.withColumn("snippet", make(F.col(body)))


def idf(n_all: int, n: int) -> float:
    raw = math.log((n_all - n + 0.5) / (n + 0.5))
    return raw if raw > 0 else IDF_FLOOR
