"""Search filters and tag filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Filters:
    author: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    project: str | None = None
    excluded_tags: tuple[str, ...] = field(default=())

    @property
    def any_after_search(self) -> bool:
        return bool(self.author or self.date_from or self.date_to or self.excluded_tags)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def author_like(author: Column, wanted: str) -> Column:
    """Lexical search: a pattern in which % and _ of the user are wildcards; only ASCII case is folded."""
    return ascii_lower(author).like("%" + "".join(ASCII_LOWER[ASCII_UPPER.index(c)] if c in ASCII_UPPER else c for c in wanted).replace("\\", "\\\\") + "%")


def author_contains(author: Column, wanted: str) -> Column:
    """Semantic search: a literal part, case folded in all scripts."""
    return F.contains(F.lower(author), F.lit(wanted.lower()))


def dates(df: DataFrame, filters: Filters, column: str = "clip_date") -> DataFrame:
    """Dates are compared as strings, so a bare day as upper bound leaves out that day's times."""
    if filters.date_from:
        df = df.filter(F.col(column) >= filters.date_from)
    return df.filter(F.col(column) <= filters.date_to) if filters.date_to else df


def without_tags(df: DataFrame, tags: DataFrame, excluded: tuple[str, ...] | list[str], key: str = "document_id") -> DataFrame:
    """Rows whose document has none of the tags."""
    if not excluded:
        return df
    return df.join(tags.filter(F.col("tag").isin(*excluded)).select(F.col("document_id").alias(key)).distinct(), key, "left_anti")


def with_tags(df: DataFrame, tags: DataFrame, wanted: list[str], key: str = "document_id") -> DataFrame:
    """Rows whose document has one of the tags at least."""
    return df.join(tags.filter(F.col("tag").isin(*wanted)).select(F.col("document_id").alias(key)).distinct(), key, "left_semi") if wanted else df


def global_filter(df: DataFrame, tags: DataFrame, include: list[str], exclude: list[str], tag: list[str]) -> DataFrame:
    """Any of ``include``, none of ``exclude``, and any of ``tag`` (a tag with its children)."""
    return with_tags(with_tags(without_tags(df, tags, exclude), tags, include), tags, tag)


def captured(documents: DataFrame) -> DataFrame:
    """Documents that near-duplicate scans look at."""
    return documents.filter(F.col("project").isNull() & (F.col("merge_strategy") != "positional"))
