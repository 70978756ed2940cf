"""Clip files and project folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_like_mail_summary, looks_like_markdown, normalize_to_ascii
from .config import BUILT_IN, DocType, Rule

HEADER = "# source:"
STAMPS = ("yyyyMMdd_HH-mm-ss", "yyyyMMdd_HHmmss")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, or null where they aren't."""
    return F.try_validate_utf8(content.cast("string"))


def read_clips(spark: SparkSession, folder: str) -> DataFrame:
    """path and whole text of all .txt and .md files right in a folder; null text where a file isn't UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    return files.select("path", decoded(F.col("content")).alias("raw"))


def walk_project(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, text and content_hash of all files below a root; names that begin with a dot and files that aren't UTF-8 are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    clean = "/" + root.split("://")[-1].strip("/") + "/"
    rel = files.withColumn("relative_path", F.substr(inner, F.instr(inner, clean) + len(clean)))
    kept = rel.filter(~F.col("relative_path").rlike(r"(?:^|/)\."))
    return kept.select("relative_path", decoded(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash")).filter("text IS NOT NULL")


def source_header(raw: Column) -> Column:
    """The title of the first line, or null where that is no header."""
    first = F.substring_index(raw, "\n", 1)
    return F.when(first.startswith(HEADER), F.trim(F.regexp_replace(F.substr(first, F.lit(len(HEADER) + 1)), "\r$", "")))


def without_header(raw: Column) -> Column:
    rest = F.when(raw.contains("\n"), F.substr(raw, F.instr(raw, "\n") + 1)).otherwise("")
    return F.when(raw.startswith(HEADER), rest).otherwise(raw)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clip_date(path: Column) -> Column:
    """The time that a file's name tells, as a timestamp without zone, or null."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    found = [F.when(stem.rlike(p), F.try_to_timestamp(stem, F.lit(f)).cast("timestamp_ntz")) for p, f in zip((r"^\d{8}_\d{2}-\d{2}-\d{2}$", r"^\d{8}_\d{6}$"), STAMPS, strict=True)]
    return F.coalesce(*found)


def by_title(title: Column, extension: Column, types: tuple[DocType, ...] = BUILT_IN) -> Column:
    """Name of the first type whose pattern finds the title or whose extension fits, or null."""
    hit = lambda t: (title.rlike(t.source_pattern) if t.source_pattern else F.lit(False)) | (extension == t.extension if t.extension else F.lit(False))
    return F.coalesce(*[F.when(hit(t), t.name) for t in types], F.lit(None).cast("string"))


def detect(title: Column, extension: Column, body: Column, types: tuple[DocType, ...] = BUILT_IN) -> Column:
    """By title or extension, else by content: mail summaries, then Markdown, else null."""
    first = lambda parser, default: next((t.name for t in types if t.parser == parser), default)
    sniffed = F.when(looks_like_mail_summary(body), first("copilot_email", "copilot_email")).when(looks_like_markdown(body), first("markdown", "markdown"))
    return F.coalesce(by_title(title, extension, types), sniffed)


def type_option(doctype: Column, option: str, types: tuple[DocType, ...] = BUILT_IN) -> Column:
    """An option of the named type; that of a plain document for null."""
    value = F.lit(getattr(DocType("plain"), option))
    for t in types:
        value = F.when(doctype == t.name, F.lit(getattr(t, option))).otherwise(value)
    return value


def described(clips: DataFrame, types: tuple[DocType, ...] = BUILT_IN, now: str | None = None) -> DataFrame:
    """Clips (path, raw) with source_title, text, clip_date, its source, doctype, parser, merge_strategy and preprocessor; skipped types go."""
    at = clip_date(F.col("path"))
    fallback = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
    rows = clips.select(
        "path",
        F.coalesce(source_header(F.col("raw")), F.col("path")).alias("title"),
        without_header(F.col("raw")).alias("text"),
        F.date_format(F.coalesce(at, fallback), "yyyy-MM-dd HH:mm:ss").alias("clip_date"),
        F.when(at.isNull(), "ingest_fallback").otherwise("filename").alias("clip_date_source"),
    )
    extension = F.regexp_extract("path", r"\.([^./]*)$", 1)
    typed = rows.withColumn("doctype_name", detect(F.col("title"), extension, F.col("text"), types))
    types = types + tuple(t for t in BUILT_IN if t.name in ("copilot_email", "markdown") and t.name not in {x.name for x in types})  # what sniffing falls back on
    kept = typed.filter(~type_option(F.col("doctype_name"), "skip", types))
    return kept.select(
        "path", normalize_to_ascii(F.col("title")).alias("source_title"), "text", "clip_date", "clip_date_source", "doctype_name",
        type_option(F.col("doctype_name"), "parser", types).alias("parser"), type_option(F.col("doctype_name"), "merge_strategy", types).alias("merge_strategy"),
        type_option(F.col("doctype_name"), "preprocessor", types).cast("string").alias("preprocessor"),
    )


def unseen(clips: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Clips whose path no document has yet."""
    return clips if force else clips.join(documents.select(F.col("origin_path").alias("path")).filter("path IS NOT NULL").distinct(), "path", "left_anti")


def manifest_match(relative_path: Column, rules: tuple[Rule, ...], value: str = "status") -> Column:
    """``status``, ``role`` or ``glob`` of the first rule that fits a path, else null."""
    return F.coalesce(*[F.when(relative_path.rlike(r.pattern), F.lit(getattr(r, value))) for r in rules], F.lit(None).cast("string"))
