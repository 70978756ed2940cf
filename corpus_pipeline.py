"""A corpus pipeline of five stages over the operators of ``clipmill.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``docs``. Between stages the rows go through Parquet in the
shared folder, so a stage never computes its predecessors again; those folders
go when the driver ends.

All stages take nulls in any column, texts of any length, rows that repeat, empty
tables and extra columns of any name; what each does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill.llm import line_dedup, mixing, pieces, quality_crf, simhash
from clipmill.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts; it is fitted on labelled documents of this input.

    Null and empty texts score 0 and go. Rows that repeat are each judged alike.
    Without labelled documents all scores are one half and all rows with words stay.
    """
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model).filter(F.col("score") >= quality_crf.CUTOFF).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; their lengths follow.

    Null texts stay null. The copy that stays is that of the smallest id (null
    last); rows that repeat id and text are one text and keep the same lines.
    """
    fresh = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return line_dedup.line_dedup(docs).select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word similarity 0.8, wider than op7's three bits.

    That of the smallest id stays (null last, then by text); null texts and texts
    without words are one group; of rows that repeat exactly one stays.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them.

    A null source is a source of its own. Null and empty texts have no words and
    are taken as often as their source is repeated whole. Rows that repeat are
    taken one by one.
    """
    return mixing.expand(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, checked by decoding them.

    A null text counts as empty and has no pieces; rows that repeat have the same pieces.
    """
    return pieces.round_trip(docs).select("row.doc_id", "row.source", "ids", "n_pieces", "decoded_sha256", "lossless")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("source mixing", mix), ("sentencepiece", encode)]

#: Models, hashes of shingles and sampled pieces can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
