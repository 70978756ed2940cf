"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import exact_dedup, line_dedup, media, mixing, pieces, pii, quality_crf, resample, sharding, simhash, url_filter, vector_codes, warc
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(spread(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return thinned.select("row.doc_id", "n_lines", "n_deleted", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.score(docs, model)
    return scored.select("row.doc_id", quality_crf.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= quality_crf.CUTOFF).cast("int").alias("predicted"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return both.select("row.doc_id", "ids", "n_pieces", "decoded_sha256", "lossless")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_media": op3_media,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_pieces": op10_pieces,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_resampling": resample.ORACLE,
}
