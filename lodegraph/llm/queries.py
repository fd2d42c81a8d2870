"""The subpackage's queries with production parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, jpeg, linededup, mixing, pii, quality, simhash, toxicity, urls
from .queries_sql import ORACLES

#: The rank file of the encoding query; a parameter, never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: (verdict, host and path) of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.round_trip(documents(spark, sf_dir))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = pii.joined(F.filter("found", lambda s: s["kind_order"] < len(pii.BASE)))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(base, 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no list of keys. In its place stand, as if they had been reported, the (host, path) of the pages
    whose id is divisible by 100."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    reported = pages.where("page_id % 100 = 0").select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    return urls.judge(pages, URL_RULES, reported)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN, ids=False, digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
