"""A corpus from raw documents to token ids: rejected documents go, then repeated lines, then near copies; what is left
is mixed to source weights and encoded. Each stage works on all that the one before it kept."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahifa.cluster import materialize
from sahifa.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from sahifa.llm.arrow import field, map_slices

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and that the weighed rules call good."""
    return quality_rules.filter_quality(docs)


def keep_one_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay elsewhere; documents of such lines only go. ``n_chars`` follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest identifier."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifier, source, number of tokens, ids, and the digest of what the ids decode to."""
    import public_tokenizers

    spec = bpe.spread(docs, public_tokenizers.path("word_bpe_49k.json"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]

    def run(batch):
        tokenizer = bpe.tokenizer_of(spec)
        ids = [tokenizer.encode(text) for text in batch.column(2).to_pylist()]
        digests = [hashlib.sha256(tokenizer.decode(i).encode()).hexdigest() for i in ids]
        return {"doc_id": batch.column(0), "source": batch.column(1), "n_tokens": list(map(len, ids)), "ids": ids, "decoded_sha256": digests}

    return map_slices(docs.select("doc_id", "source", "text"), run, T.StructType([field(docs, "doc_id"), field(docs, "source"), *fields]))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", keep_one_line),
    ("ngram_jaccard_join", keep_one_copy),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Weighing rules, fuzzy lines and encoding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
