"""The registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import alignment, binary_packing, bpe, licenses, packing, pii, quality, shards, simhash, suffixes, toxicity, vectors
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.read_digests(shards.write_tokens(table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digests(bpe.encode(F.col("text"))).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = pii.listed(F.concat("base_spans", "extra_spans")).alias("spans")
    return marked.select("doc_id", *_base_columns(), spans)


def _base_columns() -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*[count(k) for k in pii.BASE], F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256")]


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_pii that SQL can state."""
    marked = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", *_base_columns(), pii.listed(F.col("base_spans")).alias("base_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = binary_packing.decompose(table(spark, sf_dir, "documents"))
    length = F.col("length").cast("long").alias("length")
    return got.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_vectors": op8_vectors,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_binary_packing": op12_binary_packing,
    "pii_base_spans": pii_base_spans,
}
