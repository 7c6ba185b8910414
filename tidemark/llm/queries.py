"""One query per operator over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (block_knn, decontam, embed_dedup, license_scan, merkle, oracle_sql, packing, prefix_trie,
                          sharding, simhash, suffix_dedup, token_files, toxicity, warc)
from tidemark.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pages have no capture time; the page number stands for it.
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", (F.lit(1_704_067_200) + F.pmod(F.col("page_id"), F.lit(10 ** 9))).alias("captured"))
    return warc.archive(pages, time_col="captured").select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op6_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, presented=shown).withColumnRenamed("id", "doc_id")


def op12_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_license": op2_license,
    "op3_winnowing": op3_winnowing,
    "op4_warc": op4_warc,
    "op5_suffix_array": op5_suffix_array,
    "op6_pigeonhole": op6_pigeonhole,
    "op7_length_buckets": op7_length_buckets,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit": op9_best_fit,
    "op10_repair": op10_repair,
    "op11_merkle": op11_merkle,
    "op12_block_knn": op12_block_knn,
    "op13_prefix_trie": op13_prefix_trie,
}

# The others are not SQL (XXH64 with a seed, byte positions, learned weights,
# packings, a tokenizer): tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_license": oracle_sql.OP2,
    "op3_winnowing": oracle_sql.OP3,
    "op4_warc": oracle_sql.OP4,
    "op6_pigeonhole": oracle_sql.OP6,
    "op11_merkle": oracle_sql.OP11,
    "op12_block_knn": oracle_sql.OP12,
    "op13_prefix_trie": oracle_sql.OP13,
}
