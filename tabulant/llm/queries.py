"""One query per operator over whole tables, and their SQL where SQL can say it."""

from pyspark.sql import functions as F

import corpus_pipeline
from tabulant.llm import (
    chunks,
    codes,
    decontaminate,
    infill,
    licenses,
    neighbours,
    oracle,
    packing,
    quality,
    shards,
    simhash,
    tokens,
    toxicity,
    urls,
)
from tabulant.sources.tables import table


def op1_license_scan(spark, sf):
    return licenses.license_report(licenses.scan_licenses(table(spark, sf, "documents")))


def op2_token_counts(spark, sf):
    return tokens.token_counts(table(spark, sf, "documents"))


def op3_quality(spark, sf):
    return quality.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_simhash_dedup(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op5_url_filter(spark, sf):
    return urls.judge_urls(table(spark, sf, "pages"))


def op6_decontamination(spark, sf):
    found = decontaminate.benchmark_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.contamination(*found).drop("text_hash")


def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_best_fit_packing(spark, sf):
    return packing.pack(packing.measured(table(spark, sf, "documents")))


def op9_document_fingerprints(spark, sf):
    return chunks.fingerprints(table(spark, sf, "documents"))


def op10_sharding(spark, sf):
    number = 16
    path = shards.write_shards(table(spark, sf, "documents"), shards=number)
    rows = shards.read_shards(spark, path).select(
        F.col("key").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "bucket",
        "pos",
    )
    return shards.with_slots(rows).withColumn("grown_shard", shards.shard_of(F.col("doc_id"), number + 1))


def op11_vector_codes(spark, sf):
    return codes.compress(table(spark, sf, "embeddings"))


def op12_nearest_neighbours(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"))


def op13_fill_in_middle(spark, sf):
    return infill.digests(infill.fill_in_middle(table(spark, sf, "documents")))


QUERIES = [
    op1_license_scan,
    op2_token_counts,
    op3_quality,
    op4_simhash_dedup,
    op5_url_filter,
    op6_decontamination,
    op7_toxicity,
    op8_best_fit_packing,
    op9_document_fingerprints,
    op10_sharding,
    op11_vector_codes,
    op12_nearest_neighbours,
    op13_fill_in_middle,
]


def queries():
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return oracle.statements()
