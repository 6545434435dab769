"""The registered queries opN_<name> of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.llm import chat, clusters, decontamination, exact, infill, language, packing, quality, secrets, sharding, simhash, token_counts, token_files
from cinesieve.llm.oracles import ORACLE_SQL
from cinesieve.llm.shared import staged
from cinesieve.sources.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.read_back(chat.windows(turns.unionByName(probe))))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are, and as a second version those with secrets, masked, against one ledger.

    The second scan adds the blobs of masked texts alone; n_left counts what is still found in a path's second version.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = secrets.RULE_SETS[secrets.VERSION]
    ledger = secrets.Ledger(spark, scratch(spark, "secret-ledger"))
    first = ledger.extend(docs)
    found = staged(secrets.locate(docs, first), "secret-paths")
    masked = staged(secrets.redact(docs, ledger=first, changed=True), "masked")
    left = secrets.locate(masked, ledger.extend(masked)).where(F.size("spans") > 0)
    left = left.groupBy(F.col("path").alias("_path")).agg(F.sum(F.size("spans")).alias("n_left"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))
    of_kind = lambda number: F.filter("spans", lambda s: s["kind"] == number)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)]
    rows = found.join(left, F.col("path").eqNullSafe(F.col("_path")), "left")
    digest = F.sha2(secrets.describe(base, rules), 256).alias("base_sha256")
    return rows.select(F.col("path").alias("doc_id"), *counts, digest, secrets.describe(F.col("spans"), rules).alias("spans"), F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.read(token_files.write(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of ids; of several texts with these ids the figures are those of the best contained pair."""
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))
    best = pairs.agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "share", F.to_json("mixture").alias("mixture"))


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; the policy and its ablation are read off its bits."""
    book = staged(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    mask = quality.POLICIES[quality.POLICY]
    rows = quality.explained(quality.apply_policy(book, mask), mask)
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "fail_bits", "only_rule", "n_kept_without")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(spark, sf_dir, "documents"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_windows, op2_secret_scan, op3_token_counts, op4_feistel_shards, op5_token_files, op6_simhash_components, op7_benchmark_containment, op8_language_mixture, op9_quality_ledger, op10_harmonic_packing, op11_radix_dedup, op12_delta_lloyd, op13_infill)}

__all__ = ["ORACLE_SQL", "QUERIES"]
