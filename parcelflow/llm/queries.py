"""The operators over the given tables, as registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chat, decontamination, line_dedup, minhash, negatives, packing, personal, quality, repair, secrets, sharding, sql, toxicity, warc

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Production parameters.
SEQUENCE_TOKENS = 1024
SHARD_BYTES = 8 << 20
CHAIN = ["quality", "toxic"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE_TOKENS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_decontamination", sql.OP2)
def op2(spark, sf_dir):
    found = decontamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_sharding")
def op3(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op4_line_dedup")
def op4(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "n_left")


@query("op5_secret_scan")
def op5(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    shown = F.col("findings")
    live = F.size(F.filter(shown, lambda f: f["verdict"] == "live")).cast("long")
    example = F.size(F.filter(shown, lambda f: f["verdict"] == "example")).cast("long")
    return found.select("doc_id", *[secrets.count_of(shown, k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
                        F.sha2(secrets.listed(secrets.base_findings(shown)), 256).alias("base_sha256"), secrets.listed(shown).alias("spans"),
                        live.alias("n_live"), example.alias("n_example"))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_warc_normaliser", sql.OP7)
def op7(spark, sf_dir):
    read = warc.archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CHAIN)
    return chain.score(docs).select("doc_id", "p_quality", "p_toxic", F.col("rejected").alias("toxic"))


@query("op9_chat_formatting", sql.OP9)
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chats(turns.unionByName(probe))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op10_circulant_minhash", sql.OP10)
def op10(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op11_hard_negatives", sql.OP11)
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = negatives.usable(F.col("embedding"))
    numbers = F.when(usable, negatives.quantized(F.col("embedding")))
    return negatives.mine_hard_negatives(vectors.select("vec_id", label.alias("label"), numbers.alias("embedding")), F.col("vec_id") % 50 == 0)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    mended = repair.repair_conversations(repair.damaged(turns))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    return every.join(mended, every["id"].eqNullSafe(mended["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_personal_data")
def op13(spark, sf_dir):
    found = personal.find_personal_data(table(spark, sf_dir, "documents"))
    shown = F.col("findings")
    return found.select("doc_id", *[personal.count_of(shown, k).alias(f"n_{k}") for k in personal.KINDS],
                        F.sha2(personal.listed(personal.base_findings(shown)), 256).alias("base_sha256"), personal.listed(shown).alias("spans"),
                        personal.count_of(shown, personal.FOUND).alias("n_context"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
