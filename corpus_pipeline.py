"""A corpus from ``documents`` to packed sequences, in five stages; each is written as Parquet and read again as the next one's input.

A stage's result must be written before the next stage is called: what a stage wrote for itself is deleted then. All stages take null ids and
texts (no words, never rejected, kept; packed as one token), empty and long texts, repeated rows (judged alike; near-duplicate removal keeps
one), empty tables (give empty tables) and further columns of any name (kept as they are, but for the packed pieces).
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import decontamination, line_dedup, minhash, packing, toxicity
from parcelflow.llm.queries import CHAIN, SEQUENCE_TOKENS, table, vocabulary
from parcelflow.llm.rows import free_name, split_likely, text_key
from parcelflow.session import materialize, release, release_paths, scratch_scope

#: What the last stage wrote for itself, by application.
_spent: dict[str, list[str]] = {}


def stage(fn: Callable) -> Callable:
    """A stage: when it begins, the result of the one before is written, so that one's own scratch data goes."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release_paths(spark, _spent.pop(app, []))
        with scratch_scope() as paths:
            out = fn(spark, docs, sf_dir)
        _spent[app] = paths
        return out
    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. Equal texts are judged alike."""
    chain = toxicity.fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CHAIN)
    return docs.where(~chain.rejects(docs["text"]))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate across sites; one of which no word is left goes. Only texts that change are joined."""
    its_id, its_text, key = (free_name(docs, n) for n in ("its_id", "its_text", "key"))
    clean = line_dedup.dedup_lines(docs).where("n_removed > 0").select(
        F.col("doc_id").alias(its_id), F.col("key").alias("k"), F.col("text").alias(its_text), F.col("key.a").alias(key))
    clean = materialize(clean.distinct(), "clean")
    maybe, others = split_likely(docs.withColumn(key, text_key(docs["text"])["a"]), key, clean)
    found = clean.toDF(its_id, "k", its_text, "a")
    new = maybe.join(found, maybe["doc_id"].eqNullSafe(found[its_id]) & (text_key(maybe["text"]) == found["k"]), "left").where(
        F.col(its_text).isNull() | F.col(its_text).rlike(r"\S"))
    changed = F.col(its_text).isNotNull()
    new = new.select(*[F.when(changed, F.col(its_text)).otherwise(maybe["text"]).alias("text") if c == "text" else F.when(changed, F.length(its_text)).otherwise(
        maybe["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else maybe[c] for c in docs.columns])
    return others.select(*docs.columns).unionByName(new)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their sequences."""
    return packing.pack_documents(docs, vocabulary(), SEQUENCE_TOKENS)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: Not for SQL: a classifier, MinHash and a tokenizer. tests/llm holds the operators and the stage line_dedup against plain versions, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        made = materialize(apply(spark, docs, sf_dir), name)
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
