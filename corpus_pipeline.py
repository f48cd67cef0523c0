"""A training corpus from documents: five operators, one after another, each on all that its
predecessor kept. Every stage is written as Parquet and read again, so a lost executor costs
one stage's tasks at most. Stages take empty tables, and keep the columns of their input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import bpe, decontam, linededup, quality, resemblance
from siftmill.llm.queries import learned, table
from siftmill.llm.shared import bounded_batches, discard, shared_folder, swept


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null or empty text is judged as an empty one;
    repeated rows share their fate; without labels, or without documents, all stay. Texts of any length are
    judged whole."""
    bounded_batches(spark)
    return quality.keep_good(docs, learned(table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of 50 or more words; n_chars follows the text. A
    document that consists of such repeats goes. Rows with a null id or text stay as they are; of
    equal runs the one of the smallest id stays."""
    found = linededup.keep_new_lines(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: five-word shingles,
    a similarity of 0.8 or more. op1's fingerprints propose, whole sets of shingles decide. Texts
    without words are one group; rows with a null id stay, and so do rows that repeat the id that stays."""
    return resemblance.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't overlap with the benchmark; those with a null id or text stay. Texts of any length are
    searched whole; without items, or without documents, nothing changes. Repeated rows share their fate."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of them and of the bytes that they decode to; none for a null
    or empty text. Repeated rows each keep a row."""
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: SQL can't express the classifier; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. What a stage stored for itself, and what it read, is deleted when
    its result is written."""
    docs, older = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        with swept(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if older:
            discard(spark, older)
        older = path
    return docs
