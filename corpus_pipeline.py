"""The corpus pipeline: quality rules, near-duplicate removal, secret scans,
mixing to target weights, and BPE encoding with a check of its decoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes what
a stage returns as Parquet to the shared folder and reads it again for the next
one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrows.llm.bpe import bpe_encode
from loomrows.llm.common import Kept, read
from loomrows.llm.mixing import mix
from loomrows.llm.neardup import deduplicated
from loomrows.llm.quality import judged
from loomrows.llm.queries import tokenizer
from loomrows.llm.secret_scan import redacted

#: SQL can't express the model-based stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a safe cutoff go."""
    return judged(docs, read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, 0.8)."""
    return deduplicated(docs, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows."""
    clean = redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the shards."""
    return mix(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the length of the text decoded from them."""
    encoded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("word_bpe_49k.json"), decode=True)
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.char_length("decoded").cast("long").alias("decoded_chars"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", source_mix), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        kept = Kept(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
