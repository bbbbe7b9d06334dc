"""Training corpus pipeline: quality, near duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage
returns is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import jaccard_join, packing, pfair_mix, pii, queries, weak_quality
from framelake.llm.shared import stored

#: Near duplicates share 0.8 of their five-word shingles.
NEAR_DUPLICATES = jaccard_join.Shingles(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return weak_quality.reject_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates."""
    return jaccard_join.keep_one_of_each(docs, NEAR_DUPLICATES)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates and addresses; n_chars follows the new text."""
    changed = pii.pseudonymize(docs, queries.pii_key()).withColumn("n_chars", F.when(F.col("pii_count") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the sources are to be read."""
    sizes = pfair_mix.source_sizes(docs)
    return pfair_mix.in_mixed_order(docs, pfair_mix.root_weights(sizes), sizes)


#: Sequences are packed from so many consecutive slots of the mix.
WINDOW_SLOTS = 1


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed in sequences of 1024 tokens, which are numbered in the order of the mix.

    The order is that in which the mix was stored, and documents that were
    not mixed are mixed and stored first.
    """
    mixed, block = pfair_mix.stored_mix(docs.select("doc_id", "source", "text"), "mixed")
    read, slots = pfair_mix.stored_slots(mixed, block)
    pieces = packing.tokenize(read, queries.document_vocabulary(), along=("mix_file", "mix_row")).join(slots, ["mix_file", "mix_row"])
    windowed = pieces.withColumn("mix_window", F.expr(f"mix_slot div {WINDOW_SLOTS}"))
    return packing.pack_in_order(windowed, "mix_window", ["mix_file", "mix_row"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pseudonyms), ("mix", mix), ("pack", pack)]

#: No stage of these is plain SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
