"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, decontam, line_dedup, near_dedup, quality_rules


def _keep(docs: DataFrame, verdicts: DataFrame, **by: Column) -> DataFrame:
    """``docs`` without the rows that have a verdict that is not kept.

    A verdict is of the rows with its doc_id and its values in the columns ``by``, which are given as expressions over ``docs``: rows
    that repeat a doc_id, or have none, stay or go by their own verdict.
    """
    keys = {"doc_id": F.col("doc_id"), **by}
    gone = verdicts.where(~F.col("kept")).select(*[F.col(c).alias(f"_gone_{c}") for c in keys]).distinct()
    same = reduce(and_, (e.eqNullSafe(F.col(f"_gone_{c}")) for c, e in keys.items()))
    # The keys to drop are the small side: one partition of them at a time is hashed, texts are not sorted.
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host fails, go."""
    key = near_dedup.text_key(F.col("text"))
    return _keep(docs, quality_rules.judge(docs.withColumn("_key", key), key="_key"), key=key, host=F.col("source").cast("string"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; documents left without a word go."""
    # The rest of the row goes along as one column, so no column of it meets a name of the operator's.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_documents(docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("row")))
    out = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    row = {c: F.col(c) if c in ("doc_id", "text") else F.col("row")[c] for c in docs.columns}
    cols = dict(row) | {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(row["text"])}
    if "n_chars" in row:  # goes with the text where a text was changed
        cols["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return out.select(*[v.alias(c) for c, v in cols.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return _keep(docs, near_dedup.judge(docs, k=5, percent=80), text_key=near_dedup.text_key(F.col("text"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near-dedup and token stages are beyond SQL; tests/llm hold run() against the five stages in plain Python, on planted cases and on the smallest test tables.
ORACLE_SQL = None
