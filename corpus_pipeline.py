"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of ``documents``.

1. ``quality``: lines that fail the line rules go from a text, documents that the rules reject go.
2. ``near_dedup``: of documents that are linked by a similarity of 0.8 or more of their shingles of five
   words, the one of the smallest id stays.
3. ``substring_dedup``: words of passages of 35 words or more that repeat anywhere go; a text with
   none keeps its form, others become their kept words joined by single spaces. Documents that
   have no word left go.
4. ``secrets``: each secret, also a nested one, gives way to a mark.
5. ``packing``: the pieces of the tokenised documents with their token ids, each with its place in a
   sequence; ``packing.sequences`` joins them to whole sequences.

Defined results of every stage: null texts count as empty (the quality stage rejects them, the others keep a null
text null or give it one end token); ids may be null, repeat, and be of any type that can be ordered; rows that are equal in id
and text stay once (near_dedup) or are rows of their own (other stages); any other columns are handed on as they are, whatever
their names, but ``n_chars``, which is counted anew; texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import common, near, packing, quality, secrets, substring
from notemill.llm.queries import table, tokenizer_path


def _with_text(found: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with a new text, and ``n_chars`` counted anew where it is a column."""
    new = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def _added(docs: DataFrame, *names: str) -> list:
    """The columns that an operator adds under these names."""
    return [F.col(f"`{x}`") for x in common.free_names(docs, *names)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    kept, failed, clean = _added(docs, "kept", "n_failed_lines", "clean_text")
    judged = quality.quality(docs).where(kept)
    return _with_text(judged, docs, F.when(failed > 0, clean).otherwise(F.col("text")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages."""
    words, removed, text = _added(docs, "n_words", "n_removed", "kept_text")
    found = substring.substring_dedup(docs).where((words > removed) | (words == 0))
    return _with_text(found, docs, F.when(removed > 0, text).otherwise(F.col("text")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark for each secret."""
    found = secrets.redact(secrets.secret_scan(docs), spans_col=common.free_name(docs, "secrets"))
    return _with_text(found, docs, F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with token ids and places."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2, keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Similarities, nested encodings and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what stages hand on lies in the shared folder until the next stage
    has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/notemill-pipeline-{uuid.uuid4().hex}-{name}"
        with common.holding(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        common.delete(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), [path]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its tables are written; it doesn't read the documents again
    common.delete(spark, before)
    return packed
