"""The corpus pipeline: reject poor documents, keep one of each near-duplicate group, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, pii, quality
from tessera.llm.common import fresh, if_small, stored, table
from tessera.llm.vocab import BYTE_BPE, tokenizer_path

#: Scores below this are rejected; near duplicates share five-word shingles with this similarity in percent.
LEAST_SCORE, WORDS, PERCENT = 0.5, 5, 80
END_ID = 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of LEAST_SCORE or more, with all their columns.

    A null or empty text has a score like any other, and rows with a null doc_id are scored by their text alone; repeated
    rows stay or go together. Only rows with a label, and none held out, are learned from; an empty table stays empty.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(quality.training_rows(table(spark, sf_dir, "labels")), "doc_id")
    stats = stored(quality.document_statistics(known, ["label"]), "statistics")
    return quality.keep_good(docs, quality.fit(stats), LEAST_SCORE)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, with all its columns.

    Rows with a null doc_id, and null, empty or blank texts, which are near nothing, stay. Rows that repeat a doc_id stay or
    go together: they go if the doc_id isn't the smallest of a group that any of them is in. An empty table stays empty.
    """
    found = ngram_join.jaccard_components(docs, WORDS, PERCENT)
    (key,) = fresh(docs, "dropped_id")
    dropped = stored(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(key)).distinct(), "dropped")
    return docs.join(if_small(dropped), F.col("doc_id").cast("long") == F.col(key), "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns, personal data and secrets replaced by their kind in brackets and n_chars counted anew.

    Null and empty texts stay as they are, repeated rows are redacted alike, columns called spans or the like are the
    caller's and stay; of spans that overlap, the first gives the kind. An empty table stays empty.
    """
    base, spans = fresh(docs, "base_spans", "spans")
    found = pii.find_spans(docs, "text", base, spans)
    out = found.withColumn("text", pii.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each time; other columns of docs are left out; an
    empty table gives no rows.
    """
    pieces = packing.cut_documents(docs, tokenizer_path(BYTE_BPE), END_ID)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_duplicates", duplicates_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Features of learned models, token ids and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
