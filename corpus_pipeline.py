"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes documents (doc_id, text, lang, source, n_chars) and returns rows of the same columns, the
last with ``copy`` beside them. Any column may be null; what a stage does with null and empty texts,
repeated rows and ties is in its docstring; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zonalis.llm import common, decontamination, linededup, mixing, neardup, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines. Null and empty texts, and any of fewer
    words than the rules ask for, go; repeated rows are judged alike and all stay or go."""
    return quality.clean_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of common lines. The first is that of the least doc_id
    (null: least of all), then of the least hash of the text. Repeated rows are one document and treated
    alike; null texts become empty."""
    return linededup.dedup_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), without
    later occurrences of long lines, which are compared once whole copies are gone. The least doc_id stays
    (null: last), then the least hash of the text; rows of one doc_id with unlike texts all stay; texts
    without a word are one group."""
    return linededup.dedup_passages(common.checkpoint(neardup.keep_one(docs)))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; every row is judged by its own
    text; with an empty benchmark all stay."""
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with their copy number. A null source is a source, the last; rows that repeat
    doc_id, source and text are one document, whose copies add up."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("mixing", mix_stage)]

#: Fingerprints, components and tiles are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written and read again, below the shared folder. A stage's files
    go when the next is written; those of the last are what is returned."""
    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{path}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(here), here
    return docs
