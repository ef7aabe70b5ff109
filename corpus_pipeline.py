"""The training-data pipeline: language, repeated lines, near copies, benchmark leaks, packing.

Each stage reads the Parquet that its predecessor wrote, so a lost executor costs tasks, never a stage. What a stage cut
and what its predecessor wrote are deleted once its own output is written.

Defined cases: empty ``documents`` or an empty benchmark give no rows or lose none; null and empty texts have no language
and go in the first stage, texts that lose all their lines stay, empty, as near copies of each other; rows that repeat
are near copies, of which one stays; of a group the smallest doc_id stays; very long texts pass whole; columns besides
those of ``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordkeep.llm import decontam, language_id, line_dedup, packing, simhash
from recordkeep.llm.tables import table
from recordkeep.plans.lineage import delete, scratch, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts show their language; ``lang`` becomes that language."""
    return language_id.accepted(docs, language_id.fit_text_model(docs), language_id.LEAST)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold go, but for the document with the smallest id."""
    out = line_dedup.line_dedup(docs).drop("n_lines", "n_dropped")
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_per_group(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the training sequences that they are packed into."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("sequences", sequences)]

#: SQL has no XXH64 with a seed, no singular vectors and no best fit; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/recordkeep/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
