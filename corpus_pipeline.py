"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID, line dedup, n-gram Jaccard join, mixing sources to target weights, best-fit packing. Several stages have no SQL
form (compression, SimHash, MinHash, tokens), so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import langid, lines, mixing, ngrams, packing
from watchloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", lines.stage),
    ("ngram_join", ngrams.stage),
    ("source_mix", mixing.stage),
    ("best_fit", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
