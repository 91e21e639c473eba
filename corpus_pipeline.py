"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's `docs`. All but the last return the columns of documents. `n_chars` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm import decontaminate, langid, lines, mixing, ngram_join
from heatgrid.llm.shared import id_or_least, kept
from heatgrid.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model learns from the rows not held out."""
    docs = columns(docs)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return columns(langid.predict(docs, model).where("not rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller id holds."""
    done = lines.dedup_lines(columns(docs))
    changed = F.col("n_dropped") > 0
    return columns(done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    docs = columns(docs)
    found = ngram_join.jaccard_components(docs)
    # a null id is one document of its own: kept unless its group has another representative
    stays = found.where(F.col("id").eqNullSafe(F.col("component"))).select(id_or_least("id").alias("__doc")).distinct()
    stays = kept(stays).df
    return columns(docs.withColumn("__doc", id_or_least("doc_id")).join(stays, "__doc", "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return columns(decontaminate.decontaminate(columns(docs), table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix_sources(columns(docs))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination), ("mixing", mix)]

#: The fitted classifier and the seeded selection have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        stored = kept(stage(spark, docs, sf_dir))
        if before is not None:
            before.discard()
        docs, before = stored.df, stored
    return STAGES[-1][1](spark, docs, sf_dir)
