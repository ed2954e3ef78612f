"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Language ID drops texts without a letter or without a clear language, line dedup cuts lines that ten documents or
more share, SimHash near-dedup keeps the smallest id of each group, decontamination drops documents that cover a
benchmark item, and mixing samples the rest to the target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import keep, table
from cairn.llm.decontaminate import remove_leaks
from cairn.llm.lang_id import UNKNOWN, fold, identify, train
from cairn.llm.line_dedup import dedup_lines
from cairn.llm.mixing import mix
from cairn.llm.near_dup import keep_one

#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.5
#: Words of a shingle and least similarity of a link in the near-dedup stage.
SHINGLE, SIMILARITY = 5, 0.8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language of at least LEAST_SCORE; rejected documents go."""
    model = train(docs, fold() != 1)
    found = identify(docs.select(*COLUMNS), model, pred="lang_pred_", score="lang_score_")
    return found.where((F.col("lang_pred_") != UNKNOWN) & (F.col("lang_score_") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents or more share; n_chars follows the text."""
    out = dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; rows without an id are compared like any other."""
    return keep_one(docs.select(*COLUMNS), width=SHINGLE, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities; with the topic, tokens and probability of each."""
    out = mix(docs.select(*COLUMNS))
    return out.where("kept").select(*COLUMNS, "topic", "n_tokens", F.round("prob", 6).alias("prob"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("simhash", near_copies), ("decontaminate", decontaminate), ("mix", mixture)]

#: Language ID and SimHash have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
