"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, and a mix of sources.

Every stage is a function of `(spark, docs, sf_dir)`; it reads all that its
predecessor kept and returns the columns of `documents`, the last one the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsrisk.llm import decontaminate, language_id, mixing, near_dedup, secrets
from tsrisk.llm.common import free_name, remainder, table
from tsrisk.session import stage, unstage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter, or without text, go. `lang` becomes the predicted one."""
    model = language_id.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language_id.identify(docs, model, tuple(docs.columns)).filter(F.col("lang_pred") != language_id.NONE)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, null ids last.

    Rows that share an id, or have none, are told apart by all their columns; rows repeated in full become one.
    """
    return near_dedup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = free_name(docs, "hits")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), name=hits)
    return found.filter(F.size(hits) == 0).drop(hits)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with text and language beside them; documents it takes nothing of go."""
    mixed = mixing.mix_sources(docs, carry=("lang", "text", "n_chars"))
    return mixed.filter(F.col("taken") > 0).select(
        "doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
]

#: Learned languages, edit distances and compressed sizes are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
