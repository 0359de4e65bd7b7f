"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsrisk.llm import (
    decontaminate, html_text, language_id, lm_scoring, mixing, near_dedup, pii, ranked_search, secrets, suffix_dedup,
    token_counts, topk, whitening,
)
from tsrisk.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language_id.identify(docs, model)
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _spans_of(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in base], F.sha2(_joined(own), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans_of(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hits = found.select("doc_id", F.explode("hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", F.col("hit.distance").cast("long").alias("distance"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(name for name, kind in pii.KINDS.items() if kind.base)
    return _spans_of(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")), base)


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)
    held_out = remainder(F.col("doc_id"), 10) == 0
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
