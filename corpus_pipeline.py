"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last keep the columns of
their input.

    language      documents without a letter, or like no learned language, go
    exact_dedup   of equal texts one stays
    near_dedup    of each group of near duplicates one stays
    secrets       secrets in texts are masked; no document goes
    packing       documents are cut into pieces and packed into sequences

Nulls, empty texts, ties, repeated rows, empty tables and further columns are
treated as the operators say; a further column may have any name, and none is
changed but text and n_chars where a secret is masked.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import dedup_index, language_id, ngram_join, packing, secret_scan
from tracewright.llm.common import free_names, small_batches, table, written
from tracewright.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; a cosine of 0 or less is no language."""
    small_batches(spark)  # the result is lazy and holds whole texts: stays so in this session
    known = language_id.learn(docs.filter(~language_id.held_out()))
    lang, score = free_names(docs, "_lang", "_score")
    judged = language_id.identify(docs, known, lang_pred=lang, score=score)
    if not known:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return judged.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) > 0)).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_index.keep_new(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit(secret_scan.planted_findings(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of a session whose executors have grown: its workers take less memory and more time than op7's."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), as_loaded=True, slice_bytes=1 << 20, cache_words=75_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", pack)]

#: SQL can express neither the language profiles nor the forest; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
