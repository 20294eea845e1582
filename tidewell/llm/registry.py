"""Registered queries of the language-model operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, languages, mixing, pii, runs, spam_pages, truncation, turns
from tidewell.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_items(table(spark, folder, "bookmark"))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact_texts(table(spark, folder, "bookmark"))


def _posts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "bookmark"), table(spark, folder, "lang_samples")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.unlabelled_languages(*_posts(spark, folder))


def p4_documents(spark: SparkSession, folder: str) -> DataFrame:
    return languages.document_languages(*_posts(spark, folder))


def p4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.passages(*_posts(spark, folder))


def _transcripts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "transcript_segments"), table(spark, folder, "speakers")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_values(table(spark, folder, "bookmark"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_report(table(spark, folder, "bookmark"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.repeated_runs(*_transcripts(spark, folder))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_runs(*_transcripts(spark, folder))


def p5_close(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose cues follow each other within ten seconds."""
    return runs.collapse_runs(*_transcripts(spark, folder), max_gap_s=10.0)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns.speaker_turns(*_transcripts(spark, folder)).select("source_id", "first_pos", "last_pos", "speaker_no")


def p7_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turn_texts(*_transcripts(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages.spam_pages(table(spark, folder, "documents"))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages.page_labels(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_documents": p4_documents, "p4_passages": p4_passages, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p5_close": p5_close, "p7_found": p7_found, "p7_turns": p7_turns, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found, "p10_labels": p10_labels}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
