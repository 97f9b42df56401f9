"""Queries of the problems tagged llm over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroot.llm import encoding, enrichment, fusion, languages, packing, scans, setjoin, splitting
from tallyroot.llm.oracle import ORACLE
from tallyroot.sources.tables import table
from tallyroot.work import Workspace

__all__ = ["ORACLE", "QUERIES"]


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = fusion.leximin(table(spark, folder, "search_hits"), "search_id", "document_id", "method", "score")
    return ranked.select("search_id", "document_id", "vector", "place")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_ranking(spark, folder).where("place = 1").select("search_id", "document_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_columns(table(spark, folder, "sheet_columns"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_noise(table(spark, folder, "nodes"))[0]


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.paragraphs(table(spark, folder, "nodes"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_nodes(table(spark, folder, "nodes"), table(spark, folder, "token_embeddings"), table(spark, folder, "chunk_limits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_ids(_split(spark, folder))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return enrichment.term_counts(table(spark, folder, "search_term_postings"), source=["index_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "probe_documents").select(F.col("document_id").alias("r"))
    best = enrichment.most_distinctive(enrichment.enrichment(_counts(spark, folder), of=asked))
    return best.select(F.col("r").alias("document_id"), F.col("t").alias("term"))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = enrichment.enrichment(_counts(spark, folder))
    return scores.select(F.col("r").alias("document_id"), F.col("t").alias("term"), F.col("k").alias("freq"), "df", F.round("raw", 5).alias("raw"), F.round("score", 5).alias("score"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encoding.encode_column(docs, "text", "ids", encoding.vocabulary())


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sized = encoding.encode_column(docs, "text", "n_tokens", encoding.vocabulary(), only_counts=True)
    return packing.pack(sized, "doc_id", "n_tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    # A document larger than a container is the only kind that has a second part.
    return p8_packs(spark, folder).where("part = 1").select("doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packs; documents: those with a place, with or without tokens."""
    placed = Workspace(spark, "packs").keep(p8_packs(spark, folder))
    documents = placed.agg(F.count_distinct("doc_id").alias("documents"))
    return packing.pack_report(placed, "doc_id").select("over", "split", "overlapping").crossJoin(documents)  # one row each


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return languages.languages(table(spark, folder, "documents"), table(spark, folder, "lang_codes"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(p9_segments(spark, folder))


QUERIES = {
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_packs": p8_packs,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}
