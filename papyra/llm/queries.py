"""Queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import spread, stored, table

if TYPE_CHECKING:
    from papyra.llm import language

TOKENIZERS = os.environ.get("PAPYRA_TOKENIZERS", "/opt/tokenizers")


def _fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, language.Profiles]:
    from papyra.llm import language

    profiles, pages = table(spark, sf, "doc_profiles"), spread(table(spark, sf, "ocr_results"))
    return profiles, pages, language.fit_profiles(pages, "document_id", "text", profiles, "language")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import language

    profiles, pages, fitted = _fitted(spark, sf)
    languages = stored(language.document_languages(pages, "document_id", ["ocr_id"], "text", fitted))
    return language.mislabelled(profiles, languages).select("profile_id", "lang").distinct()


def p1_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's languages with confidence."""
    from papyra.llm import language

    _, pages, fitted = _fitted(spark, sf)
    return language.document_languages(pages, "document_id", ["ocr_id"], "text", fitted)


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each stretch of a page's reading in one language, with confidence."""
    from papyra.llm import language

    _, pages, fitted = _fitted(spark, sf)
    return language.segments(pages, ["document_id", "page", "ocr_id"], "text", fitted).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import scanned

    return scanned.Scanned(spread(table(spark, sf, "ocr_results"))).defects()


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import scanned

    return scanned.Scanned(spread(table(spark, sf, "ocr_results"))).repaired()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import splitter

    keys = ["document_id", "id"]
    return splitter.number_pieces(splitter.split_texts(table(spark, sf, "chunk_embeddings"), keys), keys)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that had to be split: those with a second piece in their first range."""
    from papyra.llm import splitter

    pieces = splitter.split_texts(table(spark, sf, "chunk_embeddings"), ["document_id", "id"])
    return pieces.filter("n_range = 0 and in_range = 1").select("id").distinct()


def _redacted(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import pii

    fields, pages = spread(table(spark, sf, "form_fields")), spread(table(spark, sf, "ocr_results"))
    redactor = pii.fit_from(fields)
    parts = [
        pii.personal_spans(fields, ["field_id"], "value", redactor, "label").select(F.lit("form_fields").alias("source_table"), F.col("field_id").alias("row_id"), "redacted", "spans"),
        pii.personal_spans(pages, ["ocr_id"], "text", redactor).select(F.lit("ocr_results").alias("source_table"), F.col("ocr_id").alias("row_id"), "redacted", "spans"),
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(spark, sf).select("source_table", "row_id", F.explode("spans.pii_type").alias("pii_type")).distinct()


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(spark, sf).distinct()


def _both(spark: SparkSession, sf: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    parts = [f(spread(table(spark, sf, name).select("id", "embedding"))).withColumn("collection", F.lit(name)) for name in ("chunk_embeddings", "document_embeddings")]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import neighbours

    return _both(spark, sf, neighbours.similar_pairs).select("collection", "id_a", "id_b")


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import neighbours

    return _both(spark, sf, neighbours.nearest_neighbours).select("collection", "id", "rank", "neighbour", "cosine")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import tokenizer

    return tokenizer.encode(spread(table(spark, sf, "documents")), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import leakage

    return leakage.leaked_items(spread(table(spark, sf, "documents")), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    from papyra.llm import mojibake

    return mojibake.restore(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_restored(spark, sf).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_languages, p1_segments, p2_found, p2_repaired, p3_found, p3_pieces, p4_found, p4_redacted, p6_found, p6_neighbours, p8_ids, p9_found, p10_found, p10_restored)
}
