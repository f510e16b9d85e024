"""Whole documents: Markdown, JSON, summaries, the view for embedding, normalised tables and imports.

A document row has doc_id, file_name, text, images ARRAY<STRING>, tables ARRAY<STRUCT<columns ARRAY<STRING>, data
ARRAY<ARRAY<STRING>>, confidence DOUBLE>>, forms ARRAY<STRUCT<type, text, page, bbox ARRAY<DOUBLE>>>, handwritten
ARRAY<STRING>. Null and empty parts are left out of every output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import json_text, paragraphs


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def format_table(columns: Column, data: Column) -> Column:
    """A Markdown table; rows are cut or filled to the width of the header, nulls are empty, bars are not escaped."""
    width = F.size(columns)
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    rule = F.transform(columns, lambda _: F.lit("---"))
    lines = F.concat(F.array(_row(columns), _row(rule)), F.transform(data, lambda r: _row(fit(r))))
    return F.when((F.coalesce(F.size(data), F.lit(0)) == 0) | (width == 0), F.lit("*Empty table*")).otherwise(F.array_join(lines, "\n"))


def numbered_columns(width: Column) -> Column:
    """Headers for tables of plain rows: ``Column 1`` and so on."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column "), i.cast("string")))


def format_form_element(f: Column) -> Column:
    box = F.format_string("Position: (%.2f, %.2f, %.2f, %.2f)", *[F.get(f["bbox"], i) for i in range(4)])
    parts = F.array(
        F.concat(F.lit("Type: "), F.coalesce(f["type"], F.lit("unknown"))), F.concat(F.lit("Text: "), F.nullif(f["text"], F.lit(""))), F.concat(F.lit("Page: "), f["page"].cast("string")), F.when(F.size(f["bbox"]) == 4, box),
    )
    return F.concat(F.lit("- "), F.array_join(F.array_compact(parts), ", "))


def markdown(d: DataFrame, images: bool = True, tables: bool = True, forms: bool = True, handwritten: bool = True) -> DataFrame:
    """(doc_id, markdown): sections in fixed order: title, content, images, tables, form elements, handwritten content."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    sections = [F.concat(F.lit("# "), F.coalesce("file_name", F.lit("Document"))), F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit("## Content\n\n"), paragraphs(F.col("text"))))]
    if images:
        sections.append(F.when(some("images"), F.concat(F.lit("## Images\n\n"), F.array_join(F.transform("images", lambda x, i: F.concat(F.lit("![Image "), (i + 1).cast("string"), F.lit("]("), x, F.lit(")"))), "\n"))))
    if tables:
        sections.append(F.when(some("tables"), F.concat(F.lit("## Tables\n\n"), F.array_join(F.transform("tables", lambda t, i: F.concat(F.lit("### Table "), (i + 1).cast("string"), F.lit("\n\n"), format_table(t["columns"], t["data"]))), "\n\n"))))
    if forms:
        sections.append(F.when(some("forms"), F.concat(F.lit("## Form Elements\n\n"), F.array_join(F.transform("forms", format_form_element), "\n"))))
    if handwritten:
        sections.append(F.when(some("handwritten"), F.concat(F.lit("## Handwritten Content\n\n"), F.array_join(F.transform("handwritten", lambda x: F.concat(F.lit("- "), x)), "\n"))))
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*sections)), "\n\n").alias("markdown"))


def summary(d: DataFrame) -> DataFrame:
    """(doc_id, n_images, n_tables, n_forms, n_handwritten, text_length)."""
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return d.select("doc_id", n("images").alias("n_images"), n("tables").alias("n_tables"), n("forms").alias("n_forms"), n("handwritten").alias("n_handwritten"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"))


def table_lines(columns: Column, data: Column) -> Column:
    """Rows as ``name: value | name: value`` of their non-null cells, one a line."""
    one = lambda r: F.array_join(F.filter(F.transform(columns, lambda c, i: F.when(F.get(r, i).isNotNull(), F.concat(c, F.lit(": "), F.get(r, i)))), lambda x: x.isNotNull()), " | ")
    return F.array_join(F.transform(data, one), "\n")


def embedding_view(d: DataFrame) -> DataFrame:
    """(doc_id, text): one text for embedding: the content, then the tables as lines, then the fields with values."""
    tables = F.transform(F.coalesce("tables", F.array().cast(d.schema["tables"].dataType)), lambda t: table_lines(t["columns"], t["data"]))
    forms = F.transform(F.filter(F.coalesce("forms", F.array().cast(d.schema["forms"].dataType)), lambda f: F.coalesce(f["text"], F.lit("")) != ""), lambda f: F.concat(f["type"], F.lit(": "), f["text"]))
    return d.select("doc_id", F.array_join(F.filter(F.concat(F.array(F.coalesce("text", F.lit(""))), tables, forms), lambda x: x != ""), "\n\n").alias("text"))


def json_document(d: DataFrame) -> DataFrame:
    """(doc_id, json): the document as JSON with plain dashes and quotes, blanks as null."""
    return d.select("doc_id", F.to_json(F.struct(json_text(F.col("file_name")).alias("file_name"), json_text(F.col("text")).alias("text"), "images", "tables", "forms", "handwritten"), {"ignoreNullFields": "false"}).alias("json"))


def normalised(d: DataFrame) -> dict[str, DataFrame]:
    """documents, tables and cells as flat tables; ids of tables are the document's and their place."""
    tables = d.select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    tid = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("table_no").cast("string"))
    grid = tables.select("doc_id", tid.alias("table_id"), F.posexplode(F.concat(F.array("t.columns"), "t.data")).alias("row", "r"))
    return {
        "documents": d.select("doc_id", "file_name", "text"), "tables": tables.select("doc_id", tid.alias("table_id"), "table_no", F.size("t.columns").alias("n_cols"), (F.size("t.data") + 1).alias("n_rows"), "t.confidence"),
        "cells": grid.select("doc_id", "table_id", "row", F.posexplode("r").alias("col", "text")),
    }


def restored(parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, file_name, text, tables): documents put together again from the flat tables, rows and columns in order."""
    rows = parts["cells"].groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("r"))
    grids = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("g"))
    tables = parts["tables"].join(grids, "table_id").select("doc_id", "table_no", F.struct(F.element_at("g", 1).alias("columns"), F.slice("g", F.lit(2), F.size("g")).alias("data"), "confidence").alias("t"))
    lists = tables.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "t"))), lambda x: x["t"]).alias("tables"))
    return parts["documents"].join(lists, "doc_id", "left")
