"""Whole extractions: their text, quality with all its parts, blocks put together, clean JSON, unified Markdown, JSON import.

An extraction row has doc_id, text STRING, text_confidence DOUBLE, tables ARRAY<STRUCT<headers ARRAY<STRING>, data
ARRAY<ARRAY<STRING>>, confidence DOUBLE, shape STRUCT<rows INT, cols INT>, bbox ARRAY<DOUBLE>>>, forms ARRAY<STRUCT<fields
MAP<STRING,STRING>, field_types MAP<STRING,STRING>, confidence DOUBLE, bbox ARRAY<DOUBLE>>>, images ARRAY<STRING>, metadata
MAP<STRING,STRING>, headings ARRAY<STRING>, layout STRING, regions ARRAY<STRING>. A part that is null is one that is absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions import quality
from papyra.functions.text import json_text


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _each(c: Column, f: Callable[[Column], Column]) -> Column:
    """Array of a value for each entry; empty for a null array."""
    return F.coalesce(F.transform(c, f), F.array())


def all_text(text: Column, tables: Column, forms: Column) -> Column:
    """The text, then the cells of each table, then the values of each form, parted by blanks; a null cell reads None."""
    said = lambda x: F.coalesce(x, F.lit("None"))
    cells = F.transform(F.filter(tables, lambda t: t["data"].isNotNull()), lambda t: F.array_join(F.transform(F.flatten(t["data"]), said), " "))
    values = F.transform(F.filter(forms, lambda f: f["fields"].isNotNull()), lambda f: F.array_join(F.transform(F.map_values(f["fields"]), said), " "))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.when(text.isNotNull(), F.array(text)).otherwise(none), F.coalesce(cells, none), F.coalesce(values, none)), " ")


def present_keys(entry: Column, names: list[str]) -> Column:
    """Names of the parts a struct has: those that are not null."""
    return F.array_compact(F.array(*[F.when(entry[n].isNotNull(), n) for n in names]))


def shared_keys(entries: Column, names: list[str]) -> Column:
    """Names that all entries have; null for under two entries, which cannot disagree."""
    every = F.array(*map(F.lit, names))
    return F.when(F.size(entries) > 1, F.aggregate(entries, every, lambda kept, e: F.array_intersect(kept, present_keys(e, names))))


def _mean(values: Column) -> Column:
    n = F.coalesce(F.size(values), F.lit(0))
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


TABLE_PARTS, FORM_PARTS = ["headers", "data", "confidence", "shape", "bbox"], ["fields", "field_types", "confidence", "bbox"]


def assess(d: DataFrame) -> DataFrame:
    """(doc_id, text_score, artifacts, structure, average, variance, distribution, completeness, consistency, overall, recommendations).

    Every part is computed from the extraction itself. Without text the text score is 0 and all is taken for artifacts.
    """
    text, tables, forms = F.col("all_text"), F.col("tables"), F.col("forms")
    d = d.withColumn("all_text", all_text(F.col("text"), tables, forms))
    table = lambda t: quality.table_score(t["data"].isNotNull(), t["headers"].isNotNull(), t["confidence"], t["shape"]["rows"], t["shape"]["cols"])
    form = lambda f: quality.form_score(F.coalesce(F.size(F.map_keys(f["fields"])) > 0, F.lit(False)), f["field_types"].isNotNull(), f["confidence"])
    boxes = F.concat(F.filter(_each(tables, lambda t: t["bbox"]), lambda b: b.isNotNull()), F.filter(_each(forms, lambda f: f["bbox"]), lambda b: b.isNotNull()))
    layout = ((F.size(boxes) > 0).cast("int") + F.col("layout").isNotNull().cast("int") + F.col("regions").isNotNull().cast("int")) / 4.0
    structure = quality.structure_score(_some(tables), _some(forms), _some(F.col("images")), F.col("headings").isNotNull(), _mean(_each(tables, table)), _mean(_each(forms, form)), layout)
    sure = F.array_compact(F.concat(F.array("text_confidence"), _each(tables, lambda t: t["confidence"]), _each(forms, lambda f: f["confidence"])))
    average = F.when(F.size(sure) > 0, _mean(sure)).otherwise(0.5)
    variance = F.when(F.size(sure) > 0, _mean(F.transform(sure, lambda x: (x - _mean(sure)) * (x - _mean(sure))))).otherwise(0.0)
    n_parts = sum((F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("forms", "images")), F.greatest(F.coalesce(F.size(tables), F.lit(0)), F.lit(0)))
    covered = F.array_compact(F.array(F.when(F.length(text) > 0, F.least(F.length(text) / 1000.0, F.lit(1.0))), F.when(n_parts > 0, F.least(n_parts / 5.0, F.lit(1.0)))))
    coverage = F.when(F.size(covered) > 0, _mean(covered)).otherwise(0.5)
    complete = quality.completeness(F.length(text) > 0, _some(tables) | _some(forms), F.coalesce(F.size(F.map_keys("metadata")) > 0, F.lit(False)), coverage)
    agree = lambda c, names: F.coalesce(F.size(shared_keys(c, names)) > 0, F.lit(True))
    uniform = F.size(F.array_distinct(F.transform(boxes, F.size))) <= 1
    consistent = quality.consistency(text, uniform, agree(tables, TABLE_PARTS) & agree(forms, FORM_PARTS))
    has = F.length(text) > 0
    d = d.select("doc_id", F.when(has, quality.text_score(text)).otherwise(0.0).alias("text_score"), F.when(has, quality.artifact_ratio(text)).otherwise(1.0).alias("artifacts"), structure.alias("structure"), average.alias("average"), variance.alias("variance"), (F.size(sure) > 0).alias("_sure"), complete.alias("completeness"), consistent.alias("consistency"))
    d = d.withColumn("distribution", F.when(F.col("_sure"), quality.confidence_class(F.col("average"), F.col("variance"))).otherwise("unknown")).drop("_sure")
    d = d.withColumn("overall", quality.overall({"text": F.col("text_score"), "structure": F.col("structure"), "confidence": F.col("average"), "completeness": F.col("completeness"), "consistency": F.col("consistency")}))
    return d.withColumn("recommendations", quality.recommendations(F.col("text_score"), F.col("artifacts"), F.col("structure"), F.col("average"), F.lit(None).cast("double"), F.col("overall")))


def combine_maps(df: DataFrame, keys: list[str], order: str, key: str, value: str) -> DataFrame:
    """(keys, merged): the (key, value) entries of a group's blocks as one map; of equal keys the one last in order holds.

    Each key is settled by an aggregate of its own before the maps are made, so a group's entries are never brought together.
    """
    last = df.groupBy(*keys, key).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias("merged"))


def combine_lists(df: DataFrame, keys: list[str], order: str, items: str) -> DataFrame:
    """(keys, merged): the lists of a group's blocks one after the other."""
    return df.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda x: x[items])).alias("merged"))


def clean_value(c: Column, kind: T.DataType) -> Column:
    """A value for JSON output, to any depth: names stripped (an empty one becomes ``unknown_key``), NaN and infinities null, texts
    with plain dashes and quotes, stripped, empty to null; whole numbers, truth values and dates become texts."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[clean_value(c[f.name], f.dataType).alias(f.name.strip() or "unknown_key") for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clean_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(F.coalesce(F.nullif(F.trim(e["key"].cast("string")), F.lit("")), F.lit("unknown_key")).alias("key"), clean_value(e["value"], kind.valueType).alias("value")))
        # of names that become equal the later holds
        kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(kept)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.StringType):
        return json_text(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def clean_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON text of the given columns (all by default), cleaned to any depth; nulls stay as null."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return F.to_json(F.struct(*[clean_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name.strip() or "unknown_key") for f in fields]), {"ignoreNullFields": "false"})


def unified_markdown(d: DataFrame) -> DataFrame:
    """(doc_id, markdown) of parsed documents: information, structure, then each page with tables, form fields and handwriting.

    Rows have title, author, page_count, created, elements ARRAY<STRUCT<type, level, text>>, pages ARRAY<STRUCT<page_number,
    tables ARRAY<STRING> (Markdown), fields ARRAY<STRUCT<type, label, value, is_checked>>, handwritten ARRAY<STRING>>>.
    """
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    own = lambda c, other: F.coalesce(c, F.lit(other))
    none = F.array().cast("array<string>")
    heading = lambda e: F.array(line(F.repeat(F.lit("#"), own(e["level"], 1) + 1), " ", own(e["text"], "")))
    element = lambda e: F.when(e["type"] == "heading", heading(e)).when(e["type"] == "paragraph", F.array(own(e["text"], ""), F.lit(""))).when(e["type"] == "list_item", F.array(line("- ", own(e["text"], "")))).otherwise(none)
    info = F.concat(
        F.array(line("# ", own(F.col("title"), "Untitled Document")), F.lit(""), F.lit("## Document Information"), F.lit(""), line("- **Author:** ", own(F.col("author"), "Unknown")), line("- **Pages:** ", own(F.col("page_count"), 0).cast("string"))),
        F.when(own(F.col("created"), "") != "", F.array(line("- **Created:** ", F.col("created")))).otherwise(none), F.array(F.lit("")),
    )
    structure = F.when(F.col("elements").isNotNull(), F.concat(F.array(F.lit("## Document Structure"), F.lit("")), F.flatten(F.transform("elements", element)), F.array(F.lit("")))).otherwise(none)
    field = lambda f: F.when(own(f["type"], "unknown") == "checkbox", line("- ", F.when(own(f["is_checked"], False), "☑").otherwise("☐"), " **", own(f["label"], "Unlabeled Field"), "**")).otherwise(line("- **", own(f["label"], "Unlabeled Field"), ":** ", own(f["value"], "")))

    def page(p: Column) -> Column:
        tables = F.flatten(F.transform(p["tables"], lambda t, i: F.array(line("### Table ", (i + 1).cast("string")), F.lit(""), own(t, ""), F.lit(""))))
        fields = F.when(_some(p["fields"]), F.concat(F.array(F.lit("### Form Fields"), F.lit("")), F.transform(p["fields"], field), F.array(F.lit("")))).otherwise(none)
        hand = F.when(_some(p["handwritten"]), F.concat(F.array(F.lit("### Handwritten Content"), F.lit("")), F.transform(p["handwritten"], lambda x: line("- ", own(x, ""))), F.array(F.lit("")))).otherwise(none)
        return F.concat(F.array(line("## Page ", own(p["page_number"], 0).cast("string")), F.lit("")), F.coalesce(tables, none), fields, hand)

    pages = F.coalesce(F.flatten(F.transform("pages", page)), none)
    return d.select("doc_id", F.array_join(F.concat(info, structure, pages), "\n").alias("markdown"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Exported JSON back as rows: files of one object a line, or of one object or list over many lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".json"):
        return reader.option("multiLine", True).json(path)
    return reader.json(path)


def mean_reading(confidences: Column) -> Column:
    """Mean of a reader's confidences in percent as a share: only those above 0 count; without any 0.5."""
    good = F.when(confidences > 0, F.floor(confidences))
    return F.coalesce(F.avg(good) / 100.0, F.lit(0.5))
