"""Layout of pages: columns, reading order, sections, margins. Elements have doc_id, elem_id, ord, page, x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, THRESHOLD, SMOOTHING = 100, 0.3, 5
PAGE = ["doc_id", "page"]


def normalise(df: DataFrame) -> DataFrame:
    """Missing places, pages, types and confidences get their defaults; the id is ``elem_`` and the order."""
    return df.withColumns(
        {
            "x1": F.coalesce("x1", F.lit(0.0)), "y1": F.coalesce("y1", F.lit(0.0)), "x2": F.coalesce("x2", F.lit(1.0)), "y2": F.coalesce("y2", F.lit(1.0)), "page": F.coalesce("page", F.lit(0)),
            "element_type": F.coalesce("element_type", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(1.0)), "elem_id": F.coalesce("elem_id", F.concat(F.lit("elem_"), F.col("ord").cast("string"))),
        }
    )


def _counts(df: DataFrame, make: Callable[[np.ndarray], list[np.ndarray]], field: str, kind: str) -> DataFrame:
    """(doc_id, page, ``field``): an array for each page, made of the matrix of pages by bins with the number of elements over each.

    An element adds one where it begins and takes it away behind its end, so it gives two rows however wide it is; pages come
    together pre-aggregated by bin, and Arrow batches of pages are worked on as matrices.
    """
    to_bin = lambda c: F.least(F.floor(F.col(c) * BINS), F.lit(BINS - 1)).cast("int")
    low, high = F.greatest(to_bin("x1"), F.lit(0)), to_bin("x2")
    step = lambda at, by: F.struct(at.alias("bin"), F.lit(by).alias("by"))
    steps = F.when((to_bin("x2") >= to_bin("x1")) & (high >= 0), F.array(step(low, 1), step(high + 1, -1))).otherwise(F.array(step(F.lit(0), 0)))
    changes = df.select(*PAGE, F.explode(steps).alias("s")).groupBy(*PAGE, "s.bin").agg(F.sum("s.by").cast("int").alias("by"))
    pages = changes.groupBy(*PAGE).agg(F.collect_list(F.struct("bin", "by")).alias("c")).select(*PAGE, "c.bin", "c.by")
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            n = np.zeros((batch.num_rows, BINS + 1), dtype=np.int64)
            np.add.at(n, (rows, lists.flatten().to_numpy()), batch.column(3).flatten().to_numpy())
            out = make(n.cumsum(axis=1)[:, :BINS])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.float64() if kind == "double" else pa.int64()))], names=[*PAGE, field])

    return pages.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, {field} array<{kind}>")


def x_histogram(df: DataFrame) -> DataFrame:
    """(doc_id, page, bin, n): for each page all bins, with the number of elements over each."""
    return _counts(df, list, "n", "bigint").select(*PAGE, F.posexplode("n").alias("bin", "n"))


def _valleys(counts: np.ndarray) -> list[np.ndarray]:
    half = SMOOTHING // 2
    sums = np.pad(counts.cumsum(axis=1), ((0, 0), (1, 0)))
    at = np.arange(BINS)
    s = sums[:, np.minimum(at + half + 1, BINS)] - sums[:, np.maximum(at - half, 0)]
    inner = s[:, 1:-1]
    low = (inner < s[:, :-2]) & (inner < s[:, 2:]) & (inner < THRESHOLD * s.max(axis=1, keepdims=True))
    return [(np.flatnonzero(row) + 1) / BINS for row in low]


def _cuts(df: DataFrame) -> DataFrame:
    return _counts(df, _valleys, "cuts", "double")


def valleys(df: DataFrame) -> DataFrame:
    """(doc_id, page, valley): places of the gaps between columns, strict minima of the smoothed histogram under 0.3 of its peak."""
    return _cuts(df).select(*PAGE, F.explode("cuts").alias("valley"))


def columns(df: DataFrame) -> DataFrame:
    """(doc_id, page, elem_id, column): the column each element's centre lies in, from 0; a centre at the right edge has none."""
    return _in_columns(df).select(*PAGE, "elem_id", "column")


def _in_columns(df: DataFrame) -> DataFrame:
    centre = (F.col("x1") + F.col("x2")) / 2
    cuts = _cuts(df).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "cuts")
    both = df.join(cuts, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")), "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    place = F.size(F.filter("cuts", lambda v: v <= centre))
    return both.select(*df.columns, F.when((centre >= 0) & (centre < 1.0), place).alias("column"))


def reading_order(df: DataFrame) -> DataFrame:
    """(doc_id, page, elem_id, position): column by column, each from top to bottom; elements without a column come last."""
    both = _in_columns(df)
    w = Window.partitionBy(*PAGE).orderBy(F.col("column").asc_nulls_last(), "y1", "ord")
    return both.select(*PAGE, "elem_id", F.row_number().over(w).alias("position"))


def sections(df: DataFrame, header: Column) -> DataFrame:
    """(doc_id, page, header_id, elem_id): elements below each header down to the next; a page without headers is one section.

    Elements above the first header are in none; a header belongs to its own section.
    """
    heads = df.filter(header).select("doc_id", "page", F.col("elem_id").alias("header_id"), F.col("y1").alias("h_y1"), F.col("y2").alias("h_y2"), F.col("ord").alias("h_ord"))
    below = Window.partitionBy(*PAGE).orderBy("h_y1", "h_ord")
    heads = heads.withColumn("h_end", F.coalesce(F.lead("h_y1").over(below), F.lit(1.0)))
    inside = df.join(heads, PAGE).filter((F.col("elem_id") == F.col("header_id")) | ((F.col("y1") >= F.col("h_y2")) & (F.col("y1") < F.col("h_end"))))
    whole = df.join(heads.select(*PAGE).distinct(), PAGE, "left_anti").withColumn("header_id", F.lit(None).cast("string"))
    return inside.select(*PAGE, "header_id", "elem_id").unionByName(whole.select(*PAGE, "header_id", "elem_id"))


def page_structure(df: DataFrame) -> DataFrame:
    """One row a page: content box, margins, and how many elements are in the head (y1 < .1) and foot (y2 > .9)."""
    box = df.groupBy(*PAGE).agg(
        F.min("x1").alias("left"), F.min("y1").alias("top"), F.max("x2").alias("right"), F.max("y2").alias("bottom"), F.count_if(F.col("y1") < 0.1).alias("n_head"), F.count_if(F.col("y2") > 0.9).alias("n_foot"),
    )
    return box.withColumns({"right_margin": 1 - F.col("right"), "bottom_margin": 1 - F.col("bottom")})


def quantised_columns(df: DataFrame) -> DataFrame:
    """(doc_id, page, elem_id, island): columns as chains of tenths of the page with gaps of at most one."""
    key = F.floor((F.col("x1") + F.col("x2")) / 2 * 10).cast("int")
    keys = df.select(*PAGE, key.alias("key")).distinct()
    w = Window.partitionBy(*PAGE).orderBy("key")
    gap = F.when(F.col("key") - F.lag("key").over(w) > 1, 1).otherwise(0)
    islands = keys.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w)).drop("gap")
    return df.withColumn("key", key).join(islands, [*PAGE, "key"]).select(*PAGE, "elem_id", "island")


def region_type(width: Column, height: Column) -> Column:
    aspect = width / height
    return F.when(aspect > 3, "text").when(aspect < 0.5, "list").otherwise("block")


def classical_region_type(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    aspect = width / height
    return F.when((aspect > 3) & (height < page_height / 20), "header").when(aspect > 2, "paragraph").when((width > page_width / 3) & (height > page_height / 5), "figure").otherwise("text")


def merge_boxes(df: DataFrame, label: str) -> DataFrame:
    """One box a label on each page around all boxes of that label."""
    return df.groupBy(*PAGE, label).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))
