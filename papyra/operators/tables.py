"""Tables on pages: grids from lines, tables without lines, cells and their content, grids as Markdown, HTML, JSON and CSV."""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import strip

PAGE = ["doc_id", "page"]
TOLERANCE = 0.01


def orientation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """h for a line without height, v for one without width, else null."""
    return F.when(F.abs(y2 - y1) < TOLERANCE, "h").when(F.abs(x2 - x1) < TOLERANCE, "v")


def grid_rectangles(lines: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, page, x1, y1, x2, y2, n_rows, n_cols): tables bordered by lines.

    ``exact`` gives the original's result, which is always empty: it looks for lines strictly inside rectangles between
    adjacent coordinates. Otherwise the evident intent: all horizontal and vertical lines of a page form one grid if there
    are two of each and it spans at least 0.1 by 0.05.
    """
    o = orientation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    at = lines.withColumn("o", o).filter("o is not null")
    place = F.bround(F.when(F.col("o") == "h", (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2), 4)
    sides = at.groupBy(*PAGE).agg(
        F.count_distinct(F.when(F.col("o") == "h", place)).alias("n_h"), F.count_distinct(F.when(F.col("o") == "v", place)).alias("n_v"),
        F.min(F.when(F.col("o") == "v", place)).alias("x1"), F.max(F.when(F.col("o") == "v", place)).alias("x2"), F.min(F.when(F.col("o") == "h", place)).alias("y1"), F.max(F.when(F.col("o") == "h", place)).alias("y2"),
    )
    good = sides.filter("n_h >= 2 and n_v >= 2 and x2 - x1 >= 0.1 and y2 - y1 >= 0.05" + (" and false" if exact else ""))
    return good.select(*PAGE, "x1", "y1", "x2", "y2", (F.col("n_h") - 1).alias("n_rows"), (F.col("n_v") - 1).alias("n_cols"))


def adjacent_rectangles(lines: DataFrame) -> DataFrame:
    """(doc_id, page, x1, x2, y1, y2): all rectangles between neighbouring vertical and horizontal lines of a page."""
    o = orientation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    at = lines.withColumn("o", o)
    w = Window.partitionBy(*PAGE).orderBy("c")
    side = lambda kind, c: at.filter(F.col("o") == kind).select(*PAGE, F.col(c).alias("c")).distinct().withColumn("n", F.lead("c").over(w)).filter("n is not null")
    xs = side("v", "x1").select(*PAGE, F.col("c").alias("x1"), F.col("n").alias("x2"))
    ys = side("h", "y1").select(*PAGE, F.col("c").alias("y1"), F.col("n").alias("y2"))
    return xs.join(ys, PAGE).select(*PAGE, "x1", "x2", "y1", "y2")


def borderless(blocks: DataFrame, least_blocks: int = 6) -> DataFrame:
    """(doc_id, page, x1, y1, x2, y2, n_rows, n_cols): at most one table a page from blocks aligned in rows and columns."""
    bucket = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2 / TOLERANCE, 0)
    b = blocks.withColumns({"ry": bucket("y1", "y2"), "rx": bucket("x1", "x2")})
    enough = b.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_all")).filter(F.col("n_all") >= least_blocks).select(*PAGE)
    rows = b.join(enough, PAGE, "left_semi").withColumn("in_row", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "ry"))).filter("in_row > 1")
    rows = rows.withColumn("in_col", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "rx")))
    found = rows.groupBy(*PAGE).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count_distinct("ry").alias("n_rows"), F.count_distinct(F.when(F.col("in_col") > 1, F.col("rx"))).alias("n_cols"),
    )
    return found.filter("n_rows >= 2 and n_cols >= 2")


def without_overlap(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates that overlap no kept table of their page."""
    k = kept.select(*[F.col(c).alias(f"k_{c}") for c in (*PAGE, "x1", "y1", "x2", "y2")])
    hit = (F.col("doc_id") == F.col("k_doc_id")) & (F.col("page") == F.col("k_page")) & (F.col("x1") < F.col("k_x2")) & (F.col("x2") > F.col("k_x1")) & (F.col("y1") < F.col("k_y2")) & (F.col("y2") > F.col("k_y1"))
    return candidates.join(k, hit, "left_anti")


def uniform_cells(tables: DataFrame) -> DataFrame:
    """Adds row, col and the box of each cell of an evenly cut table."""
    t = tables.withColumn("row", F.explode(F.sequence(F.lit(0), (F.col("n_rows") - 1).cast("int")))).withColumn("col", F.explode(F.sequence(F.lit(0), (F.col("n_cols") - 1).cast("int"))))
    w, h = (F.col("x2") - F.col("x1")) / F.col("n_cols"), (F.col("y2") - F.col("y1")) / F.col("n_rows")
    return t.withColumns({"c_x1": F.col("x1") + w * F.col("col"), "c_x2": F.col("x1") + w * (F.col("col") + 1), "c_y1": F.col("y1") + h * F.col("row"), "c_y2": F.col("y1") + h * (F.col("row") + 1)})


def cell_text(cells: DataFrame, blocks: DataFrame, fix_characters: bool = False) -> DataFrame:
    """(doc_id, page, row, col, text, is_header): texts of the blocks over each cell, in block order, parted by a blank."""
    from papyra.functions.text import ocr_character_fixes

    b = blocks.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), "block_ord", F.col("text").alias("b_text"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    over = (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & (F.col("b_x1") < F.col("c_x2")) & (F.col("b_x2") > F.col("c_x1")) & (F.col("b_y1") < F.col("c_y2")) & (F.col("b_y2") > F.col("c_y1"))
    got = cells.join(b, over, "left").groupBy(*PAGE, "row", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("b_doc").isNotNull(), F.struct("block_ord", F.coalesce("b_text", F.lit("")).alias("t"))))), lambda x: x["t"]), " ").alias("text")
    )
    text = ocr_character_fixes(F.col("text")) if fix_characters else F.col("text")
    return got.select(*PAGE, "row", "col", text.alias("text"), (F.col("row") == 0).alias("is_header"))


def separator_cells(separators: DataFrame) -> DataFrame:
    """Cells of tables given by row and column separators: n separators make n + 1 strips of the table's box.

    Input: (table_id, axis ``row`` or ``col``, at) and the box x1, y1, x2, y2 on each row.
    """
    axis = lambda kind, low, high: separators.filter(F.col("axis") == kind).select("table_id", F.col("at").alias("a")).unionByName(separators.select("table_id", F.col(low).alias("a")).distinct()).distinct()
    w = Window.partitionBy("table_id").orderBy("a")
    top = separators.groupBy("table_id").agg(F.first("x2").alias("x2"), F.first("y2").alias("y2"), (F.count_if(F.col("axis") == "row") > 0).alias("bordered"))
    strips = lambda kind, low, high, name: axis(kind, low, high).join(top, "table_id").select("table_id", "bordered", (F.row_number().over(w) - 1).alias(name), F.col("a").alias(low), F.coalesce(F.lead("a").over(w), F.col(high)).alias(high))
    rows, cols = strips("row", "y1", "y2", "row"), strips("col", "x1", "x2", "col").drop("bordered")
    return rows.join(cols, "table_id").withColumn("structure_type", F.when(F.col("bordered"), "bordered").otherwise("borderless")).drop("bordered")


def aligned_clusters(boxes: DataFrame, axis: str = "y", tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, page, block_ord, cluster): greedy first-fit clusters of centres, in block order, page by page.

    The result depends on the order of the blocks, so each page is worked through in order: pages are brought together and
    sorted, and the clusters of one page at a time are kept while its blocks stream by.
    """
    low, high = ("y1", "y2") if axis == "y" else ("x1", "x2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, starts = None, []
        for pdf in batches:
            out = []
            for d, p, c in zip(pdf["doc_id"], pdf["page"], (pdf[low] + pdf[high]) / 2):
                if (d, p) != page:
                    page, starts = (d, p), []
                k = next((i for i, s in enumerate(starts) if abs(s - c) <= tolerance), len(starts))
                if k == len(starts):
                    starts.append(c)
                out.append(k)
            yield pdf.assign(cluster=out)[["doc_id", "page", "block_ord", "cluster"]]

    kinds = dict(boxes.dtypes)
    ordered = boxes.select(*PAGE, "block_ord", low, high).repartition(*PAGE).sortWithinPartitions(*PAGE, "block_ord")
    return ordered.mapInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, block_ord {kinds['block_ord']}, cluster int")


def structure_objects(objects: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(table_id, n_columns, n_rows, n_cells, confidence): detections over the threshold by their label, with mean score."""
    label = F.lower("label")
    kind = F.when(label.contains("column") & ~label.contains("header"), "column").when(label.contains("row") & ~label.contains("header"), "row").when(label.contains("cell"), "cell")
    good = objects.filter(F.col("score") > threshold).withColumn("kind", kind)
    return good.groupBy("table_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("column", "row", "cell")], F.avg("score").alias("confidence"))


def clean_header(h: Column) -> Column:
    return F.transform(h, lambda x, i: F.coalesce(F.nullif(strip(x), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))))


def clean_rows(rows: Column, width: Column) -> Column:
    """Rows as wide as the header, stripped, ``nan``, ``none`` and blanks to null; rows without any content are dropped."""
    cell = lambda x: F.when(F.lower(strip(x)).isin("nan", "none", ""), F.lit(None)).otherwise(strip(x))
    cleaned = F.transform(F.filter(rows, lambda r: F.size(r) == width), lambda r: F.transform(r, cell))
    return F.filter(cleaned, lambda r: F.exists(r, lambda x: x.isNotNull()))


def clean_tables(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Adds header and data of raw tables (arrays of rows, the first the header); tables under two rows or without data go."""
    out = df.filter(F.size(rows) >= 2).withColumn("header", clean_header(F.element_at(rows, 1)))
    out = out.withColumn("data", clean_rows(F.slice(F.col(rows), 2, F.size(rows)), F.size("header")))
    return out.filter(F.size("data") > 0)


def as_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid): cells (row, col, ord, text) as an array of rows; the last entry for a place holds, gaps are empty."""
    one = cells.groupBy(*keys, "row", "col").agg(F.max_by("text", "ord").alias("text"))
    t = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), F.coalesce("text", F.lit(""))))).alias("m"), F.max("row").alias("nr"), F.max("col").alias("nc"))
    grid = F.transform(F.sequence(F.lit(0), F.col("nr")), lambda r: F.transform(F.sequence(F.lit(0), F.col("nc")), lambda c: F.coalesce(F.col("m")[F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))], F.lit(""))))
    return t.select(*keys, grid.alias("grid"))


def fill_blanks(grid: Column) -> Column:
    """Blank cells named by their place, as ``R1C2`` from row 1 and column 2 counted from 0."""
    return F.transform(grid, lambda row, r: F.transform(row, lambda x, c: F.when(x == "", F.concat(F.lit("R"), r.cast("string"), F.lit("C"), c.cast("string"))).otherwise(x)))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def grid_markdown(grid: Column) -> Column:
    head = F.element_at(grid, 1)
    rule = F.transform(head, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(_line(head), _line(rule)), F.transform(F.slice(grid, 2, F.size(grid)), _line)), "\n")


def grid_html(grid: Column) -> Column:
    """An HTML table; the first row is the header. Text is not escaped, as in the original."""
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    rows = F.concat(F.array(row(F.element_at(grid, 1), "th")), F.transform(F.slice(grid, 2, F.size(grid)), lambda r: row(r, "td")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


def grid_records(grid: Column) -> Column:
    """Rows as maps from the header to the cell; of equal headers the later cell holds."""
    head = F.element_at(grid, 1)
    one = lambda r: F.map_from_entries(F.filter(F.transform(F.sequence(F.lit(0), F.size(head) - 1), lambda i: F.when(F.array_position(F.slice(head, i + 2, F.size(head)), F.get(head, i)) == 0, F.struct(F.get(head, i), F.get(r, i)))), lambda e: e.isNotNull()))
    return F.transform(F.slice(grid, 2, F.size(grid)), one)


def grid_csv(grid: Column) -> Column:
    """CSV text of a grid: fields with a comma, quote or line break are quoted, quotes doubled."""
    field = lambda x: F.when(x.rlike("[,\"\n\r]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, field), ",")), "\n")


def csv_cells(df: DataFrame, path_column: str = "path") -> DataFrame:
    """(path, row, col, text): non-empty fields of files read without header as columns of strings with a ``row`` number."""
    fields = [c for c in df.columns if c not in (path_column, "row")]
    return df.select(path_column, "row", F.posexplode(F.array(*fields)).alias("col", "text")).filter("text <> ''")


