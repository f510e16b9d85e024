"""Queries of structure, layout, tables, forms, segments, OCR choice, planning and cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import forms, layout, planning, segments, structure, tables
from papyra.plans.text_queries import CID, PAGES, READABLE, WS, _pages, _strip
from papyra.session import table


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct elements with whole-number places (thousandths), so that sums of places are exact in any engine."""
    e = table(spark, sf, "elements").select("document_id", "id", "element_type", "level", "text", "page", "x1", "y1", "x2", "y2", "confidence").distinct()
    mils = lambda c: (F.round(F.col(c) * 1000).cast("int") / F.lit(1024.0)).alias(c)
    return e.select("document_id", "id", "element_type", "level", "text", F.coalesce("page", F.lit(0)).alias("page"), *[mils(c) for c in ("x1", "y1", "x2", "y2")], "confidence")


_EL = "el AS (SELECT DISTINCT document_id, id, element_type, level, text, page, x1, y1, x2, y2, confidence FROM elements), e AS (SELECT document_id, id, element_type, level, text, coalesce(page, 0) AS page, " + ", ".join(f"round({c} * 1000)::INT / 1024.0::DOUBLE AS {c}" for c in ("x1", "y1", "x2", "y2")) + ", confidence FROM el)"


def _blocks(spark, sf):
    """Elements as text blocks: order by the number in the id, font and weight by type and level."""
    e = _elements(spark, sf)
    number = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("int")
    head = F.col("element_type") == "heading"
    return e.select(F.col("document_id").alias("doc_id"), number.alias("block_ord"), "text", "page", "x1", "y1", "x2", "y2", F.when(head, 20 - 2 * F.col("level")).otherwise(10).alias("font_size"), (head & (F.col("level") <= 5)).alias("is_bold"))


_BL = _EL + ", b AS (SELECT document_id AS doc_id, TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS block_ord, text, page, x1, y1, x2, y2, CASE WHEN element_type = 'heading' THEN 20 - 2 * level ELSE 10 END AS font_size, element_type = 'heading' AND level <= 5 AS is_bold FROM e)"
_NUM = rf"^([0-9]+\.)+[0-9]*{WS}+[\p{{L}}\p{{N}}_]"
_LEVEL = f"""CASE WHEN {_strip('text')} = '' THEN 0 WHEN regexp_matches(text, '{_NUM}') THEN least(length(text) - length(replace(text, '.', '')), 6)
 WHEN font_size > 18 AND is_bold THEN 1 WHEN font_size > 16 AND is_bold THEN 2 WHEN font_size > 14 THEN 3 WHEN font_size > 12 AND is_bold THEN 4 WHEN font_size > 0 AND is_bold THEN 5
 WHEN length(text) < 100 AND regexp_matches({_strip('text')}, '[:.]$') AND is_bold THEN 6 ELSE 0 END"""
_LIST = rf"(contains('{structure.BULLETS}', left(text, 1)) AND text <> '' OR regexp_matches(text, '^{WS}*([0-9]+\.|\([a-zA-Z0-9]+\)|[a-zA-Z0-9]+[.)]){WS}+'))"
_NOTE = f"(y1 > 0.8 AND regexp_matches(text, '{structure.FOOTNOTE}'))"
_FOUND = _BL + f""", l AS (SELECT *, {_LEVEL} AS lv FROM b WHERE {_strip("coalesce(text, '')")} <> ''),
f AS (SELECT *, CASE WHEN lv > 0 THEN 'heading' WHEN {_LIST} THEN 'list_item' WHEN {_NOTE} THEN 'footnote' ELSE 'paragraph' END AS element_type FROM l),
g AS (SELECT *, element_type || '_' || block_ord AS element_id, lv AS level FROM f)"""


def _found(spark, sf):
    return structure.elements(_blocks(spark, sf))


def structure_elements(spark, sf):
    return _found(spark, sf).select("doc_id", "element_id", "element_type", "level", "confidence")


def list_and_note_marks(spark, sf):
    b = _blocks(spark, sf)
    return b.select("doc_id", "block_ord", structure.list_marker(F.col("text")).alias("l"), structure.footnote_mark(F.col("text"), F.col("y1")).alias("note")).select("doc_id", "block_ord", "l.list_type", "l.marker", "note")


def heading_parent(spark, sf):
    return structure.heading_parents(_found(spark, sf)).select("doc_id", "element_id", "parent_element")


def heading_children(spark, sf):
    return structure.children(structure.heading_parents(_found(spark, sf))).select("doc_id", "element_id", F.array_join("child_ids", ",").alias("child_ids"))


def _report_blocks(spark, sf):
    """Reports made of orders: numbered headings, captions, references and a table of contents."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    line = lambda i, t, y: F.struct(F.lit(i).alias("block_ord"), t.alias("text"), F.lit(y).alias("y1"))
    n = (k % 4 + 1).cast("string")
    lines = F.array(
        line(0, F.lit("0. Table of Contents"), 0.05), line(1, F.concat(n, F.lit(" Results .... "), (k % 9).cast("string")), 0.1), line(2, F.lit("2 Nothing here ..... 12"), 0.15), line(3, F.concat(n, F.lit(" Results")), 0.2),
        line(4, F.concat(F.lit("See Section "), n, F.lit(" and Table "), (k % 3).cast("string"), F.lit(", not Figure 8.")), 0.3), line(5, F.concat(F.lit("Table "), (k % 2).cast("string"), F.lit(" shows totals")), 0.4), line(6, F.lit("Figure 8 is a chart"), 0.5),
    )
    b = o.select(k.alias("doc_id"), F.explode(lines).alias("l")).select("doc_id", "l.block_ord", "l.text", F.lit(1).alias("page"), F.lit(0.1).alias("x1"), "l.y1", F.lit(0.9).alias("x2"), (F.col("l.y1") + 0.02).alias("y2"))
    head = F.col("block_ord").isin(0, 3)
    return b.withColumns({"font_size": F.when(F.col("block_ord") == 3, 15).when(head, 10).otherwise(10), "is_bold": F.lit(False)})


def cross_references(spark, sf):
    return structure.references(structure.elements(_report_blocks(spark, sf)))


def toc_links(spark, sf):
    return structure.contents(structure.elements(_report_blocks(spark, sf)))


def _columned(spark, sf):
    """Pages in two columns with a narrow gap, made of orders: items with odd numbers on the left, others on the right."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n, left = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 1
    x1, y1 = F.when(left, 64).otherwise(543) / 1024.0, (n * 96 + 16) / 1024.0
    return li.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.concat(F.lit("item-"), n.cast("string")).alias("elem_id"), n.cast("int").alias("ord"), F.lit("paragraph").alias("element_type"), F.lit(1).alias("page"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 422 / 1024.0).alias("x2"), (y1 + 48 / 1024.0).alias("y2"), F.lit(1.0).alias("confidence"),
    )


def _layout(spark, sf):
    """The elements of all documents, and pages in two columns."""
    return _one_column(spark, sf).unionByName(_columned(spark, sf))


def _one_column(spark, sf):
    e = _elements(spark, sf)
    return layout.normalise(e.select(F.col("document_id").alias("doc_id"), F.col("id").alias("elem_id"), F.regexp_extract("id", "([0-9]+)$", 1).try_cast("int").alias("ord"), "element_type", "page", "x1", "y1", "x2", "y2", "confidence"))


_LAY = _EL + """, cl AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), cx AS (SELECT *, CASE WHEN n % 2 = 1 THEN 64 ELSE 543 END / 1024.0::DOUBLE AS x, (n * 96 + 16) / 1024.0::DOUBLE AS y FROM cl)""" + ", a AS (SELECT document_id AS doc_id, coalesce(id, 'elem_' || TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT)) AS elem_id, TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS ord, coalesce(element_type, 'unknown') AS element_type, page, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, 1) AS x2, coalesce(y2, 1) AS y2, coalesce(confidence, 1) AS confidence FROM e UNION ALL SELECT 'order-' || k, 'item-' || n, n::INT, 'paragraph', 1, x, y, x + 422 / 1024.0::DOUBLE, y + 48 / 1024.0::DOUBLE, 1.0 FROM cx)"
_HIST = _LAY + """, hb AS (SELECT doc_id, page, unnest(range(least(floor(x1 * 100), 99)::INT, least(floor(x2 * 100), 99)::INT + 1)) AS bin FROM a), hc AS (SELECT doc_id, page, bin, count(*) AS c FROM hb GROUP BY ALL),
h AS (SELECT d.doc_id, d.page, r.bin::INT AS bin, coalesce(c, 0) AS n FROM (SELECT DISTINCT doc_id, page FROM a) d CROSS JOIN (SELECT unnest(range(100)) AS bin) r LEFT JOIN hc ON hc.doc_id = d.doc_id AND hc.page = d.page AND hc.bin = r.bin)"""
_VAL = _HIST + """, s1 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM h),
s2 AS (SELECT *, max(s) OVER (PARTITION BY doc_id, page) AS top, lag(s) OVER (PARTITION BY doc_id, page ORDER BY bin) AS be, lead(s) OVER (PARTITION BY doc_id, page ORDER BY bin) AS af FROM s1),
v AS (SELECT doc_id, page, bin / 100 AS valley FROM s2 WHERE s < be AND s < af AND s < 0.3::DOUBLE * top)"""
_COL = _VAL + """, c AS (SELECT a.doc_id, a.page, elem_id, y1, ord, CASE WHEN (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 < 1 THEN (SELECT count(*) FROM v WHERE v.doc_id = a.doc_id AND v.page = a.page AND valley <= (a.x1 + a.x2) / 2) END AS "column" FROM a)"""


def layout_histogram(spark, sf):
    return layout.x_histogram(_layout(spark, sf)).filter("n > 0")


def layout_valleys(spark, sf):
    return layout.valleys(_layout(spark, sf))


def layout_columns(spark, sf):
    return layout.columns(_layout(spark, sf))


def reading_order(spark, sf):
    return layout.reading_order(_layout(spark, sf))


def layout_sections(spark, sf):
    return layout.sections(_layout(spark, sf), (F.col("element_type") == "heading") & (F.col("y2") - F.col("y1") > 0.015))


def page_margins(spark, sf):
    return layout.page_structure(_layout(spark, sf))


def quantised_columns(spark, sf):
    return layout.quantised_columns(_layout(spark, sf))


def region_types(spark, sf):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return _layout(spark, sf).select("doc_id", "elem_id", layout.region_type(w, h).alias("contour"), layout.classical_region_type(w, h, F.lit(1.0), F.lit(1.0)).alias("classical"))


def merged_boxes(spark, sf):
    return layout.merge_boxes(_layout(spark, sf), "element_type")


def borderless_tables(spark, sf):
    return tables.borderless(_grid_blocks(spark, sf))


def _grid_blocks(spark, sf):
    """Blocks in a grid, from line items: rows by line number, columns by quantity, some out of line."""
    li = table(spark, sf, "lineitem")
    row, colm = F.col("l_linenumber"), (F.col("l_partkey") % 3).cast("int")
    shift = F.when(F.col("l_suppkey") % 11 == 0, 17).otherwise(0)
    x, y = (colm * 256 + 64) / 1024.0, (row * 96 + 32 + shift) / 1024.0
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (row * 10 + colm).alias("block_ord"), F.concat(F.lit("v"), F.col("l_quantity").cast("int").cast("string")).alias("text"), x.alias("x1"), y.alias("y1"), (x + 0.125).alias("x2"), (y + 0.03125).alias("y2")).distinct()


_GRID = """gb AS (SELECT DISTINCT l_orderkey AS doc_id, 1 AS page, l_linenumber * 10 + (l_partkey % 3)::INT AS block_ord, 'v' || l_quantity::INT AS text, ((l_partkey % 3)::INT * 256 + 64) / 1024.0::DOUBLE AS x1,
 (l_linenumber * 96 + 32 + CASE WHEN l_suppkey % 11 = 0 THEN 17 ELSE 0 END) / 1024.0::DOUBLE AS y1 FROM lineitem), g AS (SELECT *, x1 + 0.125::DOUBLE AS x2, y1 + 0.03125::DOUBLE AS y2 FROM gb)"""
_BORD = _GRID + """, r AS (SELECT *, round_even((y1 + y2) / 2 / 0.01::DOUBLE, 0) AS ry, round_even((x1 + x2) / 2 / 0.01::DOUBLE, 0) AS rx, count(*) OVER (PARTITION BY doc_id, page) AS n_all FROM g),
r1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, ry) AS in_row FROM r WHERE n_all >= 6), r2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, rx) AS in_col FROM r1 WHERE in_row > 1),
t AS (SELECT doc_id, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(DISTINCT ry) AS n_rows, count(DISTINCT CASE WHEN in_col > 1 THEN rx END) AS n_cols FROM r2 GROUP BY 1, 2 HAVING count(DISTINCT ry) >= 2 AND count(DISTINCT CASE WHEN in_col > 1 THEN rx END) >= 2)"""


def cell_texts(spark, sf):
    b = _grid_blocks(spark, sf)
    return tables.cell_text(tables.uniform_cells(tables.borderless(b)), b)


def _lines(spark, sf):
    """Horizontal and vertical lines by order: as many as it has items."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k, n = F.col("l_orderkey"), F.col("l_linenumber") / 8.0
    h = li.select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x1"), n.alias("y1"), F.lit(1.0).alias("x2"), n.alias("y2"))
    v = li.filter("l_linenumber % 2 = 0").select(k.alias("doc_id"), F.lit(1).alias("page"), n.alias("x1"), F.lit(0.0).alias("y1"), n.alias("x2"), F.lit(1.0).alias("y2"))
    return h.unionByName(v)


_LINES = "li AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem)"


def grid_rectangles(spark, sf):
    return tables.grid_rectangles(_lines(spark, sf))


def adjacent_rectangles(spark, sf):
    return tables.adjacent_rectangles(_lines(spark, sf))


def tables_without_overlap(spark, sf):
    a = tables.grid_rectangles(_lines(spark, sf))
    b = tables.borderless(_grid_blocks(spark, sf))
    kept = a.select("doc_id", "page", "x1", "y1", "x2", "y2")
    return kept.withColumn("kind", F.lit("bordered")).unionByName(tables.without_overlap(b, kept).select("doc_id", "page", "x1", "y1", "x2", "y2").withColumn("kind", F.lit("borderless")))


def separator_cells(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), "l_linenumber").distinct()
    s = li.select("table_id", F.when(F.col("l_linenumber") % 2 == 0, "row").otherwise("col").alias("axis"), (F.col("l_linenumber") / 8.0).alias("at"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
    return tables.separator_cells(s)


def aligned_clusters(spark, sf):
    return tables.aligned_clusters(_grid_blocks(spark, sf))


def structure_objects(spark, sf):
    li = table(spark, sf, "lineitem")
    o = li.select(F.col("l_orderkey").alias("table_id"), F.element_at(F.array(*map(F.lit, ["table column", "table row", "table spanning cell", "table column header"])), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("label"), F.col("l_discount").alias("d")).withColumn("score", F.col("d") * 10)
    out = tables.structure_objects(o)
    return out.withColumn("confidence", F.round("confidence", 6))


def _raw_tables(spark, sf):
    """Tables of strings from line items with blanks, ``nan`` and short rows."""
    li = table(spark, sf, "lineitem")
    q = F.when(F.col("l_linenumber") == 3, " nan ").when(F.col("l_linenumber") == 5, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    row = F.when(F.col("l_partkey") % 7 == 0, F.array(F.col("l_partkey").cast("string"))).otherwise(F.array(F.concat(F.lit(" "), F.col("l_partkey").cast("string")), q, F.when(F.col("l_linenumber") == 4, "None").otherwise(F.col("l_returnflag"))))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]).alias("body"))
    head = F.array(F.lit(" part "), F.lit(""), F.lit("flag"))
    return rows.select(F.col("l_orderkey").alias("table_id"), F.concat(F.array(head), "body").alias("rows"))


_RAW = """rt AS (SELECT l_orderkey AS table_id, list(CASE WHEN l_partkey % 7 = 0 THEN [l_partkey::VARCHAR] ELSE [' ' || l_partkey, CASE WHEN l_linenumber = 3 THEN ' nan ' WHEN l_linenumber = 5 THEN '' ELSE l_quantity::INT::VARCHAR END, CASE WHEN l_linenumber = 4 THEN 'None' ELSE l_returnflag END] END ORDER BY l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN [l_partkey::VARCHAR] ELSE [' ' || l_partkey, CASE WHEN l_linenumber = 3 THEN ' nan ' WHEN l_linenumber = 5 THEN '' ELSE l_quantity::INT::VARCHAR END, CASE WHEN l_linenumber = 4 THEN 'None' ELSE l_returnflag END] END) AS body FROM lineitem GROUP BY 1),
ct AS (SELECT table_id, ['part', 'column_1', 'flag'] AS header, list_filter(list_transform(list_filter(body, lambda r: len(r) = 3), lambda r: list_transform(r, lambda x: CASE WHEN lower(trim(x)) IN ('nan', 'none', '') THEN NULL ELSE trim(x) END)), lambda r: len(list_filter(r, lambda x: x IS NOT NULL)) > 0) AS data FROM rt),
k AS (SELECT * FROM ct WHERE len(data) > 0)"""


def table_row_clean(spark, sf):
    c = tables.clean_tables(_raw_tables(spark, sf))
    return c.select("table_id", F.array_join("header", "|").alias("header"), F.size("data").alias("n_rows"), F.array_join(F.transform("data", lambda r: F.array_join(r, "|", "~")), "\n").alias("data"))


def _cells(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.concat(F.col("l_returnflag"), F.lit(","), F.col("l_quantity").cast("int").cast("string"))
    return li.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"), F.struct("l_partkey", text.alias("t")).alias("ord"), text.alias("text"))


_CELLS = """ce AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, (l_suppkey % 3)::INT AS c, max_by(l_returnflag || ',' || l_quantity::INT, {'k': l_partkey, 't': l_returnflag || ',' || l_quantity::INT}) AS t FROM lineitem GROUP BY 1, 2, 3),
mx AS (SELECT table_id, max(r) AS nr, max(c) AS nc FROM ce GROUP BY 1), full_ AS (SELECT m.table_id, x.r, y.c, coalesce(ce.t, '') AS t FROM mx m, LATERAL (SELECT unnest(range(nr + 1)) AS r) x, LATERAL (SELECT unnest(range(nc + 1)) AS c) y LEFT JOIN ce ON ce.table_id = m.table_id AND ce.r = x.r AND ce.c = y.c)"""


def grid_markdown(spark, sf):
    g = tables.as_grid(_cells(spark, sf), ["table_id"])
    return g.select("table_id", tables.grid_markdown(F.col("grid")).alias("markdown"), tables.grid_html(F.col("grid")).alias("html"))


def grid_filled(spark, sf):
    g = tables.as_grid(_cells(spark, sf), ["table_id"])
    return g.select("table_id", F.array_join(F.transform(tables.fill_blanks(F.col("grid")), lambda r: F.array_join(r, "|")), "/").alias("filled"))


def pivot_grid_csv(spark, sf):
    g = tables.as_grid(_cells(spark, sf), ["table_id"])
    return g.select("table_id", tables.grid_csv(F.col("grid")).alias("csv"))


def grid_records(spark, sf):
    g = tables.as_grid(_cells(spark, sf), ["table_id"])
    return g.select("table_id", F.size(tables.grid_records(F.col("grid"))).alias("n_records"))


def _fields(spark, sf):
    f = table(spark, sf, "form_fields").select("field_id", "document_id", "page", "field_type", "label", "value", "group_id", "is_checked", "confidence", "x1", "y1", "x2", "y2").distinct().filter("document_id is not null")
    mils = lambda c: (F.round(F.col(c) * 1000).cast("int") / F.lit(1024.0)).alias(c)
    return f.select(F.col("document_id").alias("doc_id"), "field_id", "field_type", "page", *[mils(c) for c in ("x1", "y1", "x2", "y2")], F.nullif(F.trim("label"), F.lit("")).alias("label"), "value", F.lit(None).cast("array<string>").alias("options"), "is_checked", "confidence", "group_id")


_FF = "fd AS (SELECT DISTINCT field_id, document_id, page, field_type, label, value, group_id, is_checked, confidence, x1, y1, x2, y2 FROM form_fields WHERE document_id IS NOT NULL), ff AS (SELECT document_id AS doc_id, field_id, field_type, page, " + ", ".join(f"round({c} * 1000)::INT / 1024.0::DOUBLE AS {c}" for c in ("x1", "y1", "x2", "y2")) + ", nullif(trim(label), '') AS label, value, is_checked, confidence, group_id FROM fd)"


def label_nearest(spark, sf):
    f = _fields(spark, sf).withColumn("label", F.when(F.col("field_id") % 2 == 0, F.lit(None)).otherwise(F.col("label")))
    return forms.nearest_label(f, _blocks(spark, sf)).select("field_id", "label")


def checkbox_groups(spark, sf):
    return forms.checkbox_groups(_fields(spark, sf)).select("field_id", "group_id")


def field_groups(spark, sf):
    return forms.groups(forms.checkbox_groups(_fields(spark, sf))).select("doc_id", "group_id", F.array_join(F.transform("fields", lambda x: x.cast("string")), ",").alias("fields"), "n")


def form_structure(spark, sf):
    s = forms.form_structure(_fields(spark, sf))
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))), ",")
    return s.select("doc_id", "n_fields", "has_signature", "complexity", text("by_field_type").alias("by_type"), text("by_page").alias("by_page"))


def _annotations(spark, sf):
    """Widgets made from line items: buttons, radios, text and signature fields."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    kind = F.when(k.isin(1, 2, 5), "Btn").when(k == 3, "Tx").when(k == 4, "Sig").otherwise("Ch")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), k.alias("ord"), F.lit(1).alias("page"), F.lit("Widget").alias("subtype"), kind.alias("field_type"), F.lit(0.1).alias("x1"), (k / 16.0).alias("y1"), F.lit(0.2).alias("x2"), (k / 16.0 + 0.03125).alias("y2"),
        F.when(F.col("l_returnflag") == "A", "/Yes").otherwise("/Off").alias("value"), (k <= 2).alias("radio"), F.concat(F.lit("g"), (F.col("l_orderkey") % 3).cast("string")).alias("field_name"),
        F.when(F.col("l_linestatus") == "F", "/On").otherwise("/Off").alias("state"), F.concat(F.lit("o"), k.cast("string")).alias("option_value"), F.lit(None).cast("string").alias("label"),
    )


def _no_images(spark):
    return spark.createDataFrame([], "doc_id bigint, ord int, page int, x1 double, y1 double, x2 double, y2 double, is_checked boolean")


def _sign_blocks(spark, sf):
    o = table(spark, sf, "orders")
    t = F.element_at(F.array(*map(F.lit, ["[x] agreed", "[ ] refused", "Name: ____", "please sign here x____", "nothing"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("block_ord"), t.alias("text"), F.lit(1).alias("page"), F.lit(0.1).alias("x1"), F.lit(0.5).alias("y1"), F.lit(0.4).alias("x2"), F.lit(0.53125).alias("y2"))


def detected_checkboxes(spark, sf):
    return forms.checkboxes(_annotations(spark, sf), _no_images(spark), _sign_blocks(spark, sf)).select("doc_id", "field_id", "label", "is_checked", "confidence")


def detected_radios(spark, sf):
    return forms.radio_buttons(_annotations(spark, sf)).select("doc_id", "field_id", "value", F.array_join("options", ",").alias("options"), "is_checked", "group_id")


def detected_text_fields(spark, sf):
    return forms.text_fields(_annotations(spark, sf), _lines(spark, sf).withColumn("ord", F.round(F.col("y1") * 8).cast("int")), _sign_blocks(spark, sf)).select("doc_id", "field_id", "label", "value", "confidence", "y1")


def detected_signatures(spark, sf):
    return forms.signatures(_annotations(spark, sf), _sign_blocks(spark, sf)).select("doc_id", "field_id", "label", "y1", "y2", "confidence")


def all_detected_fields(spark, sf):
    a, b = _annotations(spark, sf), _sign_blocks(spark, sf)
    found = forms.all_fields(forms.checkboxes(a, _no_images(spark), b), forms.radio_buttons(a), forms.signatures(a, b))
    return found.groupBy("field_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_checked", F.lit(False))).alias("n_checked"))


def _page_prints(spark, sf):
    """One fingerprint a page, of the first engine that read it."""
    p = _pages(spark, sf).filter("text is not null").groupBy(F.col("document_id").alias("doc_id"), "page").agg(F.min_by(F.length("text"), F.struct("engine_ord", "ocr_id")).alias("text_length"))
    k = (F.col("page") + F.col("text_length")).cast("bigint")
    return p.select("doc_id", "page", "text_length", ((k % 8) / 8.0).alias("alpha_ratio"), (k * 1_000_003 + F.floor(F.col("page") / 4) * 77_777_777).cast("bigint").alias("visual_hash"))


_PF = PAGES + ", pf0 AS (SELECT document_id AS doc_id, page, arg_min(length(text), {'o': engine_ord, 'i': ocr_id}) AS text_length FROM p WHERE text IS NOT NULL GROUP BY 1, 2), pf AS (SELECT *, ((page + text_length) % 8) / 8.0::DOUBLE AS alpha_ratio, ((page + text_length)::BIGINT * 1000003 + (page // 4) * 77777777)::BIGINT AS visual_hash FROM pf0)"
_SH = lambda a, b: f"(CASE WHEN greatest({a}, {b}) = 0 THEN 1.0::DOUBLE ELSE least({a}, {b})::DOUBLE / greatest({a}, {b}) END)"
_SEG = _PF + f""", w AS (SELECT *, lag(text_length) OVER d AS tl, lag(alpha_ratio) OVER d AS ar, lag(visual_hash) OVER d AS vh FROM pf WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
sm AS (SELECT doc_id, page, CASE WHEN tl IS NOT NULL THEN 0.3::DOUBLE * {_SH('text_length', 'tl')} + 0.1::DOUBLE * {_SH('alpha_ratio', 'ar')} + 0.6::DOUBLE * (1 - bit_count(xor(visual_hash, vh)) / 64.0::DOUBLE) END AS similarity FROM w),
sg AS (SELECT *, sum(CASE WHEN similarity < 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS segment FROM sm)"""


def segment_pages(spark, sf):
    return segments.segments(_page_prints(spark, sf)).withColumn("similarity", F.round("similarity", 6))


def segment_ranges(spark, sf):
    return segments.segment_pages(segments.segments(_page_prints(spark, sf)))


def mixed_precheck(spark, sf):
    return segments.mixed_documents(_page_prints(spark, sf)).withColumn("variance", F.round("variance", 6))


def chunk_documents(spark, sf):
    return segments.chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", "start", F.md5("text").alias("digest"))


def chunk_arrays(spark, sf):
    d = table(spark, sf, "form_fields").select("field_id", "value").distinct()
    c = d.select("field_id", F.explode(segments.chunk_array(F.col("value"), 60, 10)).alias("c"))
    return c.select("field_id", "c.start", "c.text")


def hashed_embeddings(spark, sf):
    d = table(spark, sf, "form_fields").select("field_id", "value").distinct()
    return d.select("field_id", segments.hashing_embedder(16)(F.col("value")).alias("e")).select("field_id", F.round(segments.dot(F.col("e"), F.col("e")), 4).alias("norm"))


def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return segments.nearest(v.filter("vec_id % 50 = 0"), v).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def ocr_route(spark, sf):
    p = _pages(spark, sf).withColumn("confidence", F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")))
    return segments.route(p, ["document_id", "page"]).withColumn("confidence", F.round("confidence", 6))


def ocr_ensemble(spark, sf):
    p = _pages(spark, sf).withColumn("confidence", F.round(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), 6))
    return segments.ensemble(p, ["document_id", "page"]).select("document_id", "page", "engine", "confidence", F.md5("text").alias("digest"))


def enhancement_plans(spark, sf):
    return _pages(spark, sf).select("ocr_id", F.array_join(segments.enhancement_plan(F.col("level")), ",").alias("steps"))


def text_fallback(spark, sf):
    p = _pages(spark, sf)
    j = p.groupBy("document_id", "page").agg(*[F.min(F.when(F.col("engine_ord") == n, F.col("text"))).alias(name) for n, name in enumerate("abc")])
    return j.select("document_id", "page", F.md5(segments.best_text(F.col("a"), F.col("b"), F.col("c"))).alias("digest"))


def _profiles(spark, sf):
    p = table(spark, sf, "doc_profiles").select("profile_id", "file_hash", "file_size", F.coalesce("page_count", F.lit(0)).alias("page_count"), "has_images", "has_tables", "has_forms", "is_scanned", "profiled_at").distinct()
    return p.withColumn("complexity", planning.complexity(F.col("file_size"), F.col("page_count"), F.col("has_images"), F.col("has_tables"), F.col("has_forms")))


_PR = """pr0 AS (SELECT DISTINCT profile_id, file_hash, file_size, coalesce(page_count, 0) AS page_count, has_images, has_tables, has_forms, is_scanned, profiled_at FROM doc_profiles),
pr1 AS (SELECT *, CASE WHEN file_size > 10485760 THEN 2 WHEN file_size > 1048576 THEN 1 ELSE 0 END + CASE WHEN page_count > 50 THEN 2 WHEN page_count > 10 THEN 1 ELSE 0 END + coalesce(has_images, false)::INT + coalesce(has_tables, false)::INT + coalesce(has_forms, false)::INT AS s FROM pr0),
pr AS (SELECT *, CASE WHEN s >= 5 THEN 'complex' WHEN s >= 2 THEN 'medium' ELSE 'simple' END AS complexity FROM pr1)"""


def complexity_of_profiles(spark, sf):
    return _profiles(spark, sf).select("profile_id", "complexity")


def plan_estimates(spark, sf):
    p = planning.plans(_profiles(spark, sf))
    return p.select("profile_id", "strategy", "workers", "image_pages", "dpi", "with_text", "with_tables", F.round("seconds", 6).alias("seconds"), F.round("memory_mb", 6).alias("memory_mb"))


def adaptive_plans(spark, sf):
    p = _profiles(spark, sf)
    a = planning.adaptive_plan(F.col("page_count"), F.col("complexity"), F.coalesce("is_scanned", F.lit(False)), F.coalesce("has_images", F.lit(False)))
    return p.select("profile_id", a.alias("a")).select("profile_id", "a.*")


def recent_history(spark, sf):
    p = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return planning.recent(p, F.struct("ts", "event_id").desc(), 3, "user_id").select("user_id", "event_id")


def cache_priorities(spark, sf):
    p = _profiles(spark, sf)
    v = planning.cache_priority(F.col("complexity"), F.col("page_count"), F.coalesce("file_size", F.lit(0)))
    return p.select("profile_id", F.round(v, 6).alias("priority"), planning.admit(F.coalesce("file_size", F.lit(0)) / planning.MB, v, 64.0).alias("admitted"))


def cache_eviction(spark, sf):
    p = _profiles(spark, sf).filter("file_hash is not null").groupBy("file_hash").agg(F.max(F.coalesce("file_size", F.lit(0))).alias("size"), F.max("page_count").alias("pages"))
    size = F.floor(F.col("size") / 1024) / 1024.0
    e = p.select("file_hash", size.alias("size_mb"), F.round(planning.eviction_score(F.col("pages") * 0 + 9.0, F.col("pages"), F.lit(1.0), size), 6).alias("score"))
    return planning.evictions(e, 512.0)


def cache_predict(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return planning.predict_hits(e, "user_id", "ts", now).withColumn("probability", F.round("probability", 5))


def cache_misses(spark, sf):
    p = _profiles(spark, sf).select("profile_id", "file_hash", "page_count").filter("file_hash is not null")
    done = p.filter("page_count > 3").select("file_hash").distinct()
    return planning.misses(p, done).select("profile_id", "file_hash")


def dedup_by_sha256(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def cache_stats(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses"))
    return g.agg(F.count(F.lit(1)).alias("entries"), F.sum("accesses").alias("accesses"), F.round(F.avg("accesses"), 6).alias("mean"), F.round(F.count(F.lit(1)) / 4096.0, 6).alias("utilisation"))


def resource_advice(spark, sf):
    p = table(spark, sf, "part")
    w = planning.workers(F.col("p_size"), F.lit(16), F.col("p_partkey") % 100, F.lit(8192), F.col("p_size") * 40 + 1, F.lit(12))
    return p.select("p_partkey", w.alias("workers"), planning.resolution(F.lit(300), F.col("p_size") * 20, F.lit(700)).alias("dpi"))


QUERIES = {
    f.__name__: f
    for f in (
        structure_elements, list_and_note_marks, heading_parent, heading_children, cross_references, toc_links, layout_histogram, layout_valleys, layout_columns, reading_order, layout_sections, page_margins, quantised_columns,
        region_types, merged_boxes, borderless_tables, cell_texts, grid_rectangles, adjacent_rectangles, tables_without_overlap, separator_cells, aligned_clusters, structure_objects, table_row_clean, grid_markdown, grid_filled,
        pivot_grid_csv, grid_records, label_nearest, checkbox_groups, field_groups, form_structure, detected_checkboxes, detected_radios, detected_text_fields, detected_signatures, all_detected_fields, segment_pages, segment_ranges,
        mixed_precheck, chunk_documents, chunk_arrays, hashed_embeddings, cosine_topk, ocr_route, ocr_ensemble, enhancement_plans, text_fallback, complexity_of_profiles, plan_estimates, adaptive_plans, recent_history,
        cache_priorities, cache_eviction, cache_predict, cache_misses, dedup_by_sha256, cache_stats, resource_advice,
    )
}

_PARENT = """x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, block_ord) AS pos FROM g),
pa AS (SELECT a.doc_id, a.element_id, a.page, a.y1, a.block_ord, (SELECT arg_max(h.element_id, h.pos) FROM x h WHERE h.doc_id = a.doc_id AND h.element_type = 'heading' AND h.pos < a.pos AND (a.element_type <> 'heading' OR h.level < a.level)) AS parent_element FROM x a)"""
_AN = """an AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_linenumber IN (1, 2, 5) THEN 'Btn' WHEN l_linenumber = 3 THEN 'Tx' WHEN l_linenumber = 4 THEN 'Sig' ELSE 'Ch' END AS field_type, l_linenumber / 16.0::DOUBLE AS y1, l_linenumber / 16.0::DOUBLE + 0.03125::DOUBLE AS y2,
 CASE WHEN l_returnflag = 'A' THEN '/Yes' ELSE '/Off' END AS value, l_linenumber <= 2 AS radio, 'g' || (l_orderkey % 3) AS field_name, CASE WHEN l_linestatus = 'F' THEN '/On' ELSE '/Off' END AS state, 'o' || l_linenumber AS option_value FROM lineitem),
sb AS (SELECT o_orderkey AS doc_id, (['[x] agreed', '[ ] refused', 'Name: ____', 'please sign here x____', 'nothing'])[o_orderkey % 5 + 1] AS text FROM orders)"""
_CHK = "ck AS (SELECT doc_id, 'checkbox_' || ord AS field_id, NULL AS label, value = '/Yes' AS is_checked, 0.9::DOUBLE AS confidence FROM an WHERE field_type = 'Btn' UNION ALL SELECT doc_id, 'checkbox_1', text, text LIKE '[x]%', 0.6 FROM sb WHERE (text LIKE '[x]%' OR text LIKE '[ ]%') AND doc_id NOT IN (SELECT doc_id FROM an WHERE field_type = 'Btn'))"
_RAD = """ra0 AS (SELECT *, max(CASE WHEN state <> '/Off' THEN option_value END) OVER (PARTITION BY doc_id, field_name) AS v, string_agg(option_value, ',' ORDER BY ord) OVER (PARTITION BY doc_id, field_name) AS opts, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY ord) - 1 AS n FROM an WHERE field_type = 'Btn' AND radio)"""
_SIG = "si AS (SELECT doc_id, 'signature_' || ord AS field_id, NULL AS label, y1, y2, 0.9::DOUBLE AS confidence FROM an WHERE field_type = 'Sig' UNION ALL SELECT doc_id, 'signature_t1', text, 0.53125, 0.53125::DOUBLE + 0.05::DOUBLE, 0.7 FROM sb WHERE contains(lower(text), 'sign') AND (contains(lower(text), 'x') OR contains(lower(text), '_')))"
_C = "round(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 6)"
_GRIDS = "gl AS (SELECT table_id, r, list(t ORDER BY c) AS row_ FROM full_ GROUP BY 1, 2)"

def _chunk_sql(source: str, key: str, size: int, overlap: int) -> str:
    """Chunks by a walk: each ends after the last mark of the best kind in it, if the next one then starts later than it."""
    place = lambda mark: f"length(regexp_extract(substring(t, at_ + 1, {size}), '(?s)^.*{mark}'))"
    cut = "coalesce(" + ", ".join(f"CASE WHEN {place(m)} > {n} AND {place(m)} > {overlap} THEN {place(m)} END" for m, n in ((r"\n\n", 2), (r"\.\n", 2), (r"\. ", 2), (r"\n", 1))) + f", {size})"
    end = f"CASE WHEN at_ + {size} >= length(t) THEN length(t) ELSE at_ + {cut} END"
    return f"""WITH RECURSIVE d AS ({source}), s AS (SELECT {key}, i, at_, {end} AS end_ FROM (SELECT {key}, t, 0 AS i, 0 AS at_ FROM d WHERE length(t) > 0)
 UNION ALL SELECT {key}, i, at_, {end} FROM (SELECT s.{key}, d.t, s.i + 1 AS i, s.end_ - {overlap} AS at_ FROM s JOIN d ON s.{key} = d.{key} WHERE s.end_ < length(d.t))),
r AS (SELECT s.{key}, s.i, s.at_, substring(d.t, s.at_ + 1, s.end_ - s.at_) AS piece, count(*) OVER (PARTITION BY s.{key}) AS n FROM s JOIN d ON s.{key} = d.{key})"""


_FB = "fb AS (SELECT document_id, page, min(text) FILTER (engine_ord = 0) AS a, min(text) FILTER (engine_ord = 1) AS b, min(text) FILTER (engine_ord = 2) AS c FROM p GROUP BY 1, 2)"
_RD = lambda c: "coalesce(" + READABLE.replace("text", c) + ", false)"
_LONG = lambda c: f"length({_strip(c)}) > 10"
SQL = {
    "dates_of_all_forms": "SELECT o_orderkey, repeat(o_orderdate::DATE::VARCHAR || ',', 4) || o_orderdate::DATE::VARCHAR AS days FROM orders",
    "list_and_note_marks": f"""WITH {_BL}, n AS (SELECT *, {_strip("coalesce(text, '')")} = '' AS blank, regexp_extract(coalesce(text, ''), '^({WS}*(?:[0-9]+\\.|\\([a-zA-Z0-9]+\\)|[a-zA-Z0-9]+[.)])){WS}+', 1) AS num, contains('{structure.BULLETS}', left(text, 1)) AND text <> '' AS bullet FROM b)
SELECT doc_id, block_ord, CASE WHEN blank THEN NULL WHEN bullet THEN 'bulleted' WHEN num <> '' THEN 'numbered' END AS list_type, CASE WHEN blank THEN NULL WHEN bullet THEN left(text, 1) WHEN num <> '' THEN {_strip('num')} END AS marker,
 CASE WHEN y1 > 0.8 AND NOT blank THEN nullif(regexp_extract(text, '{structure.FOOTNOTE}'), '') END AS note FROM n""",
    "chunk_documents": _chunk_sql("SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL", "doc_id", 1000, 100) + " SELECT doc_id, i AS chunk_index, n AS total_chunks, at_ AS start, md5(piece) AS digest FROM r",
    "chunk_arrays": _chunk_sql("SELECT DISTINCT field_id, value AS t FROM form_fields WHERE value IS NOT NULL", "field_id", 60, 10) + " SELECT field_id, at_ AS start, piece AS text FROM r",
    "text_fallback": f"""WITH {PAGES}, {_FB} SELECT document_id, page, md5(CASE WHEN length(coalesce({_strip('a')}, '')) <= 10 THEN coalesce(CASE WHEN {_LONG('c')} THEN c END, CASE WHEN {_LONG('b')} THEN b END, a)
 WHEN (length(a) - length(replace(a, '(cid:', ''))) / 5 > 10 AND (length(a) - length(replace(a, '(cid:', ''))) / 5 / (length(a) / 100.0) > 0.1 THEN coalesce(CASE WHEN {_RD('c')} AND {CID.replace('text', 'c')} < {CID.replace('text', 'a')} THEN c END, CASE WHEN {_RD('b')} THEN b END, a)
 WHEN NOT {_RD('a')} THEN coalesce(CASE WHEN {_RD('b')} THEN b END, a) ELSE a END) AS digest FROM fb""",
    "structure_elements": f"WITH {_FOUND} SELECT doc_id, element_id, element_type, level, CASE element_type WHEN 'heading' THEN 0.9 WHEN 'paragraph' THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM g",
    "heading_parent": f"WITH {_FOUND}, {_PARENT} SELECT doc_id, element_id, parent_element FROM pa",
    "heading_children": f"WITH {_FOUND}, {_PARENT} SELECT doc_id, parent_element AS element_id, string_agg(element_id, ',' ORDER BY page, y1, block_ord) AS child_ids FROM pa WHERE parent_element IS NOT NULL GROUP BY 1, 2",
    "cross_references": """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS doc_id, 'paragraph_4' AS element_id, 'section' AS kind, (k % 4 + 1)::VARCHAR AS number, 'heading_3' AS target FROM o
UNION ALL SELECT k, 'paragraph_4', 'table', (k % 3)::VARCHAR, 'paragraph_5' FROM o WHERE k % 3 = k % 2 UNION ALL SELECT k, 'paragraph_5', 'table', (k % 2)::VARCHAR, 'paragraph_5' FROM o
UNION ALL SELECT k, 'paragraph_4', 'figure', '8', 'paragraph_6' FROM o UNION ALL SELECT k, 'paragraph_6', 'figure', '8', 'paragraph_6' FROM o""",
    "toc_links": """SELECT o_orderkey AS doc_id, 'paragraph_1' AS element_id, (o_orderkey % 4 + 1)::VARCHAR AS number, 'Results' AS title, (o_orderkey % 9)::INT AS page_number, 'heading_3' AS heading FROM orders
UNION ALL SELECT o_orderkey, 'paragraph_2', '2', 'Nothing here', 12, NULL FROM orders""",
    "layout_histogram": f"WITH {_HIST} SELECT doc_id, page, bin, n FROM h WHERE n > 0",
    "layout_valleys": f"WITH {_VAL} SELECT doc_id, page, valley FROM v",
    "layout_columns": f"WITH {_COL} SELECT doc_id, page, elem_id, \"column\" FROM c",
    "reading_order": f"WITH {_COL} SELECT doc_id, page, elem_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY \"column\" NULLS LAST, y1, ord) AS position FROM c",
    "layout_sections": f"""WITH {_LAY}, hd AS (SELECT doc_id, page, elem_id AS header_id, y2 AS hy, coalesce(lead(y1) OVER (PARTITION BY doc_id, page ORDER BY y1, ord), 1.0) AS he FROM a WHERE element_type = 'heading' AND y2 - y1 > 0.015)
SELECT a.doc_id, a.page, header_id, elem_id FROM a JOIN hd ON a.doc_id = hd.doc_id AND a.page = hd.page AND (elem_id = header_id OR y1 >= hy AND y1 < he) UNION ALL SELECT doc_id, page, NULL, elem_id FROM a ANTI JOIN hd USING (doc_id, page)""",
    "page_margins": f"WITH {_LAY} SELECT doc_id, page, min(x1) AS \"left\", min(y1) AS top, max(x2) AS \"right\", max(y2) AS bottom, count(*) FILTER (y1 < 0.1) AS n_head, count(*) FILTER (y2 > 0.9) AS n_foot, 1 - max(x2) AS right_margin, 1 - max(y2) AS bottom_margin FROM a GROUP BY 1, 2",
    "quantised_columns": f"""WITH {_LAY}, k AS (SELECT DISTINCT doc_id, page, floor((x1 + x2) / 2 * 10)::INT AS key FROM a), i AS (SELECT *, CASE WHEN key - lag(key) OVER (PARTITION BY doc_id, page ORDER BY key) > 1 THEN 1 ELSE 0 END AS g FROM k),
j AS (SELECT *, sum(g) OVER (PARTITION BY doc_id, page ORDER BY key) AS island FROM i) SELECT a.doc_id, a.page, elem_id, island::BIGINT AS island FROM a JOIN j ON a.doc_id = j.doc_id AND a.page = j.page AND floor((x1 + x2) / 2 * 10)::INT = key""",
    "region_types": f"WITH {_LAY}, r AS (SELECT doc_id, elem_id, x2 - x1 AS w, y2 - y1 AS h FROM a) SELECT doc_id, elem_id, CASE WHEN w / h > 3 THEN 'text' WHEN w / h < 0.5 THEN 'list' ELSE 'block' END AS contour, CASE WHEN w / h > 3 AND h < 1.0 / 20 THEN 'header' WHEN w / h > 2 THEN 'paragraph' WHEN w > 1.0 / 3 AND h > 1.0 / 5 THEN 'figure' ELSE 'text' END AS classical FROM r",
    "merged_boxes": f"WITH {_LAY} SELECT doc_id, page, element_type, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "borderless_tables": f"WITH {_BORD} SELECT * FROM t",
    "cell_texts": f"""WITH {_BORD}, cl AS (SELECT t.doc_id, t.page, r."row", c.col, x1 + (x2 - x1) / n_cols * c.col AS cx1, x1 + (x2 - x1) / n_cols * (c.col + 1) AS cx2, y1 + (y2 - y1) / n_rows * r."row" AS cy1, y1 + (y2 - y1) / n_rows * (r."row" + 1) AS cy2 FROM t, LATERAL (SELECT unnest(range(n_rows))::INT AS "row") r, LATERAL (SELECT unnest(range(n_cols))::INT AS col) c)
SELECT cl.doc_id, cl.page, "row", col, coalesce(string_agg(g.text, ' ' ORDER BY g.block_ord, g.text), '') AS text, "row" = 0 AS is_header FROM cl LEFT JOIN g ON g.doc_id = cl.doc_id AND g.page = cl.page AND g.x1 < cx2 AND g.x2 > cx1 AND g.y1 < cy2 AND g.y2 > cy1 GROUP BY 1, 2, 3, 4""",
    "grid_rectangles": f"""WITH {_LINES}, s AS (SELECT doc_id, count(*) AS nh, count(*) FILTER (n % 2 = 0) AS nv, min(n / 8.0::DOUBLE) AS y1, max(n / 8.0::DOUBLE) AS y2, min(n / 8.0::DOUBLE) FILTER (n % 2 = 0) AS x1, max(n / 8.0::DOUBLE) FILTER (n % 2 = 0) AS x2 FROM li GROUP BY 1)
SELECT doc_id, 1 AS page, x1, y1, x2, y2, nh - 1 AS n_rows, nv - 1 AS n_cols FROM s WHERE nh >= 2 AND nv >= 2 AND x2 - x1 >= 0.1 AND y2 - y1 >= 0.05""",
    "adjacent_rectangles": f"""WITH {_LINES}, y AS (SELECT doc_id, n / 8.0::DOUBLE AS y1, lead(n / 8.0::DOUBLE) OVER (PARTITION BY doc_id ORDER BY n) AS y2 FROM li), x AS (SELECT doc_id, n / 8.0::DOUBLE AS x1, lead(n / 8.0::DOUBLE) OVER (PARTITION BY doc_id ORDER BY n) AS x2 FROM li WHERE n % 2 = 0)
SELECT doc_id, 1 AS page, x1, x2, y1, y2 FROM x JOIN y USING (doc_id) WHERE x2 IS NOT NULL AND y2 IS NOT NULL""",
    "tables_without_overlap": f"""WITH {_BORD}, {_LINES}, s AS (SELECT doc_id, count(*) AS nh, count(*) FILTER (n % 2 = 0) AS nv, min(n / 8.0::DOUBLE) AS y1, max(n / 8.0::DOUBLE) AS y2, min(n / 8.0::DOUBLE) FILTER (n % 2 = 0) AS x1, max(n / 8.0::DOUBLE) FILTER (n % 2 = 0) AS x2 FROM li GROUP BY 1),
k AS (SELECT doc_id, 1 AS page, x1, y1, x2, y2 FROM s WHERE nh >= 2 AND nv >= 2 AND x2 - x1 >= 0.1 AND y2 - y1 >= 0.05)
SELECT *, 'bordered' AS kind FROM k UNION ALL SELECT doc_id, page, x1, y1, x2, y2, 'borderless' FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = t.doc_id AND k.page = t.page AND t.x1 < k.x2 AND t.x2 > k.x1 AND t.y1 < k.y2 AND t.y2 > k.y1)""",
    "separator_cells": """WITH s AS (SELECT DISTINCT l_orderkey AS table_id, l_linenumber AS n FROM lineitem), t AS (SELECT DISTINCT table_id FROM s), ra AS (SELECT table_id, n / 8.0::DOUBLE AS a FROM s WHERE n % 2 = 0 UNION SELECT table_id, 0.0 FROM t), ca AS (SELECT table_id, n / 8.0::DOUBLE AS a FROM s WHERE n % 2 = 1 UNION SELECT table_id, 0.0 FROM t),
r AS (SELECT table_id, row_number() OVER w - 1 AS "row", a AS y1, coalesce(lead(a) OVER w, 1.0) AS y2, count(*) OVER (PARTITION BY table_id) > 1 AS b FROM ra WINDOW w AS (PARTITION BY table_id ORDER BY a)), c AS (SELECT table_id, row_number() OVER w - 1 AS col, a AS x1, coalesce(lead(a) OVER w, 1.0) AS x2 FROM ca WINDOW w AS (PARTITION BY table_id ORDER BY a))
SELECT table_id, "row", y1, y2, col, x1, x2, CASE WHEN b THEN 'bordered' ELSE 'borderless' END AS structure_type FROM r JOIN c USING (table_id)""",
    "structure_objects": """WITH o AS (SELECT l_orderkey AS table_id, (['column', 'row', 'cell', NULL])[l_linenumber % 4 + 1] AS kind, l_discount * 10 AS score FROM lineitem)
SELECT table_id, count(*) FILTER (kind = 'column') AS n_columns, count(*) FILTER (kind = 'row') AS n_rows, count(*) FILTER (kind = 'cell') AS n_cells, round(avg(score), 6) AS confidence FROM o WHERE score > 0.5 GROUP BY 1""",
    "table_row_clean": f"WITH {_RAW} SELECT table_id, array_to_string(header, '|') AS header, len(data) AS n_rows, array_to_string(list_transform(data, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '~')), '|')), chr(10)) AS data FROM k",
    "grid_markdown": f"""WITH {_CELLS}, {_GRIDS} SELECT table_id, string_agg(CASE WHEN r = 0 THEN '| ' || array_to_string(row_, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(row_, lambda x: '---'), ' | ') || ' |' ELSE '| ' || array_to_string(row_, ' | ') || ' |' END, chr(10) ORDER BY r) AS markdown,
 '<table>' || string_agg('<tr>' || array_to_string(list_transform(row_, lambda x: CASE WHEN r = 0 THEN '<th>' || x || '</th>' ELSE '<td>' || x || '</td>' END), '') || '</tr>', '' ORDER BY r) || '</table>' AS html FROM gl GROUP BY 1""",
    "grid_filled": f"WITH {_CELLS} SELECT table_id, string_agg(x, '/' ORDER BY r) AS filled FROM (SELECT table_id, r, string_agg(CASE WHEN t = '' THEN 'R' || r || 'C' || c ELSE t END, '|' ORDER BY c) AS x FROM full_ GROUP BY 1, 2) GROUP BY 1",
    "pivot_grid_csv": f"WITH {_CELLS} SELECT table_id, string_agg(x, chr(10) ORDER BY r) AS csv FROM (SELECT table_id, r, string_agg(CASE WHEN contains(t, ',') THEN '\"' || t || '\"' ELSE t END, ',' ORDER BY c) AS x FROM full_ GROUP BY 1, 2) GROUP BY 1",
    "grid_records": f"WITH {_CELLS} SELECT table_id, max(r) AS n_records FROM full_ GROUP BY 1",
    "label_nearest": f"""WITH {_FF}, {_BL}, q AS (SELECT *, CASE WHEN field_id % 2 = 0 THEN NULL ELSE label END AS lab FROM ff), h AS (SELECT q.field_id, b.text, b.block_ord, sqrt(((q.x1 + q.x2) / 2 - (b.x1 + b.x2) / 2) * ((q.x1 + q.x2) / 2 - (b.x1 + b.x2) / 2) + ((q.y1 + q.y2) / 2 - (b.y1 + b.y2) / 2) * ((q.y1 + q.y2) / 2 - (b.y1 + b.y2) / 2)) AS d FROM q JOIN b ON q.doc_id = b.doc_id AND q.page = b.page AND (b.x2 < q.x1 OR b.y2 < q.y1) WHERE q.lab IS NULL),
m AS (SELECT field_id, arg_min({{'t': text}}, {{'d': d, 'o': block_ord}}).t AS found FROM h WHERE d < 0.2 GROUP BY 1) SELECT q.field_id, coalesce(lab, nullif(regexp_replace(regexp_replace({_strip('found')}, ':+$', ''), '{WS}+$', ''), '')) AS label FROM q LEFT JOIN m USING (field_id)""",
    "checkbox_groups": f"WITH {_FF}, m AS (SELECT *, CASE WHEN field_type = 'checkbox' AND label IS NOT NULL THEN {_strip(chr(115) + 'plit_part(label, ' + chr(39) + '[' + chr(39) + ', 1)')} END AS mn FROM ff), n AS (SELECT *, count(mn) OVER (PARTITION BY doc_id, mn) AS c FROM m) SELECT field_id, CASE WHEN mn IS NOT NULL AND c > 1 THEN 'checkbox_group_' || mn ELSE group_id END AS group_id FROM n",
    "field_groups": f"WITH {_FF}, m AS (SELECT *, CASE WHEN field_type = 'checkbox' AND label IS NOT NULL THEN {_strip(chr(115) + 'plit_part(label, ' + chr(39) + '[' + chr(39) + ', 1)')} END AS mn FROM ff), n AS (SELECT *, count(mn) OVER (PARTITION BY doc_id, mn) AS c FROM m), g AS (SELECT doc_id, field_id, CASE WHEN mn IS NOT NULL AND c > 1 THEN 'checkbox_group_' || mn ELSE group_id END AS group_id FROM n) SELECT doc_id, group_id, string_agg(field_id::VARCHAR, ',' ORDER BY field_id) AS fields, count(*) AS n FROM g WHERE group_id IS NOT NULL GROUP BY 1, 2",
    "form_structure": f"""WITH {_FF}, a AS (SELECT doc_id, count(*) AS n_fields, coalesce(bool_or(field_type = 'signature'), false) AS has_signature FROM ff GROUP BY 1), t AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS by_type FROM (SELECT doc_id, field_type || '=' || count(*) AS x FROM ff WHERE field_type IS NOT NULL GROUP BY doc_id, field_type) GROUP BY 1),
p AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS by_page FROM (SELECT doc_id, page || '=' || count(*) AS x FROM ff WHERE page IS NOT NULL GROUP BY doc_id, page) GROUP BY 1) SELECT a.doc_id, n_fields, has_signature, CASE WHEN n_fields < 5 THEN 'simple' WHEN n_fields < 20 THEN 'moderate' ELSE 'complex' END AS complexity, by_type, by_page FROM a LEFT JOIN t USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "detected_checkboxes": f"WITH {_AN}, {_CHK} SELECT * FROM ck",
    "detected_radios": f"WITH {_AN}, {_RAD} SELECT doc_id, 'radio_' || field_name || '_' || n AS field_id, v AS value, string_agg(option_value, ',') OVER (PARTITION BY doc_id, field_name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS options, coalesce(option_value = v, false) AS is_checked, field_name AS group_id FROM ra0",
    "detected_text_fields": f"""WITH {_AN}, {_LINES}, t1 AS (SELECT doc_id, 'text_' || ord AS field_id, NULL AS label, value, 0.9::DOUBLE AS confidence, y1 FROM an WHERE field_type IN ('Tx', 'Ch')), t2 AS (SELECT doc_id, 'text_' || n, NULL, '', 0.7, n / 8.0::DOUBLE - 0.02::DOUBLE FROM li WHERE doc_id NOT IN (SELECT doc_id FROM t1)),
t3 AS (SELECT doc_id, 'text_1', CASE WHEN text LIKE 'Name%' THEN 'Name' ELSE 'please sign here x' END, NULL, 0.6, 0.5 FROM sb WHERE contains(text, '___') AND doc_id NOT IN (SELECT doc_id FROM t1) AND doc_id NOT IN (SELECT doc_id FROM t2)) SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3""",
    "detected_signatures": f"WITH {_AN}, {_SIG} SELECT * FROM si",
    "all_detected_fields": f"WITH {_AN}, {_CHK}, {_RAD}, {_SIG} SELECT 'checkbox' AS field_type, count(*) AS n, count(*) FILTER (is_checked) AS n_checked FROM ck UNION ALL SELECT 'radio', count(*), count(*) FILTER (coalesce(option_value = v, false)) FROM ra0 UNION ALL SELECT 'signature', count(*), 0 FROM si",
    "segment_pages": f"WITH {_SEG} SELECT doc_id, page, round(similarity, 6) AS similarity, segment::BIGINT AS segment FROM sg",
    "segment_ranges": f"WITH {_SEG}, r AS (SELECT doc_id, segment::BIGINT AS segment, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM sg GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_segments FROM r",
    "mixed_precheck": f"""WITH {_PF}, q AS (SELECT doc_id, visual_hash, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pf), t AS (SELECT * FROM q WHERE n > 10 AND list_contains(list_transform(range(10), lambda k: (k * (n - 1)) // 9), i)),
v AS (SELECT a.doc_id, var_pop(bit_count(xor(a.visual_hash, b.visual_hash))) / 64.0::DOUBLE AS variance FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY 1) SELECT d.doc_id, round(variance, 6) AS variance, coalesce(variance > 0.05, false) AS mixed FROM (SELECT DISTINCT doc_id FROM pf) d LEFT JOIN v USING (doc_id)""",
    "cosine_topk": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "ocr_route": f"""WITH {PAGES}, r AS (SELECT *, {_C} AS c, CASE level WHEN 'high' THEN list_position(['tesseract', 'doctr', 'easyocr'], engine) WHEN 'medium' THEN list_position(['doctr', 'easyocr', 'tesseract'], engine) WHEN 'low' THEN list_position(['easyocr', 'doctr', 'tesseract'], engine) END AS o FROM p), s AS (SELECT *, coalesce(c >= 0.7, false) AS ok FROM r WHERE o > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY ok DESC, CASE WHEN ok THEN o END NULLS FIRST, o DESC) AS k FROM s) SELECT document_id, page, engine, c AS confidence, ok AS passed, NOT ok AND level = 'low' AS use_vlm FROM n WHERE k = 1""",
    "ocr_ensemble": f"""WITH RECURSIVE {PAGES}, g AS (SELECT document_id, page, engine_ord, engine, coalesce({_C}, 0) AS c, {_C} AS raw, text, row_number() OVER (PARTITION BY document_id, page ORDER BY engine_ord, engine, {_C} NULLS FIRST, text) AS k FROM p WHERE length(trim(coalesce(text, ''))) > 0),
b AS (SELECT document_id, page, 0 AS k, arg_min({{'e': engine, 'c': raw, 't': text}}, {{'c': -c, 'o': k}}) AS best FROM g GROUP BY 1, 2 UNION ALL SELECT b.document_id, b.page, g.k, CASE WHEN g.c >= 0.9::DOUBLE * coalesce(b.best.c, 0) AND length(g.text) > 1.2::DOUBLE * length(b.best.t) THEN {{'e': g.engine, 'c': g.raw, 't': g.text}} ELSE b.best END FROM b JOIN g ON g.document_id = b.document_id AND g.page = b.page AND g.k = b.k + 1)
SELECT document_id, page, r.e AS engine, r.c AS confidence, md5(r.t) AS digest FROM (SELECT document_id, page, arg_max(best, k) AS r FROM b GROUP BY 1, 2)""",
    "enhancement_plans": f"WITH {PAGES} SELECT ocr_id, CASE WHEN level = 'high' THEN 'light_contrast' ELSE 'shadow,background,deskew,upscaling,denoise,contrast' END AS steps FROM p",
    "complexity_of_profiles": f"WITH {_PR} SELECT profile_id, complexity FROM pr",
    "plan_estimates": f"""WITH {_PR}, st AS (SELECT * FROM (VALUES ('fast', 8, 3, 150, true, 0.5), ('accurate', 2, NULL, 300, true, 2.0), ('balanced', 4, 10, 200, true, 1.0), ('tables', 2, 0, 150, false, 0.3), ('text', 1, 0, 150, true, 0.2)) v(strategy, workers, ip, dpi, with_text, f)),
x AS (SELECT *, CASE WHEN strategy = 'balanced' THEN least(page_count, 10) ELSE ip END AS image_pages FROM pr, st)
SELECT profile_id, strategy, workers, image_pages, dpi, with_text, CASE strategy WHEN 'tables' THEN true WHEN 'text' THEN false WHEN 'accurate' THEN true ELSE has_tables END AS with_tables,
 round(page_count * 1.5::DOUBLE * CASE complexity WHEN 'complex' THEN 2.0 WHEN 'medium' THEN 1.5 ELSE 1.0 END::DOUBLE / greatest(least(workers, page_count) * 0.7::DOUBLE, 1.0::DOUBLE) * f::DOUBLE, 6) AS seconds,
 round(CASE strategy WHEN 'tables' THEN 200.0 WHEN 'text' THEN 100.0 ELSE 100 + least(page_count, CASE WHEN coalesce(image_pages, 0) = 0 THEN page_count ELSE image_pages END) * (dpi / 200.0::DOUBLE) * (dpi / 200.0::DOUBLE) * 50 END::DOUBLE, 6) AS memory_mb FROM x""",
    "adaptive_plans": f"WITH {_PR} SELECT profile_id, CASE WHEN page_count <= 5 THEN 2 WHEN page_count <= 20 THEN 4 ELSE 6 END AS workers, CASE WHEN coalesce(is_scanned, false) THEN page_count WHEN coalesce(has_images, false) THEN least(page_count, 10) ELSE 3 END AS image_pages, CASE WHEN coalesce(is_scanned, false) THEN 300 WHEN coalesce(has_images, false) THEN 200 ELSE 150 END AS dpi, complexity IN ('medium', 'complex') AS use_model FROM pr",
    "recent_history": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3",
    "cache_priorities": f"""WITH {_PR}, v AS (SELECT profile_id, coalesce(file_size, 0) AS fs, CASE complexity WHEN 'complex' THEN 2.0 WHEN 'medium' THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN page_count > 50 THEN 1.5 WHEN page_count > 20 THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN coalesce(file_size, 0) > 10485760 THEN 0.7 ELSE 1.0 END::DOUBLE AS p FROM pr)
SELECT profile_id, round(p, 6) AS priority, CASE WHEN fs / 1048576 > 32 THEN false WHEN p > 2 THEN true ELSE p > 0.1 * (fs / 1048576) END AS admitted FROM v""",
    "cache_eviction": f"""WITH {_PR}, h AS (SELECT file_hash, floor(max(coalesce(file_size, 0)) / 1024) / 1024.0::DOUBLE AS mb, max(page_count) AS pages FROM pr WHERE file_hash IS NOT NULL GROUP BY 1), s AS (SELECT *, round(0.3::DOUBLE / 10 + 0.3::DOUBLE * pages + 0.3::DOUBLE - 0.1::DOUBLE * mb, 6) AS score FROM h)
SELECT file_hash, score, sum(mb) OVER (ORDER BY score DESC, file_hash ROWS UNBOUNDED PRECEDING) > 512 AS evicted FROM s""",
    "cache_predict": "WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), a AS (SELECT user_id, avg(gap) AS m, max(t) AS l FROM g GROUP BY 1) SELECT user_id, round(CASE WHEN m IS NULL OR m = 0 THEN 0.0 ELSE greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-02-01') / 1e6 - l) / m) END, 5) AS probability FROM a",
    "cache_misses": f"WITH {_PR}, p AS (SELECT profile_id, file_hash, page_count FROM pr WHERE file_hash IS NOT NULL) SELECT profile_id, file_hash FROM p WHERE file_hash NOT IN (SELECT file_hash FROM p WHERE page_count > 3)",
    "dedup_by_sha256": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "cache_stats": "WITH g AS (SELECT user_id, count(*) AS a FROM events GROUP BY 1) SELECT count(*) AS entries, sum(a)::BIGINT AS accesses, round(avg(a), 6) AS mean, round(count(*) / 4096.0::DOUBLE, 6) AS utilisation FROM g",
    "resource_advice": "SELECT p_partkey, greatest(1, least(p_size, floor(16 * (1 - (p_partkey % 100) / 100::DOUBLE)), floor(0.8::DOUBLE * 8192 / (p_size * 40 + 1)), 12))::INT AS workers, CASE WHEN 700 <= p_size * 20 THEN 300 ELSE greatest(150, floor(300 * sqrt(p_size * 20 / 700.0::DOUBLE)))::INT END AS dpi FROM part",
}
