"""Queries of the general operators: hierarchies and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import hierarchy, nested
from papyra.session import table


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.subtree_sizes(hierarchy.resolve_parents(table(spark, sf, "elements")))


def _unplaced(spark: SparkSession, sf: str) -> DataFrame:
    sized = _sized(spark, sf)
    return hierarchy.unplaced(sized, hierarchy.preorder(sized, None))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The elements left over when sizes have gone upward and ranges downward."""
    return _unplaced(spark, sf).select(F.col("doc").alias("document_id"), "id")


def p5_tree(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy.preorder(_sized(spark, sf))
    return tree.select(F.col("doc").alias("document_id"), "id", "parent", "root", "depth", "size", "pre", "last", "path")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.preorder(_sized(spark, sf))).withColumnRenamed("doc", "document_id")


def p5_loops(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.loops(_unplaced(spark, sf)).withColumnRenamed("doc", "document_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    cells = nested.positions(nested.classify(table(spark, sf, "extraction_records")))
    return cells.filter("row_num is not null and col_num is not null").filter(F.col("text").rlike(r"(?U)\S")).select("record_id", "table_id", "row_num", "col_num").distinct()


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    return nested.records(nested.classify(table(spark, sf, "extraction_records")))


def p7_tables(spark: SparkSession, sf: str) -> DataFrame:
    return nested.tables(nested.classify(table(spark, sf, "extraction_records")))


def p7_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.cells(nested.classify(table(spark, sf, "extraction_records")))


def p7_object_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.typed_cells(nested.classify(table(spark, sf, "extraction_records")), "cells")


def p7_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.typed_cells(nested.classify(table(spark, sf, "extraction_records")), "grid")


QUERIES = {f.__name__: f for f in (p5_found, p5_tree, p5_descendants, p5_loops, p7_found, p7_records, p7_tables, p7_cells, p7_object_cells, p7_grid_cells)}

_PARENTS = r"""
n AS (SELECT document_id, id, min(CASE WHEN trim(parent_id) <> '' THEN parent_id END) AS p FROM elements GROUP BY ALL),
c AS (SELECT document_id, kid, min(id) AS q FROM (SELECT document_id, id, unnest(children_ids) AS kid FROM elements) GROUP BY ALL),
r AS (SELECT n.document_id, n.id, coalesce(n.p, c.q) AS want FROM n LEFT JOIN c ON n.document_id = c.document_id AND n.id = c.kid),
e AS (SELECT r.document_id, r.id, m.id AS parent FROM r LEFT JOIN n m ON r.document_id = m.document_id AND r.want = m.id)
"""
_DOWN = r"""
t AS (SELECT document_id, id, parent, id AS root, 0::BIGINT AS depth, id AS path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.document_id, e.id, e.parent, t.root, t.depth + 1, t.path || '/' || e.id FROM e JOIN t ON e.document_id = t.document_id AND e.parent = t.id)
"""
_PAIRS = r"""
a AS (SELECT document_id, parent AS id, id AS descendant, 1::BIGINT AS distance FROM t WHERE parent IS NOT NULL
      UNION ALL SELECT a.document_id, t.parent, a.descendant, a.distance + 1 FROM a JOIN t ON a.document_id = t.document_id AND a.id = t.id WHERE t.parent IS NOT NULL)
"""
_INT = lambda c: f"(CASE WHEN regexp_matches({c}, '^ *[+-]?[0-9]+([.]0+)? *$') THEN TRY_CAST({c} AS DOUBLE)::BIGINT::INT END)"
# all objects and lists with the key above them, path, page, table and position of the cell they lie in, and table they list cells of
_WALK = f"""
j AS (SELECT DISTINCT record_id, payload::JSON AS v FROM extraction_records WHERE json_valid(payload)),
k AS (SELECT record_id, '' AS label, v, '$' AS path, NULL::INT AS page, NULL::VARCHAR AS pt, NULL::INT AS pr, NULL::INT AS pc, NULL::VARCHAR AS own, NULL::INT AS gr, NULL::INT AS gc FROM j
 UNION ALL SELECT record_id, CASE WHEN json_type(k.v) = 'ARRAY' THEN label || '[]' ELSE x.key END, x.value, CASE WHEN json_type(k.v) = 'ARRAY' THEN k.path || '[' || x.key || ']' ELSE k.path || '.' || x.key END,
  CASE WHEN json_type(k.v) = 'ARRAY' OR label IN ('tables', 'tables[]', 'table', 'table[]') OR own IS NOT NULL THEN page WHEN label = 'pages' THEN {_INT("x.key")} WHEN json_exists(k.v, '$.page_number') THEN {_INT("(k.v->>'page_number')")} ELSE page END,
  CASE WHEN own IS NOT NULL AND json_type(k.v) = 'OBJECT' THEN own ELSE pt END, CASE WHEN own IS NOT NULL AND json_type(k.v) = 'OBJECT' THEN CASE WHEN label LIKE 'cells%' THEN {_INT("(k.v->>'row')")} ELSE gr END ELSE pr END,
  CASE WHEN own IS NOT NULL AND json_type(k.v) = 'OBJECT' THEN CASE WHEN label LIKE 'cells%' THEN {_INT("(k.v->>'col')")} ELSE gc END ELSE pc END,
  CASE WHEN json_type(k.v) = 'ARRAY' THEN own WHEN label IN ('tables', 'tables[]', 'table', 'table[]') AND x.key IN ('cells', 'data') THEN coalesce(k.v->>'id', k.path) END,
  CASE WHEN label = 'data' AND json_type(k.v) = 'ARRAY' THEN x.key::INT ELSE gr END, CASE WHEN label = 'data[]' AND json_type(k.v) = 'ARRAY' THEN x.key::INT ELSE gc END
  FROM k, json_each(k.v) x WHERE json_type(k.v) IN ('OBJECT', 'ARRAY') AND json_type(x.value) IN ('OBJECT', 'ARRAY')),
t AS (SELECT *, coalesce(v->>'id', path) AS table_id, (v->'cells') IS NOT NULL AND json_type(v->'cells') <> 'NULL' AND (v->'cells')::VARCHAR <> '[]' AS has_cells, (v->'data') IS NOT NULL AND json_type(v->'data') <> 'NULL' AND (v->'data')::VARCHAR <> '[]' AS has_data FROM k WHERE label IN ('tables', 'tables[]', 'table', 'table[]') AND json_type(v) = 'OBJECT'),
c AS (SELECT record_id, table_id, 'cells' AS variant, {_INT("(x.value->>'row')")} AS row_num, {_INT("(x.value->>'col')")} AS col_num, x.value AS v, t.path || '.cells[' || (CASE WHEN json_type(t.v->'cells') = 'OBJECT' THEN '0' ELSE x.key END) || ']' AS path, 0 AS part, x.id AS ord
  FROM t, json_each(CASE WHEN json_type(v->'cells') = 'OBJECT' THEN json_array(v->'cells') ELSE coalesce(v->'cells', '[]') END) x WHERE json_type(x.value) = 'OBJECT'
 UNION ALL SELECT record_id, table_id, 'grid', y.key::INT, z.key::INT, CASE WHEN json_type(z.value) = 'OBJECT' THEN z.value ELSE json_object('text', z.value) END, t.path || '.data[' || y.key || '][' || z.key || ']', 1, z.id
  FROM t, json_each(CASE WHEN json_type(v->'data') = 'ARRAY' THEN (v->'data') WHEN has_data THEN json_array(v->'data') ELSE '[]' END) y, json_each(CASE WHEN json_type(y.value) = 'ARRAY' THEN y.value WHEN json_type(y.value) = 'NULL' THEN '[]' ELSE json_array(y.value) END) z),
l AS (SELECT * FROM c QUALIFY row_num IS NULL OR col_num IS NULL OR row_number() OVER (PARTITION BY record_id, table_id, row_num, col_num ORDER BY part DESC, ord DESC) = 1)
"""
_FIELDS = f"""TRY_CAST(v->>'confidence' AS DOUBLE) AS confidence, CASE WHEN json_type(v->'is_header') = 'BOOLEAN' THEN (v->>'is_header')::BOOLEAN END AS is_header, {_INT("(v->>'row_span')")} AS row_span, path"""
SQL = {
    "p7_records": f"""WITH RECURSIVE {_WALK}, n AS (SELECT record_id, count(*)::INT AS n_tables FROM t GROUP BY 1), m AS (SELECT record_id, count(*)::INT AS n_cells FROM c GROUP BY 1),
d AS (SELECT DISTINCT record_id, payload, coalesce(json_valid(payload), false) AS ok FROM extraction_records), i AS (SELECT record_id, CASE WHEN ok THEN payload::JSON END AS v, payload, ok FROM d),
r AS (SELECT *, CASE WHEN json_type(v->'result') = 'OBJECT' THEN (v->'result') ELSE v END AS w FROM i)
SELECT record_id, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'missing' WHEN NOT ok THEN 'broken' WHEN json_type(w->'pages') = 'ARRAY' THEN 'pages_list' WHEN json_type(w->'pages') = 'OBJECT' THEN 'pages_by_number' WHEN json_exists(v, '$.parsed_data') THEN 'parsed_data' ELSE 'other' END AS variant,
 coalesce(n_tables, 0) AS n_tables, coalesce(n_cells, 0) AS n_cells FROM r LEFT JOIN n USING (record_id) LEFT JOIN m USING (record_id)""",
    "p7_tables": f"""WITH RECURSIVE {_WALK} SELECT record_id, table_id, path, CASE WHEN has_cells AND has_data THEN 'both' WHEN has_cells THEN 'cells' WHEN has_data THEN 'grid' ELSE 'empty' END AS variant, coalesce(page, {_INT("(v->>'page')")}) AS page,
 {_INT("(v->>'rows')")} AS n_rows, {_INT("(v->>'cols')")} AS n_cols, TRY_CAST(v->>'confidence' AS DOUBLE) AS confidence, pt AS parent_table, pr AS parent_row, pc AS parent_col FROM t""",
    "p7_cells": f"WITH RECURSIVE {_WALK} SELECT record_id, table_id, variant, row_num, col_num, (v->>'text') AS text, {_FIELDS} FROM l",
    "p7_object_cells": f"WITH RECURSIVE {_WALK} SELECT record_id, table_id, row_num, col_num, (v->>'text') AS text, {_FIELDS} FROM l WHERE variant = 'cells'",
    "p7_grid_cells": f"WITH RECURSIVE {_WALK} SELECT record_id, table_id, row_num, col_num, (v->>'text') AS text, path FROM l WHERE variant = 'grid'",
    "p5_loops": f"""WITH RECURSIVE {_PARENTS}, {_DOWN}, x AS (SELECT e.document_id, e.id, e.parent FROM e ANTI JOIN t ON e.document_id = t.document_id AND e.id = t.id),
w AS (SELECT document_id, id, parent AS here FROM x UNION SELECT w.document_id, w.id, x.parent FROM w JOIN x ON x.document_id = w.document_id AND x.id = w.here),
l AS (SELECT document_id, id FROM w WHERE here = id)
SELECT w.document_id, w.id, bool_or(w.here = w.id) AS on_loop, min(l.id) AS loop FROM w JOIN l ON l.document_id = w.document_id AND l.id = w.here GROUP BY 1, 2""",
    "p5_found": f"WITH RECURSIVE {_PARENTS}, {_DOWN} SELECT e.document_id, e.id FROM e ANTI JOIN t ON e.document_id = t.document_id AND e.id = t.id",
    "p5_descendants": f"WITH RECURSIVE {_PARENTS}, {_DOWN}, {_PAIRS} SELECT document_id, id, descendant, distance FROM a",
    "p5_tree": f"""WITH RECURSIVE {_PARENTS}, {_DOWN}, {_PAIRS},
z AS (SELECT document_id, id, count(*) AS below FROM a GROUP BY ALL),
s AS (SELECT t.*, 1 + coalesce(below, 0) AS size FROM t LEFT JOIN z USING (document_id, id)),
o AS (SELECT *, CASE WHEN parent IS NULL THEN 0 ELSE 1 + coalesce(sum(size) OVER (PARTITION BY document_id, parent ORDER BY encode(id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS off FROM s),
w AS (SELECT document_id, id, id AS descendant FROM t UNION ALL SELECT document_id, id, descendant FROM a),
p AS (SELECT w.document_id, w.descendant AS id, sum(o.off) AS pre FROM w JOIN o USING (document_id, id) GROUP BY ALL)
SELECT s.document_id, s.id, s.parent, s.root, s.depth, s.size, p.pre::BIGINT AS pre, (p.pre + s.size - 1)::BIGINT AS last, s.path FROM s JOIN p USING (document_id, id)""",
    "p7_found": r"""
WITH RECURSIVE j AS (SELECT DISTINCT record_id, payload::JSON AS v FROM extraction_records WHERE json_valid(payload)),
k AS (SELECT record_id, '' AS key, v FROM j
      UNION ALL SELECT record_id, CASE WHEN json_type(k.v) = 'ARRAY' THEN k.key ELSE x.key END, x.value FROM k, json_each(k.v) x WHERE json_type(k.v) IN ('OBJECT', 'ARRAY') AND json_type(x.value) IN ('OBJECT', 'ARRAY')),
t AS (SELECT record_id, v, v->>'id' AS table_id FROM k WHERE key IN ('tables', 'table') AND json_type(v) = 'OBJECT'),
c AS (SELECT record_id, table_id, TRY_CAST(x.value->>'row' AS INT) AS row_num, TRY_CAST(x.value->>'col' AS INT) AS col_num, x.value->>'text' AS text, x.id AS ord
        FROM t, json_each(CASE WHEN json_type(v->'cells') = 'OBJECT' THEN json_array(v->'cells') ELSE coalesce(v->'cells', '[]') END) x
      UNION ALL SELECT record_id, table_id, y.key::INT, z.key::INT, z.value->>'$', 0 FROM t, json_each(coalesce(v->'data', '[]')) y, json_each(CASE WHEN json_type(y.value) = 'ARRAY' THEN y.value ELSE '[]' END) z),
l AS (SELECT record_id, table_id, row_num, col_num, arg_max(coalesce(text, ''), ord) AS text FROM c WHERE row_num IS NOT NULL AND col_num IS NOT NULL GROUP BY ALL)
SELECT record_id, table_id, row_num, col_num FROM l WHERE trim(text) <> ''
""",
}
