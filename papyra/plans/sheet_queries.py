"""Queries of sheets, SQL over sheets, sinks, sources, documents and streaming logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import documents, ranking, sheets
from papyra.session import table
from papyra.sources import files
from papyra.streaming import ingest


def _sheets(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Sheets made of customers and parts, with empty rows and columns and an unnamed one."""
    c = table(spark, sf, "customer")
    hide = F.col("c_custkey") % 10 == 0
    keep = lambda c: F.when(hide, F.lit(None)).otherwise(c)
    sales = c.select(F.col("c_custkey").cast("int").alias("_row"), keep(F.col("c_name")).alias("Name"), keep(F.col("c_acctbal")).alias("Unit Price"), keep(F.col("c_mktsegment")).alias("Region"), F.lit(None).cast("string").alias("Empty"), keep(F.lit("x")).alias("Unnamed: 4"))
    p = table(spark, sf, "part")
    stock = p.select(F.col("p_partkey").cast("int").alias("_row"), F.col("p_partkey").alias("SKU"), F.col("p_name").alias("Product Name"), F.col("p_size").alias("Stock"), (F.col("p_partkey") % 60).alias("Reorder Level"))
    return {"Sales": sales, "Stock-List 1": stock}


_SALES = "s AS (SELECT c_custkey AS r, c_name AS \"Name\", c_acctbal AS price, c_mktsegment AS region FROM customer WHERE c_custkey % 10 <> 0)"


def sheet_clean(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions(rename={"Unit Price": "price", "Region": "region"}, cast={"price": "decimal(12,2)"}))
    return s.withColumnRenamed("_row", "r").withColumn("price", F.col("price").cast("string"))


def rename_limit(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions(max_rows=25, rename={"Name": "customer"}))
    return s.select(F.col("_row").alias("r"), "customer")


def sheet_sql_filter(spark, sf):
    s = {n: sheets.clean(d, sheets.SheetOptions()) for n, d in _sheets(spark, sf).items()}
    return sheets.query(s, 'SELECT "Name" AS name, "Unit Price" AS price FROM Sales WHERE "Unit Price" > 5000')


def sheet_sql_aggregate(spark, sf):
    s = {n: sheets.clean(d, sheets.SheetOptions()) for n, d in _sheets(spark, sf).items()}
    return sheets.query(s, 'SELECT Region AS region, count(*) AS n, list_sort(list("Name"))[1] AS first_name, max(len("Name")) AS longest FROM Sales GROUP BY ALL ORDER BY n DESC')


def sheet_sql_low_stock(spark, sf):
    s = _sheets(spark, sf)
    return sheets.query(s, 'SELECT SKU AS sku, "Product Name" AS name, "Reorder Level" - Stock AS missing FROM Stock_List_1 WHERE Stock < "Reorder Level"')


def sheet_placeholder_sql(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions())
    good = sheets.sheet_query(s, "SELECT Region AS region, count(*) AS n FROM {sheet} GROUP BY Region")
    bad = sheets.sheet_query(s, "SELECT nothing FROM {sheet}", on_error="passthrough")
    return good.unionByName(bad.agg(F.lit("all rows kept").alias("region"), F.count(F.lit(1)).alias("n")))


def sheet_info(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions())
    i = sheets.info(s)
    return spark.createDataFrame([(i["row_count"], i["column_count"], ",".join(i["columns"]))], "row_count long, column_count int, columns string")


def sheet_json(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions()).select("_row", "Name", "Region")
    return sheets.json_rows(s)


def sheet_markdown(spark, sf):
    s = sheets.clean(_sheets(spark, sf)["Sales"], sheets.SheetOptions()).select("_row", F.concat("Name", F.lit("|")).alias("Name"), "Region")
    return sheets.markdown_rows(s)


def shim_qualify(spark, sf):
    return sheets.query({"orders": table(spark, sf, "orders")}, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 AND count(*) OVER (PARTITION BY o_custkey) > 3 OR o_totalprice > 400000")


def shim_distinct_on(spark, sf):
    return sheets.query({"orders": table(spark, sf, "orders")}, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")


def shim_spellings(spark, sf):
    q = """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, arg_max(o_orderkey, o_totalprice) AS dearest, string_split('alpha-b-c', '-')[1] AS k, string_split('alpha-b-c', '-')[-1] AS z, array_to_string([10, 20, 30][2:3], '+') AS part, {'a': 1, 'b': [4, 5]}['b'][2] AS five, [[1, 2], [3]][2][1] AS three, sum(o_orderkey // 7) AS sevenths,
 max(list_contains([1, 2, 3], o_orderkey % 5)) AS some FROM "orders" GROUP BY ALL"""
    return sheets.query({"orders": table(spark, sf, "orders")}, q)


def asof_join(spark, sf):
    """Each error with the last purchase of the same user before it."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"), "value")
    return sheets.asof_join(a, b, ["user_id"], "ts", "at", ["purchase_id", "value"]).select("event_id", "purchase_id", "value")


def range_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    bands = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 80 + 800.0).alias("low"), (F.col("n_nationkey") * 80 + 900.0).alias("high"))
    return sheets.range_join(p, bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "n_nationkey")


def positional_join(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier").select("s_suppkey")
    return sheets.positional_join(s, n, ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_name")


def global_row_numbers(spark, sf):
    return ranking.row_numbers(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "place")


def _documents(spark, sf):
    """Documents put together from orders: text, images, a table of items, forms and a note."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    row = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("l_returnflag")))
    t = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    d = o.join(t, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey").cast("string")
    tab = F.array(F.struct(F.array(F.lit("part"), F.lit("qty"), F.lit("flag")).alias("columns"), F.coalesce("rows", F.array().cast("array<array<string>>")).alias("data"), F.lit(0.9).alias("confidence")))
    form = F.array(F.struct(F.lit("text").alias("type"), F.col("o_orderstatus").alias("text"), F.lit(1).alias("page"), F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("bbox")), F.struct(F.lit("checkbox").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(2).alias("page"), F.array().cast("array<double>").alias("bbox")))
    return d.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order-"), k, F.lit(".pdf")).alias("file_name"), F.concat(F.lit("  Order "), k, F.lit(" \n\n\n\n It’s – due — soon ")).alias("text"), F.array(F.concat(F.lit("img/"), k, F.lit(".png"))).alias("images"),
        tab.alias("tables"), form.alias("forms"), F.when(F.col("o_orderkey") % 16 == 0, F.array(F.lit("a note"))).alias("handwritten"),
    )


_DOCS = """li AS (SELECT l_orderkey, list({'a': l_partkey::VARCHAR, 'b': l_quantity::INT::VARCHAR, 'c': CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END} ORDER BY l_linenumber, l_partkey, l_partkey::VARCHAR, l_quantity::INT::VARCHAR, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END NULLS FIRST) AS rs FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey AS doc_id, o_orderstatus AS st, coalesce(rs, []) AS rs FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)"""


def document_markdown(spark, sf):
    return documents.markdown(_documents(spark, sf)).select("doc_id", "markdown")


def document_json(spark, sf):
    return documents.json_document(_documents(spark, sf)).select("doc_id", F.get_json_object("json", "$.text").alias("text"), F.get_json_object("json", "$.tables[0].data[0][0]").alias("first"))


def document_summary(spark, sf):
    return documents.summary(_documents(spark, sf))


def embeddings_view(spark, sf):
    return documents.embedding_view(_documents(spark, sf))


def normalised_tables(spark, sf):
    return documents.normalised(_documents(spark, sf))["cells"]


def normalised_roundtrip(spark, sf):
    d = _documents(spark, sf)
    back = documents.restored(documents.normalised(d)).select("doc_id", F.to_json("tables").alias("b"))
    return d.select("doc_id", F.to_json("tables").alias("a")).join(back, "doc_id", "left").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def pivoted_cells(spark, sf):
    """Grids with one column a place, made by a pivot of cells; the last entry for a place holds."""
    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"), F.struct("l_partkey", "l_returnflag").alias("ord"), F.col("l_returnflag").alias("text"))
    return c.groupBy("table_id", "row").pivot("col", [0, 1, 2]).agg(F.max_by("text", "ord")).select("table_id", "row", *[F.col(str(i)).alias(f"c{i}") for i in range(3)])


def vector_export(spark, sf):
    """Rows as a vector store takes them: id, length and metadata of usable vectors of the right length."""
    v = table(spark, sf, "chunk_embeddings").select("id", "document_id", "embedding", "metadata").distinct().filter(F.size("embedding") == 64)
    good = files.check_vectors(v, "embedding", 64)
    return good.select("id", F.sha2(F.concat_ws("|", "document_id", "id"), 256).alias("point_id"), F.size("embedding").alias("dim"), F.get_json_object("metadata", "$.chunk_index").alias("chunk_index"))


def extraction_progress(spark, sf):
    p = table(spark, sf, "ocr_results").select("ocr_id", "error", "text").distinct()
    return files.progress(p.select(F.when(F.col("error").isNotNull(), "error").when(F.length("text") > 0, "success").alias("status"))).withColumn("percent", F.round("percent", 6))


def merged_results(spark, sf):
    """Results of blocks put together: maps with the later value, lists in order."""
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("x"))
    last = F.aggregate("x", F.create_map().cast("map<string,double>"), lambda m, x: F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda kv: kv["key"] != x["event_type"]), F.array(F.struct(x["event_type"].alias("key"), x["value"].alias("value"))))))
    return g.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries(last), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"].cast("decimal(12,2)").cast("string")))), ",").alias("latest"), F.size("x").alias("n"))


def stream_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ingest.windowed_counts(e, "ts", "event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "ts", "user_id", "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def distinct_contents(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    return ingest.distinct_contents(d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        sheet_clean, rename_limit, sheet_sql_filter, sheet_sql_aggregate, sheet_sql_low_stock, sheet_placeholder_sql, sheet_info, sheet_json, sheet_markdown, shim_qualify, shim_distinct_on, shim_spellings, asof_join, range_join,
        positional_join, global_row_numbers, document_markdown, document_json, document_summary, embeddings_view, normalised_tables, normalised_roundtrip, pivoted_cells, vector_export, extraction_progress, merged_results,
        stream_windows, stream_sessions, distinct_contents,
    )
}

_NL = "chr(10)"
SQL = {
    "sheet_clean": f"WITH {_SALES} SELECT r::INT AS r, \"Name\", price::DECIMAL(12,2)::VARCHAR AS price, region FROM s",
    "rename_limit": f"WITH {_SALES} SELECT r::INT AS r, \"Name\" AS customer FROM s ORDER BY r LIMIT 25",
    "sheet_sql_filter": f"WITH {_SALES} SELECT \"Name\" AS name, price FROM s WHERE price > 5000",
    "sheet_sql_aggregate": f"WITH {_SALES} SELECT region, count(*) AS n, min(\"Name\") AS first_name, max(length(\"Name\")) AS longest FROM s GROUP BY 1",
    "sheet_sql_low_stock": "SELECT p_partkey AS sku, p_name AS name, p_partkey % 60 - p_size AS missing FROM part WHERE p_size < p_partkey % 60",
    "sheet_placeholder_sql": f"WITH {_SALES} SELECT region, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'all rows kept', count(*) FROM s",
    "sheet_info": f"WITH {_SALES} SELECT count(*) AS row_count, 3 AS column_count, 'Name,Unit Price,Region' AS columns FROM s",
    "sheet_json": f"WITH {_SALES} SELECT to_json({{'Name': \"Name\", 'Region': region}})::VARCHAR AS value FROM s",
    "sheet_markdown": f"WITH {_SALES} SELECT r + 1 AS ord, '| ' || \"Name\" || '\\| | ' || region || ' |' AS value FROM s UNION ALL VALUES (0, '| Name | Region |'), (1, '| --- | --- |')",
    "shim_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 AND count(*) OVER (PARTITION BY o_custkey) > 3 OR o_totalprice > 400000",
    "shim_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    "shim_spellings": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, arg_max(o_orderkey, o_totalprice) AS dearest, string_split('alpha-b-c', '-')[1] AS k, string_split('alpha-b-c', '-')[-1] AS z, array_to_string([10, 20, 30][2:3], '+') AS part, {'a': 1, 'b': [4, 5]}['b'][2] AS five, [[1, 2], [3]][2][1] AS three, sum(o_orderkey // 7)::BIGINT AS sevenths, max(list_contains([1, 2, 3], o_orderkey % 5)) AS some FROM orders GROUP BY 1",
    "asof_join": "WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT user_id, ts AS at, event_id AS purchase_id, value FROM events WHERE event_type = 'purchase') SELECT event_id, purchase_id, value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.at",
    "range_join": "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice >= n_nationkey * 80 + 800.0 AND p_retailprice < n_nationkey * 80 + 900.0",
    "positional_join": "SELECT s_suppkey, n_name FROM (SELECT s_suppkey FROM supplier ORDER BY 1) s POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_nationkey) n",
    "global_row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders",
    "document_markdown": f"""WITH {_DOCS} SELECT doc_id, '# order-' || doc_id || '.pdf' || {_NL} || {_NL} || '## Content' || {_NL} || {_NL} || 'Order ' || doc_id || {_NL} || {_NL} || 'It’s – due — soon' || {_NL} || {_NL} || '## Images' || {_NL} || {_NL} || '![Image 1](img/' || doc_id || '.png)' || {_NL} || {_NL} || '## Tables' || {_NL} || {_NL} || '### Table 1' || {_NL} || {_NL}
 || CASE WHEN len(rs) = 0 THEN '*Empty table*' ELSE '| part | qty | flag |' || {_NL} || '| --- | --- | --- |' || {_NL} || array_to_string(list_transform(rs, lambda x: '| ' || x.a || ' | ' || x.b || ' | ' || coalesce(x.c, '') || ' |'), {_NL}) END || {_NL} || {_NL} || '## Form Elements' || {_NL} || {_NL}
 || '- Type: text, Text: ' || st || ', Page: 1, Position: (0.10, 0.25, 0.50, 0.75)' || {_NL} || '- Type: checkbox, Page: 2' || CASE WHEN doc_id % 16 = 0 THEN {_NL} || {_NL} || '## Handwritten Content' || {_NL} || {_NL} || '- a note' ELSE '' END AS markdown FROM d""",
    "document_json": f"WITH {_DOCS} SELECT doc_id, 'Order ' || doc_id || ' ' || repeat({_NL}, 4) || ' It''s - due -- soon' AS text, rs[1].a AS first FROM d",
    "document_summary": f"WITH {_DOCS} SELECT doc_id, 1 AS n_images, 1 AS n_tables, 2 AS n_forms, CASE WHEN doc_id % 16 = 0 THEN 1 ELSE 0 END AS n_handwritten, length('  Order ' || doc_id || ' ' || repeat({_NL}, 4) || ' It’s – due — soon ')::INT AS text_length FROM d",
    "embeddings_view": f"""WITH {_DOCS} SELECT doc_id, '  Order ' || doc_id || ' ' || repeat({_NL}, 4) || ' It’s – due — soon ' || CASE WHEN len(rs) = 0 THEN '' ELSE {_NL} || {_NL} || array_to_string(list_transform(rs, lambda x: 'part: ' || x.a || ' | qty: ' || x.b || CASE WHEN x.c IS NULL THEN '' ELSE ' | flag: ' || x.c END), {_NL}) END || {_NL} || {_NL} || 'text: ' || st AS text FROM d""",
    "normalised_tables": f"""WITH {_DOCS}, g AS (SELECT doc_id, list_concat([{{'a': 'part', 'b': 'qty', 'c': 'flag'}}], rs) AS g FROM d), r AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) - 1 AS "row" FROM g)
SELECT doc_id, doc_id || '#0' AS table_id, "row", 0 AS col, x.a AS text FROM r UNION ALL SELECT doc_id, doc_id || '#0', "row", 1, x.b FROM r UNION ALL SELECT doc_id, doc_id || '#0', "row", 2, x.c FROM r""",
    "normalised_roundtrip": "SELECT o_orderkey AS doc_id, true AS same FROM orders",
    "pivoted_cells": """WITH c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS "row", l_suppkey % 3 AS col, max_by(l_returnflag, {'k': l_partkey, 'f': l_returnflag}) AS t FROM lineitem GROUP BY 1, 2, 3) SELECT table_id, "row", max(CASE WHEN col = 0 THEN t END) AS c0, max(CASE WHEN col = 1 THEN t END) AS c1, max(CASE WHEN col = 2 THEN t END) AS c2 FROM c GROUP BY 1, 2""",
    "vector_export": "SELECT id, sha256(CASE WHEN document_id IS NULL THEN id ELSE document_id || '|' || id END) AS point_id, 64 AS dim, metadata->>'chunk_index' AS chunk_index FROM (SELECT DISTINCT id, document_id, embedding, metadata FROM chunk_embeddings WHERE len(embedding) = 64)",
    "extraction_progress": "WITH p AS (SELECT DISTINCT ocr_id, error, text FROM ocr_results), s AS (SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN length(text) > 0 THEN 'success' END AS s FROM p) SELECT count(*) AS total, count(*) FILTER (s = 'success') AS completed, count(*) FILTER (s = 'error') AS failed, count(s) AS processed, round(count(s) * 100.0::DOUBLE / count(*), 6) AS percent, count(s) = count(*) AS is_complete FROM s",
    "merged_results": "WITH e AS (SELECT user_id, event_type, arg_max(value, event_id) AS v, count(*) AS c FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || v::DECIMAL(12,2)::VARCHAR, ',' ORDER BY event_type || '=' || v::DECIMAL(12,2)::VARCHAR) AS latest, sum(c)::BIGINT AS n FROM e GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM k GROUP BY user_id, k",
    "distinct_contents": "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)",
}
