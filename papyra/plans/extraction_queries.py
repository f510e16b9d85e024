"""Queries of whole extractions, cache, models, language dispatch and output of nested data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import language
from papyra.operators import extraction, planning
from papyra.plans.text_queries import _ART, _COH, _DENS, _FLESCH, PAGES, _case_lang, _docs
from papyra.session import table


def _extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Extractions made from orders: text, a table of items, sometimes a second one without content, forms, images, metadata."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    row = F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    t = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.coalesce("l_returnflag", F.lit("")).alias("f"), row.alias("r")))), lambda x: x["r"]).alias("data"))
    d = o.join(t, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    when = lambda n, r, v: F.when(k % n == r, v)
    box = lambda *x: F.array(*map(F.lit, x))
    first = F.struct(
        when(2, 0, F.array(F.lit("part"), F.lit("flag"))).alias("headers"), F.col("data").alias("data"), (k % 8 / 8.0).cast("double").alias("confidence"), F.struct(F.size("data").alias("rows"), F.lit(2).alias("cols")).alias("shape"), when(5, 0, box(0.0, 0.0, 1.0, 1.0)).alias("bbox"),
    )
    second = F.struct(
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("data"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("struct<rows:int,cols:int>").alias("shape"), box(0.0, 0.0, 1.0).alias("bbox"),
    )
    form = F.struct(F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("fields"), when(3, 0, F.create_map(F.lit("status"), F.lit("text"))).alias("field_types"), F.lit(0.75).alias("confidence"), F.lit(None).cast("array<double>").alias("bbox"))
    text = F.repeat(F.concat(F.lit("Order "), k.cast("string"), F.lit(" was placed by a customer, and it is a fine order that went out on time. ")), (k % 4).cast("int"))
    return d.select(
        k.alias("doc_id"), F.when(k % 7 != 0, text).alias("text"), F.when(k % 3 != 0, (k % 10 / 10.0).cast("double")).alias("text_confidence"), F.array_compact(F.array(F.when(F.col("data").isNotNull(), first), when(6, 0, second))).alias("tables"),
        when(4, 1, F.array(form)).alias("forms"), when(9, 0, F.array(F.lit("a.png"))).alias("images"), when(2, 0, F.create_map(F.lit("k"), F.lit("v"))).alias("metadata"), when(10, 0, F.array(F.lit("h"))).alias("headings"), when(11, 0, F.lit("two")).alias("layout"),
        F.lit(None).cast("array<string>").alias("regions"),
    )


def extraction_assessment(spark, sf):
    a = extraction.assess(_extractions(spark, sf))
    numbers = ("text_score", "artifacts", "structure", "average", "variance", "completeness", "consistency", "overall")
    return a.select("doc_id", *[F.round(c, 9).alias(c) for c in numbers], "distribution", F.array_join("recommendations", "|").alias("recommendations"))


def extraction_text(spark, sf):
    e = _extractions(spark, sf)
    return e.select("doc_id", F.md5(extraction.all_text(F.col("text"), F.col("tables"), F.col("forms"))).alias("digest"), F.array_join(extraction.shared_keys(F.col("tables"), extraction.TABLE_PARTS), ",").alias("shared"))


def merged_blocks(spark, sf):
    """Results of a user's blocks put together: types with their last value, and all types in order."""
    e = table(spark, sf, "events")
    m = extraction.combine_maps(e, ["user_id"], "event_id", "event_type", "value")
    pairs = F.array_join(F.transform(F.map_entries("merged"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("decimal(12,2)").cast("string"))), ",")
    lists = extraction.combine_lists(e.select("user_id", "event_id", F.array(F.col("event_type"), F.lit("|")).alias("items")), ["user_id"], "event_id", "items")
    return m.select("user_id", pairs.alias("latest")).join(lists.select("user_id", F.md5(F.array_join("merged", "")).alias("digest")), "user_id")


def clean_nested_json(spark, sf):
    e = _extractions(spark, sf).select("doc_id", F.when(F.col("text").isNotNull(), F.concat(F.lit(" “Order” – "), F.col("doc_id").cast("string"))).alias("title "), F.struct(F.when(F.col("doc_id") % 4 == 0, float("nan")).otherwise(0.5).alias("score"), F.array(F.struct(F.lit(True).alias("ok"), F.lit("  ").alias("note"))).alias("parts")).alias("inner"))
    return e.select("doc_id", extraction.clean_json(e).alias("json"))


def unified_markdown(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    element = lambda t, level, text: F.struct(F.lit(t).alias("type"), F.lit(level).cast("int").alias("level"), text.alias("text"))
    field = lambda t, label, value, on: F.struct(F.lit(t).alias("type"), label.alias("label"), value.alias("value"), on.alias("is_checked"))
    none = F.lit(None).cast("string")
    page = F.struct(
        F.lit(1).alias("page_number"), F.array(F.lit("| a |")).alias("tables"), F.array(field("checkbox", F.lit("paid"), none, F.col("o_orderstatus") == "F"), field("text", none, F.col("o_orderstatus"), F.lit(None).cast("boolean"))).alias("fields"),
        F.when(k % 3 == 0, F.array(F.lit("note"))).alias("handwritten"),
    )
    d = o.select(
        k.alias("doc_id"), F.when(k % 2 == 0, F.concat(F.lit("Order "), k.cast("string"))).alias("title"), F.when(k % 5 == 0, F.lit("A. Clerk")).alias("author"), F.lit(1).alias("page_count"), F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created"),
        F.when(k % 7 != 0, F.array(element("heading", 2, F.lit("Head")), element("paragraph", None, F.concat(F.lit("No. "), k.cast("string"))), element("list_item", None, F.lit("item")), element("footnote", None, F.lit("gone")))).alias("elements"), F.array(page).alias("pages"),
    )
    return extraction.unified_markdown(d)


def reader_confidence(spark, sf):
    """Mean confidence by page and engine as percentages give it."""
    p = table(spark, sf, "ocr_results").select("ocr_id", "document_id", "page", "engine", "confidence").distinct()
    percent = F.when(F.col("confidence") > 1, F.col("confidence")).otherwise(F.round(F.col("confidence") * 100, 4)) - F.when(F.col("ocr_id") % 9 == 0, 100).otherwise(0)
    return p.groupBy("engine").agg(F.round(extraction.mean_reading(percent), 6).alias("confidence"))


def language_dispatch(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    x = language.dispatch(F.col("text"))
    named = language.dispatch(F.col("text"), "first", {"first": lambda c: F.when(F.length(c) % 3 > 0, F.struct(F.lit("nl").alias("language"), F.lit(0.75).alias("confidence")))})
    gone = language.dispatch(F.col("text"), "polyglot")
    return d.select("doc_id", x.alias("x"), named.alias("n"), gone.alias("g")).select("doc_id", F.col("x.language").alias("auto"), "x.method", F.col("n.language").alias("named"), F.col("n.error").alias("named_error"), F.col("g.error").alias("gone_error"))


def language_support(spark, sf):
    s = language.supported(detector=True, translator=True)
    return spark.createDataFrame([(k, len(v), ",".join(v[:12])) for k, v in s.items()], "component string, n long, first_ones string")


def _cache(spark, sf):
    """A memory cache, a disk cache and accesses made of users, parts and events."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file_hash"), (F.col("p_size") / 8.0).alias("size_mb"))
    memory = p.filter("file_hash % 3 = 0").select("file_hash", "size_mb", F.lit(1).cast("long").alias("count"), F.lit(1.5).alias("priority"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_access"))
    disk = p.filter("file_hash % 2 = 0")
    accesses = e.select("event_id", F.col("user_id").alias("file_hash"), F.col("ts").alias("at"))
    return memory, disk, accesses


def cache_lookups(spark, sf):
    memory, disk, accesses = _cache(spark, sf)
    return planning.cache_get(accesses, memory, disk).groupBy("found").agg(F.count(F.lit(1)).alias("n"))


def cache_promoted(spark, sf):
    memory, disk, accesses = _cache(spark, sf)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    after = planning.cache_after(memory, disk, accesses, now)
    return after.select("file_hash", "size_mb", "count", "priority", F.date_format("last_access", "yyyy-MM-dd HH:mm:ss").alias("last_access"))


def cache_warmed(spark, sf):
    memory, disk, accesses = _cache(spark, sf)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    fresh = disk.select("file_hash", (F.col("size_mb") * 16).alias("size_mb"), F.lit(1).cast("long").alias("count"), (F.col("file_hash") % 5 * 1.0).alias("priority"), now.alias("last_access")).filter("file_hash % 4 = 0")
    warmed = planning.cache_warm(planning.cache_put(memory, fresh, 64.0), disk, accesses, now)
    return warmed.select("file_hash", "size_mb", "count", "priority")


def cache_statistics(spark, sf):
    memory, disk, accesses = _cache(spark, sf)
    s = planning.cache_stats(memory, accesses, 512.0, planning.cache_get(accesses, memory, disk))
    return s.select("memory_entries", F.round("memory_size_mb", 6).alias("memory_size_mb"), "total_accesses", F.round("memory_utilization", 6).alias("memory_utilization"), F.round("avg_accesses_per_entry", 6).alias("avg_accesses_per_entry"), "tracked_patterns", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


def model_choice(spark, sf):
    p = table(spark, sf, "part")
    kinds = F.array(*map(F.lit, ["tax_documents", "legal_contracts", "invoices_receipts", "general_documents", "poems"]))
    has = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "openai"), F.when(F.col("p_size") % 3 == 0, "anthropic"), F.when(F.col("p_size") % 5 == 0, "google")))
    kind = F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", planning.choose_model(kind, has, F.lit("llama-3.2-vision")).alias("model"))


def prompts_by_type(spark, sf):
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, ["general", "tables", "forms", "metadata", "summary", "unknown"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.groupBy(kind.alias("kind"), planning.prompt(kind).alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        extraction_assessment, extraction_text, merged_blocks, clean_nested_json, unified_markdown, reader_confidence, language_dispatch, language_support, cache_lookups, cache_promoted, cache_warmed, cache_statistics, model_choice, prompts_by_type,
    )
}

_EX = """li AS (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey || ' ' || CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'None' END, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS cells FROM lineitem GROUP BY 1),
x0 AS (SELECT o_orderkey AS k, o_orderstatus AS st, n, cells, CASE WHEN o_orderkey % 7 <> 0 THEN repeat('Order ' || o_orderkey || ' was placed by a customer, and it is a fine order that went out on time. ', (o_orderkey % 4)::INT) END AS own, n IS NOT NULL AS t1, o_orderkey % 6 = 0 AS t2, o_orderkey % 4 = 1 AS f FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
x AS (SELECT *, array_to_string(list_filter([own, cells, CASE WHEN f THEN st END], lambda v: v IS NOT NULL), ' ') AS text FROM x0)"""
_ASSESS = _EX + f""", s1 AS (SELECT *, {_COH} AS coh, {_ART} AS art, {_DENS} AS den, {_FLESCH} AS fle, CASE WHEN k % 3 <> 0 THEN (k % 10) / 10.0::DOUBLE END AS tc, (k % 8) / 8.0::DOUBLE AS c1 FROM x),
s2 AS (SELECT *, CASE WHEN length(text) > 0 THEN 0.3::DOUBLE * least(fle / 100, 1.0::DOUBLE) + 0.3::DOUBLE * coh + 0.2::DOUBLE * (1 - art) + 0.2::DOUBLE * least(den, 1.0::DOUBLE) ELSE 0 END AS ts, CASE WHEN length(text) > 0 THEN art ELSE 1.0 END AS af,
 CASE WHEN t1 THEN 0.3::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN c1 > 0.7 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN n > 1 THEN 0.2 ELSE 0 END::DOUBLE ELSE 0 END AS q1, t1::INT + t2::INT AS nt,
 CASE WHEN f THEN 0.8::DOUBLE + CASE WHEN k % 3 = 0 THEN 0.2 ELSE 0 END::DOUBLE ELSE 0 END AS qf, (((t1 AND k % 5 = 0) OR t2)::INT + (k % 11 = 0)::INT) / 4.0::DOUBLE AS lay,
 list_filter([tc, CASE WHEN t1 THEN c1 END, CASE WHEN f THEN 0.75::DOUBLE END], lambda v: v IS NOT NULL) AS cs FROM s1),
s3 AS (SELECT *, ((nt > 0)::INT + f::INT + (k % 9 = 0)::INT + (k % 10 = 0)::INT) / 4.0::DOUBLE * 0.4::DOUBLE + (CASE WHEN nt > 0 THEN q1 / nt ELSE 0 END + qf + lay) / 3 * 0.6::DOUBLE AS structure, CASE WHEN len(cs) > 0 THEN list_avg(cs) ELSE 0.5 END AS average, CASE WHEN len(cs) > 0 THEN list_var_pop(cs) ELSE 0 END AS variance,
 list_filter([CASE WHEN length(text) > 0 THEN least(length(text) / 1000.0::DOUBLE, 1.0::DOUBLE) END, CASE WHEN nt + f::INT + (k % 9 = 0)::INT > 0 THEN least((nt + f::INT + (k % 9 = 0)::INT) / 5.0::DOUBLE, 1.0::DOUBLE) END], lambda v: v IS NOT NULL) AS cov FROM s2),
s4 AS (SELECT *, ((length(text) > 0)::INT + (nt > 0 OR f)::INT + (k % 2 = 0)::INT) / 3.0::DOUBLE * 0.7::DOUBLE + CASE WHEN len(cov) > 0 THEN list_avg(cov) ELSE 0.5 END * 0.3::DOUBLE AS completeness,
 ((length(text) = 0)::INT + (NOT (t1 AND k % 5 = 0 AND t2))::INT + (NOT (t1 AND t2 AND k % 5 <> 0))::INT + 1) / 4.0::DOUBLE AS consistency FROM s3),
s5 AS (SELECT *, 0.3::DOUBLE * ts + 0.25::DOUBLE * structure + 0.2::DOUBLE * average + 0.15::DOUBLE * completeness + 0.1::DOUBLE * consistency AS overall FROM s4)"""
_CACHE = """m AS (SELECT p_partkey AS h, p_size / 8.0::DOUBLE AS mb FROM part WHERE p_partkey % 3 = 0), dk AS (SELECT p_partkey AS h, p_size / 8.0::DOUBLE AS mb FROM part WHERE p_partkey % 2 = 0), a AS (SELECT user_id AS h, ts FROM events),
g AS (SELECT a.h, CASE WHEN m.h IS NOT NULL THEN 'memory' WHEN dk.h IS NOT NULL THEN 'disk' ELSE 'miss' END AS found FROM a LEFT JOIN m ON a.h = m.h LEFT JOIN dk ON a.h = dk.h)"""
_C = "chr(10)"
SQL = {
    "extraction_assessment": f"""WITH {_ASSESS} SELECT k AS doc_id, round(ts, 9) AS text_score, round(af, 9) AS artifacts, round(structure, 9) AS structure, round(average, 9) AS average, round(variance, 9) AS variance, round(completeness, 9) AS completeness, round(consistency, 9) AS consistency, round(overall, 9) AS overall,
 CASE WHEN len(cs) = 0 THEN 'unknown' WHEN average > 0.8 AND variance < 0.05 THEN 'high_consistent' WHEN average > 0.6 AND variance < 0.1 THEN 'good_consistent' WHEN variance > 0.2 THEN 'highly_variable' WHEN average < 0.4 THEN 'low_confidence' ELSE 'moderate' END AS distribution,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN ts < 0.5 THEN 'Consider using advanced OCR engines (TrOCR) for better text recognition' END, CASE WHEN af > 0.1 THEN 'High OCR artifacts detected - consider image preprocessing' END, CASE WHEN structure < 0.5 THEN 'Consider using Table Transformer for better structure extraction' END,
  CASE WHEN average < 0.6 THEN 'Low confidence scores - consider manual review of results' END, CASE WHEN overall < 0.4 THEN 'Overall quality is low - consider using advanced extraction features' WHEN overall > 0.8 THEN 'High quality extraction - results are reliable' END], lambda v: v IS NOT NULL), '|'), ''), 'Extraction quality appears acceptable') AS recommendations FROM s5""",
    "extraction_text": f"WITH {_EX} SELECT k AS doc_id, md5(text) AS digest, CASE WHEN t1 AND t2 THEN CASE WHEN k % 5 = 0 THEN 'bbox' ELSE '' END END AS shared FROM x",
    "merged_blocks": "WITH e AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), l AS (SELECT user_id, md5(string_agg(event_type || '|', '' ORDER BY event_id)) AS digest FROM events GROUP BY 1) SELECT user_id, string_agg(event_type || '=' || v::DECIMAL(12,2)::VARCHAR, ',' ORDER BY event_type) AS latest, any_value(digest) AS digest FROM e JOIN l USING (user_id) GROUP BY 1",
    "clean_nested_json": f"""WITH {_EX} SELECT k AS doc_id, '{{"doc_id":"' || k || '","title":' || CASE WHEN own IS NULL THEN 'null' ELSE '"\\"Order\\" - ' || k || '"' END || ',"inner":{{"score":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '0.5' END || ',"parts":[{{"ok":"True","note":null}}]}}}}' AS json FROM x""",
    "unified_markdown": f"""SELECT o_orderkey AS doc_id, '# ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE 'Untitled Document' END || {_C} || {_C} || '## Document Information' || {_C} || {_C} || '- **Author:** ' || CASE WHEN o_orderkey % 5 = 0 THEN 'A. Clerk' ELSE 'Unknown' END || {_C} || '- **Pages:** 1' || {_C}
 || CASE WHEN o_orderkey % 4 = 0 THEN '- **Created:** ' || strftime(o_orderdate, '%Y-%m-%d') || {_C} ELSE '' END || {_C} || CASE WHEN o_orderkey % 7 <> 0 THEN '## Document Structure' || {_C} || {_C} || '### Head' || {_C} || 'No. ' || o_orderkey || {_C} || {_C} || '- item' || {_C} || {_C} ELSE '' END
 || '## Page 1' || {_C} || {_C} || '### Table 1' || {_C} || {_C} || '| a |' || {_C} || {_C} || '### Form Fields' || {_C} || {_C} || '- ' || CASE WHEN o_orderstatus = 'F' THEN '☑' ELSE '☐' END || ' **paid**' || {_C} || '- **Unlabeled Field:** ' || o_orderstatus || {_C}
 || CASE WHEN o_orderkey % 3 = 0 THEN {_C} || '### Handwritten Content' || {_C} || {_C} || '- note' || {_C} ELSE '' END AS markdown FROM orders""",
    "reader_confidence": f"WITH {PAGES}, c AS (SELECT engine, CASE WHEN confidence > 1 THEN confidence ELSE round(confidence * 100, 4) END - CASE WHEN ocr_id % 9 = 0 THEN 100 ELSE 0 END AS v FROM (SELECT DISTINCT ocr_id, document_id, page, engine, confidence FROM p)) SELECT engine, round(coalesce(avg(floor(v)) FILTER (v > 0) / 100, 0.5), 6) AS confidence FROM c GROUP BY 1",
    "language_dispatch": f"""WITH s AS (SELECT doc_id, text, regexp_matches(text, '[^\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]') AS has FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN has THEN {_case_lang()} END AS b FROM s)
SELECT doc_id, CASE WHEN NOT has THEN 'unknown' WHEN b.score < 0.3 THEN 'en' ELSE b.language END AS auto, CASE WHEN has THEN 'heuristic' ELSE 'auto' END AS method, CASE WHEN has AND length(text) % 3 > 0 THEN 'nl' ELSE 'unknown' END AS named, CASE WHEN NOT has THEN 'Empty text' WHEN length(text) % 3 = 0 THEN 'detection failed' END AS named_error,
 CASE WHEN has THEN 'Method ''polyglot'' not available' ELSE 'Empty text' END AS gone_error FROM b""",
    "language_support": "SELECT * FROM (VALUES ('detection', 20, 'en,es,fr,de,it,pt,ru,zh,ja,ko,ar,hi'), ('processing', 0, ''), ('translation', 39, 'en,es,fr,de,it,pt,ru,zh,ja,ko,ar,hi')) v(component, n, first_ones)",
    "cache_lookups": f"WITH {_CACHE} SELECT found, count(*) AS n FROM g GROUP BY 1",
    "cache_promoted": f"""WITH {_CACHE}, n AS (SELECT h, count(*) AS c, max(ts) AS t FROM a GROUP BY 1)
SELECT h AS file_hash, mb AS size_mb, 1 + coalesce(c, 0) AS count, 1.5::DOUBLE AS priority, strftime(coalesce(t, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS last_access FROM m LEFT JOIN n USING (h)
UNION ALL SELECT h, mb, c, 1.0, strftime(t, '%Y-%m-%d %H:%M:%S') FROM dk JOIN n USING (h) WHERE h NOT IN (SELECT h FROM m)""",
    "cache_warmed": f"""WITH {_CACHE}, f AS (SELECT h, mb * 16 AS mb, (h % 5)::DOUBLE AS p FROM dk WHERE h % 4 = 0), ok AS (SELECT * FROM f WHERE NOT mb > 32 AND (p > 2 OR p > 0.1 * mb)),
k AS (SELECT h, mb, 1.5::DOUBLE AS p FROM m WHERE h NOT IN (SELECT h FROM ok) UNION ALL SELECT * FROM ok) SELECT h AS file_hash, mb AS size_mb, 1 AS count, p AS priority FROM k UNION ALL SELECT h, mb, 1, 1.0 FROM dk WHERE h IN (SELECT h FROM a) AND h NOT IN (SELECT h FROM k)""",
    "cache_statistics": f"WITH {_CACHE}, s AS (SELECT count(*) AS e, sum(mb) AS mb FROM m), r AS (SELECT count(*) FILTER (found <> 'miss') AS hits, count(*) FILTER (found = 'miss') AS misses FROM g) SELECT e AS memory_entries, round(mb, 6) AS memory_size_mb, e AS total_accesses, round(mb / 512, 6) AS memory_utilization, 1.0::DOUBLE AS avg_accesses_per_entry, (SELECT count(DISTINCT h) FROM a) AS tracked_patterns, hits, misses, round(hits / (hits + misses), 6) AS hit_rate FROM s, r",
    "model_choice": """WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS o, p_size % 3 = 0 AS a, p_partkey % 5 AS k FROM part) SELECT p_partkey, CASE WHEN k < 2 THEN CASE WHEN o THEN 'gpt-4o' WHEN a THEN 'claude-3-5-sonnet' ELSE 'llama-3.2-vision' END ELSE CASE WHEN o THEN 'gpt-4o-mini' WHEN a THEN 'claude-3-haiku' ELSE 'llama-3.2-vision' END END AS model FROM p""",
    "prompts_by_type": """WITH t AS (SELECT * FROM (VALUES (0, 'general', 'Analyze this document and provide a detailed description of its content, structure, and purpose.'), (1, 'tables', 'Identify and describe all tables in this document. For each table, describe its structure, headers, and key data. Format your response to clearly separate each table and its contents.'),
 (2, 'forms', 'Identify all form fields in this document. List the field names, types, and any filled values you can see. Present the form fields in a structured format.'), (3, 'metadata', 'Extract metadata from this document including title, author, date, document type, and any other identifying information. Present the metadata in a structured format with clear labels.'),
 (4, 'summary', 'Provide a concise summary of this document''s main points and key information.'), (5, 'unknown', 'Analyze this document and provide a detailed description of its content, structure, and purpose.')) v(i, kind, prompt)) SELECT kind, prompt, count(*) AS n FROM part JOIN t ON p_partkey % 6 = i GROUP BY 1, 2""",
}
