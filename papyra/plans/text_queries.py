"""Queries of text, quality, language and classification, over documents, OCR results and form fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import classify, language, quality, text
from papyra.session import spread, table

# The SQL side spells out the same classes; RE2 and Java agree on them.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NWS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source")).filter("text is not null")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct OCR readings: repeated rows count once."""
    return table(spark, sf, "ocr_results").select("ocr_id", "document_id", "page", "engine", "engine_ord", "text", "confidence", "level").distinct()


def _rm(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def _strip(c: str) -> str:
    return _rm(c, f"^{WS}+|{WS}+$")


def _collapse(c: str) -> str:
    return _strip(_rm(c, f"{WS}+", " "))


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _chars(c: str, pattern: str) -> str:
    return f"(length({c}) - length({_rm(c, pattern)}))"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END)"


ALPHA = _ratio(_chars("text", r"\p{L}"), "length(text)")
SPACE = _ratio(_chars("text", WS), "length(text)")
TOKENS = _count("text", f"{NWS}+")
AVG_WORD = _ratio(f"length({_rm('text', WS)})", TOKENS)
SPECIAL = _ratio(_chars("text", r"[^\p{L}\p{N}\t-\r\x1c-\x20\x85\p{Z}]"), "length(text)")
CID = _count("text", r"\(cid:[0-9]+\)")
_5 = [
    f"least({ALPHA} / 0.8::DOUBLE, 1.0::DOUBLE)", f"CASE WHEN {SPACE} < 0.3::DOUBLE THEN least({SPACE} / 0.15::DOUBLE, 1.0::DOUBLE) ELSE 0.5 END::DOUBLE", f"1.0::DOUBLE - least({SPECIAL} / 0.1::DOUBLE, 1.0::DOUBLE)",
    f"CASE WHEN {AVG_WORD} BETWEEN 3 AND 8 THEN 1.0 ELSE 0.5 END::DOUBLE", f"CASE WHEN {CID} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {CID} / 100.0::DOUBLE) END",
]
QUALITY = f"(CASE WHEN length(text) > 0 THEN (({_5[0]}) + ({_5[1]}) + ({_5[2]}) + ({_5[3]}) + ({_5[4]})) / 5 ELSE 0.0 END)"
GARBAGE = _ratio(_chars("text", r"[<>;()\[\]{}@#$%^&*]"), "length(text)")
READABLE = f"(length(text) >= 10 AND {ALPHA} >= 0.5 AND {GARBAGE} <= 0.1 AND {_count('text', r'\p{L}{3,}')} >= 3)"
PAGES = "p AS (SELECT DISTINCT ocr_id, document_id, page, engine, engine_ord, text, confidence, level FROM ocr_results)"


def text_quality_by_lang(spark, sf):
    d = _docs(spark, sf).withColumn("q", text.text_quality(F.col("text")))
    out = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("avg_quality"), F.round(F.avg(text.alpha_ratio(F.col("text"))), 6).alias("avg_alpha"))
    return out


def text_quality_class(spark, sf):
    return _docs(spark, sf).withColumn("c", text.quality_class(text.text_quality(F.col("text")))).groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("c", "quality_class")


def readable_filter(spark, sf):
    d = _docs(spark, sf)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_readable_text(F.col("text"))).alias("n_readable"), F.count_if(text.is_garbage_text(F.col("text"))).alias("n_garbage"))


def text_validation(spark, sf):
    v = text.validate_text_quality(F.col("text"))
    return table(spark, sf, "ocr_results").select("ocr_id", "text").distinct().select("ocr_id", v.alias("v")).select("ocr_id", "v.valid", F.round("v.alpha_ratio", 6).alias("alpha_ratio"), "v.readable")


def _noisy(spark, sf):
    """Documents with scan noise put in by the remainder of their id."""
    noise = F.element_at(F.array(*map(F.lit, ["", " || ", " ____ ", " (cid:7) ", " ~~ ` ^^ ", " ... "])), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.concat(F.substring("text", 1, 200), noise, F.lit(" * "), F.substring("text", 201, 100_000_000)).alias("text"))


_NOISY = "d AS (SELECT doc_id, concat(left(text, 200), (['', ' || ', ' ____ ', ' (cid:7) ', ' ~~ ` ^^ ', ' ... '])[doc_id % 6 + 1], ' * ', substring(text, 201)) AS text FROM documents WHERE text IS NOT NULL)"
_CIDCLEAN = _collapse(_rm("text", r"\(cid:[0-9]+\)"))


def _artifacts(c: str) -> str:
    for p in (r"\|{2,}", "_{3,}", "~{2,}", "`{2,}", r"\^{2,}", r"\\{2,}"):
        c = _rm(c, p, " ")
    return _collapse(_rm(c, rf"{WS}+[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x85\p{{Z}}]{WS}+", " "))


def text_clean_pipeline(spark, sf):
    s = text.clean_extracted_text(F.col("text"))
    return _noisy(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.md5("s.text").alias("digest"), "s.original_length", "s.cleaned_length", "s.cid_codes", F.array_join("s.steps", ",").alias("steps"))


def text_artifacts_removed(spark, sf):
    d = _noisy(spark, sf)
    return d.select("doc_id", F.md5(text.clean_ocr_artifacts(F.col("text"))).alias("artifacts"), F.md5(text.clean_cid_codes(F.col("text"))).alias("cid"), F.md5(text.normalize_whitespace(F.col("text"))).alias("whitespace"))


def text_special_characters(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.md5(text.clean_special_characters(F.col("text"))).alias("kept"), F.md5(text.clean_special_characters(F.col("text"), False)).alias("bare"))


def cid_trigger(spark, sf):
    d = _docs(spark, sf).withColumn("text", F.concat("text", F.repeat(F.lit("(cid:12)"), (F.col("doc_id") % 40).cast("int"))))
    return d.select("doc_id", text.needs_cid_repair(F.col("text")).alias("repair"))


def valid_names(spark, sf):
    f = table(spark, sf, "form_fields").select("field_id", "value").distinct()
    return f.select("field_id", text.extract_valid_name(F.col("value")).alias("name"))


def _spaced(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    digits = F.array_join(F.transform(F.split(F.date_format("o_orderdate", "MM/dd/yyyy"), ""), lambda x: x), " ")
    return o.select("o_orderkey", F.trim(digits).alias("raw"))


def ocr_spacing(spark, sf):
    s = _spaced(spark, sf)
    return s.select("o_orderkey", text.normalize_ocr_spacing(F.col("raw")).alias("clean"))


def dates_from_ocr(spark, sf):
    s = _spaced(spark, sf)
    return s.select("o_orderkey", text.extract_date(F.col("raw")).alias("day"))


def dates_of_all_forms(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    forms = F.array(F.date_format(d, "M/d/yyyy"), F.date_format(d, "d-M-yyyy"), F.date_format(d, "yyyy/M/d"), F.date_format(d, "MM/dd/yy"), F.date_format(d, "MMddyyyy"))
    return o.select("o_orderkey", F.transform(forms, lambda x: text.extract_date(x).cast("string")).alias("days")).select("o_orderkey", F.array_join("days", ",", "-").alias("days"))


def document_numbers(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.concat(F.lit("A "), F.array_join(F.filter(F.split(F.col("o_orderkey").cast("string"), ""), lambda x: x != ""), " "), F.lit(" B"))
    return o.select("o_orderkey", text.normalize_document_number(raw).alias("number"))


def admission_classes(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.element_at(F.array(F.lit("H "), F.lit("F"), F.lit("x")), (F.col("c_custkey") % 3 + 1).cast("int")), (F.col("c_custkey") % 10).cast("string"), F.element_at(F.array(F.lit("B"), F.lit("")), (F.col("c_custkey") % 2 + 1).cast("int")))
    return c.select("c_custkey", text.normalize_class_of_admission(raw).alias("class"))


def upper_names(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", text.normalize_name(F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "   "), F.lit(" x"))).alias("name"))


def named_fields(spark, sf):
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = text.normalize_fields({"birth_date": F.date_format("o_orderdate", "MM/dd/yyyy"), "full_name": F.col("c_name"), "passport_number": F.concat(F.lit("P "), F.col("o_orderkey").cast("string")), "country": F.lit("new  zealand"), "note": F.col("o_orderstatus")})
    return c.select("o_orderkey", *[v.alias(k) for k, v in f.items()])


def json_clean_text(spark, sf):
    p = _pages(spark, sf)
    return p.select("ocr_id", F.md5(text.clean_text_for_json(F.col("text"))).alias("kept"), F.md5(text.clean_text_for_json(F.col("text"), False)).alias("line"), F.md5(text.unicode_cleanup(F.col("text"))).alias("plain"))


def wrapped_forms(spark, sf):
    f = table(spark, sf, "form_fields").select("field_id", "value").distinct().filter("value is not null")
    return f.select("field_id", text.wrap_form_text(F.concat(F.lit("a—"), F.col("value")), 40).alias("wrapped"))


def character_fixes(spark, sf):
    f = table(spark, sf, "form_fields").select("field_id", "value").distinct().filter("value is not null")
    return f.select("field_id", *[text.ocr_character_fixes(F.col("value"), w).alias(w) for w in ("cell", "transcript", "handwriting")])


def json_in_text(spark, sf):
    r = table(spark, sf, "extraction_records").select("record_id", "payload").distinct()
    return r.select("record_id", text.first_json_object(F.concat(F.lit("answer: "), F.col("payload"), F.lit(" end"))).isNotNull().alias("found"))


def kv_split(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return d.select("doc_id", "line", text.key_value(F.col("t")).alias("k")).filter("k is not null").select("doc_id", "line", "k.key", "k.value", "k.confidence")


def tokens_and_sentences(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.size(text.token_list(F.col("text"))).alias("n_tokens"), F.size(text.sentences(F.col("text"))).alias("n_sentences"), text.form_keyword(F.col("text")).alias("form_word"))


def format_text_content(spark, sf):
    return _pages(spark, sf).filter("text is not null").select("ocr_id", F.md5(text.paragraphs(F.col("text"))).alias("digest"))


def flesch_by_source(spark, sf):
    d = _docs(spark, sf).withColumn("f", F.round(quality.flesch(F.col("text")), 6))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 4).alias("flesch"), F.round(F.max("f"), 4).alias("best"), F.round(F.min("f"), 4).alias("worst"))


def quality_scores(spark, sf):
    m = _docs(spark, sf).select("doc_id", quality.text_metrics(F.col("text")).alias("m"))
    return m.select("doc_id", *[F.round(f"m.{n}", 6).alias(n) for n in ("coherence", "artifacts", "density", "score")])


def character_distribution(spark, sf):
    d = _docs(spark, sf).select("doc_id", quality.character_distribution(F.col("text")).alias("x"))
    return d.select("doc_id", *[F.round(f"x.{n}", 6).alias(n) for n in ("alphabetic", "numeric", "punctuation", "whitespace")])


def confidence_stats(spark, sf):
    p = _pages(spark, sf).withColumn("c", F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")))
    a = p.groupBy("engine", "level").agg(*quality.confidence_stats(F.round("c", 4)))
    return a.select("engine", "level", *[F.round(x, 6).alias(x) for x in ("average", "variance", "minimum", "maximum")], "distribution")


def _extraction(spark, sf):
    """Documents with the parts an extraction has: text, tables and fields, counted before they are joined."""
    d = table(spark, sf, "doc_profiles").select("document_id").distinct()
    one = F.row_number().over(Window.partitionBy("document_id", "page").orderBy(F.col("text").isNull(), "engine_ord", "ocr_id"))
    t = _pages(spark, sf).withColumn("_n", one).filter("_n = 1").groupBy("document_id").agg(F.sum(F.length("text")).alias("n_text"), F.avg(F.round(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), 4)).alias("conf"))
    f = table(spark, sf, "form_fields").select("field_id", "document_id", "value", "confidence").distinct().filter("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_forms"), F.avg("confidence").alias("f_conf"))
    return d.join(t, "document_id", "left").join(f, "document_id", "left")


def extraction_quality(spark, sf):
    e = _extraction(spark, sf).select("document_id", F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_forms", F.lit(0)).alias("n_forms"), F.coalesce("conf", F.lit(0.5)).alias("conf"), "f_conf")
    form = quality.form_score(F.col("n_forms") > 0, F.col("n_forms") > 5, F.col("f_conf"))
    tab = quality.table_score(F.col("n_text") > 500, F.col("n_text") > 900, F.col("conf"), F.lit(2), F.lit(2))
    structure = quality.structure_score(F.col("n_text") > 500, F.col("n_forms") > 0, F.lit(True), F.lit(False), tab, form, F.lit(0.5))
    covered = quality.coverage(F.col("n_text"), F.lit(0), F.col("n_forms"))
    complete = quality.completeness(F.col("n_text") > 0, F.col("n_forms") > 0, F.lit(True), covered)
    consistent = quality.consistency(F.when(F.col("n_text") > 0, "x").otherwise(""), F.lit(True), F.col("n_forms") > 0)
    total = quality.overall({"structure": structure, "confidence": F.col("conf"), "completeness": complete, "consistency": consistent})
    advice = quality.recommendations(F.lit(0.9), F.lit(0.0), structure, F.col("conf"), F.lit(0.9), total)
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.select("document_id", r(structure, "structure"), r(covered, "coverage"), r(complete, "completeness"), r(consistent, "consistency"), r(total, "overall"), F.array_join(advice, ",").alias("advice"))


def image_scores(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 700).alias("lap"), (F.col("p_partkey") % 90).alias("dev"), (F.col("p_partkey") % 40).alias("noise"), (F.col("p_partkey") % 2300 + 50).alias("side"))
    s = quality.image_score(F.col("lap"), F.col("dev"), F.col("noise"), F.col("side"))
    level = quality.image_level(s)
    b = quality.brightness_score(F.col("dev") * 2, F.col("dev"), F.col("lap"), F.col("noise"))
    return p.select("p_partkey", F.round(s, 9).alias("score"), level.alias("level"), quality.image_pipeline(level).alias("pipeline"), F.round(b, 9).alias("brightness_score"))


def model_confidences(spark, sf):
    p = _pages(spark, sf).filter("text is not null").withColumn("text", F.concat("text", F.element_at(F.array(*map(F.lit, ["", " |||", " [unclear] ", " it appears to be a table with a header and a footer", " ___ ...."])), (F.col("ocr_id") % 5 + 1).cast("int"))))
    c = F.col("text")
    return p.select("ocr_id", F.round(quality.transcript_confidence(c), 6).alias("transcript"), F.round(quality.vision_confidence(c), 6).alias("vision"), F.round(quality.answer_confidence(c), 6).alias("answer"))


def language_detect(spark, sf):
    d = _docs(spark, sf).select("doc_id", language.detect(F.col("text")).alias("x"))
    return d.select("doc_id", "x.language", F.round("x.confidence", 6).alias("confidence"))


def language_confusion(spark, sf):
    p = _pages(spark, sf).select("document_id", language.detect(F.col("text")).alias("x")).select("document_id", "x.language")
    labels = table(spark, sf, "doc_profiles").select("document_id", F.col("language").alias("label")).distinct()
    return p.join(labels, "document_id").groupBy("label", "language").agg(F.count(F.lit(1)).alias("n"))


def translate_identity(spark, sf):
    d = language.translate(_docs(spark, sf), "text", F.col("lang"), "en")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("translated_text")).alias("n_chars"), F.max("translation_confidence").alias("confidence"))


def _business(spark, sf):
    """Invoices, statements and receipts made from orders."""
    o = spread(table(spark, sf, "orders")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    key = F.col("o_orderkey").cast("string")
    inv = F.concat(F.lit("Invoice Number: INV-"), key, F.lit("\nBill To: "), F.col("c_name"), F.lit("\nDue Date: "), day, F.lit("\nTotal Amount: $"), amount)
    bank = F.concat(F.lit("Bank Statement\nAccount Number: "), key, F.lit("\nBeginning balance $"), amount, F.lit("\nEnding balance $"), amount, F.lit("\nStatement Period "), day)
    tax = F.concat(F.lit("Form 1040 Department of the Treasury\nSSN "), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-12-3456\nTaxable income $"), amount, F.lit("\nFiling status single"))
    deal = F.concat(F.lit("This agreement is made by the party of the first part, whereas the governing law applies. Signature: "), F.col("c_name"))
    return o.select("o_orderkey", F.element_at(F.array(inv, bank, tax, deal, F.lit("plain words: a financial plan, legal advice and a medical one")), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("text"), F.array_repeat(F.array(F.array(F.lit("item"), F.when(F.col("o_orderkey") % 3 == 0, "$1,200.50").otherwise("12"))), (F.col("o_orderkey") % 4).cast("int")).alias("tables"), F.array_repeat(F.when(F.col("o_custkey") % 5 == 0, "SSN: ").otherwise("name: "), (F.col("o_custkey") % 7).cast("int")).alias("forms"), F.element_at(F.array(F.lit("invoice.pdf"), F.lit("statement.pdf"), F.lit("tax_1040.pdf"), F.lit("x.pdf")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("title"))


_BUSINESS = r"""b AS (SELECT o_orderkey, (['Invoice Number: INV-' || o_orderkey || chr(10) || 'Bill To: ' || c_name || chr(10) || 'Due Date: ' || strftime(o_orderdate, '%m/%d/%Y') || chr(10) || 'Total Amount: $' || o_totalprice::DECIMAL(12,2)::VARCHAR,
 'Bank Statement' || chr(10) || 'Account Number: ' || o_orderkey || chr(10) || 'Beginning balance $' || o_totalprice::DECIMAL(12,2)::VARCHAR || chr(10) || 'Ending balance $' || o_totalprice::DECIMAL(12,2)::VARCHAR || chr(10) || 'Statement Period ' || strftime(o_orderdate, '%m/%d/%Y'),
 'Form 1040 Department of the Treasury' || chr(10) || 'SSN ' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-12-3456' || chr(10) || 'Taxable income $' || o_totalprice::DECIMAL(12,2)::VARCHAR || chr(10) || 'Filing status single',
 'This agreement is made by the party of the first part, whereas the governing law applies. Signature: ' || c_name, 'plain words: a financial plan, legal advice and a medical one'])[o_orderkey % 5 + 1] AS text, o_orderkey % 4 AS n_tables, o_custkey % 7 AS n_forms, o_orderkey % 3 = 0 AS money, o_custkey % 5 = 0 AS taxed,
 (['invoice.pdf', 'statement.pdf', 'tax_1040.pdf', 'x.pdf'])[o_orderkey % 4 + 1] AS title FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _signals(b: DataFrame) -> tuple[DataFrame, dict, dict]:
    """The documents with each signal as a column of its own, and the columns of patterns and of other signals by name."""
    t, low = F.col("text"), F.col("low")
    p = classify.pattern_signals(t, low)
    others = {**classify.structure_signals(t, F.size("tables"), F.size("forms"), classify.financial_tables(F.col("tables")), classify.tax_forms(F.col("forms"))), **{f"{k}_keywords": v for k, v in classify.keyword_signals(t, low).items()}, **classify.format_signals(t, F.col("title")), **{f"{k}_content": v for k, v in classify.semantic_signals(t, low).items()}}
    made = b.withColumn("low", F.lower("text")).select("o_orderkey", "text", *[v.alias(f"p_{k}") for k, v in p.items()], *[v.alias(f"o_{k}") for k, v in others.items()])
    return made, {k: F.col(f"p_{k}") for k in p}, {k: F.col(f"o_{k}") for k in others}


def classify_documents(spark, sf):
    b, p, others = _signals(_business(spark, sf))
    d = b.select("o_orderkey", "text", classify.decide(p, others).alias("x"), classify.signal_count([*p.values(), *others.values()]).alias("n"))
    keys = classify.key_indicators(F.col("text"), F.col("x.document_type"))
    return d.select("o_orderkey", "x.document_type", F.round("x.confidence", 6).alias("confidence"), *[keys[k].alias(k) for k in ("ssn", "account_number", "invoice_number")], F.array_join(classify.suggestions(F.col("x.document_type"), F.col("x.confidence"), F.col("n")), "|").alias("suggestions"))


def classify_signals(spark, sf):
    b, p, others = _signals(_business(spark, sf))
    return b.select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in {**p, **{k: v for k, v in others.items() if k.split("_")[-1] in ("keywords", "content", "title") or k.startswith("has_c")}}.items()])


def simple_document_type(spark, sf):
    d = _docs(spark, sf).select("doc_id", classify.simple_type(F.col("text")).alias("x"))
    return d.select("doc_id", "x.document_type", "x.confidence")


def block_types(spark, sf):
    e = table(spark, sf, "elements").select("document_id", "id", "text", "element_type", "level").distinct()
    size, bold = F.when(F.col("element_type") == "heading", 20 - 2 * F.col("level")).otherwise(10), F.col("element_type") == "heading"
    return e.select("document_id", "id", classify.block_type(F.col("text"), size, bold).alias("block_type"))


QUERIES = {
    f.__name__: f
    for f in (
        text_quality_by_lang, text_quality_class, readable_filter, text_validation, text_clean_pipeline, text_artifacts_removed, text_special_characters, cid_trigger, valid_names, ocr_spacing, dates_from_ocr, dates_of_all_forms,
        document_numbers, admission_classes, upper_names, named_fields, json_clean_text, wrapped_forms, character_fixes, json_in_text, kv_split, tokens_and_sentences, format_text_content, flesch_by_source, quality_scores,
        character_distribution, confidence_stats, extraction_quality, image_scores, model_confidences, language_detect, language_confusion, translate_identity, classify_documents, classify_signals, simple_document_type, block_types,
    )
}

_SYL = f"greatest({_count('text', '[aeiouyAEIOUY]+')} - (CASE WHEN regexp_matches(text, '[eE]$') THEN 1 ELSE 0 END), 1)"
_FLESCH = f"(CASE WHEN {TOKENS} >= 10 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * ({TOKENS} / ({_count('text', '[.!?]+')} + 1)) - 84.6::DOUBLE * ({_SYL} / {TOKENS}))) ELSE 0.0 END)"
_COH = f"(CASE WHEN length(text) = 0 THEN 0.0 WHEN {TOKENS} < 5 THEN 0.5 ELSE ((CASE WHEN {AVG_WORD} BETWEEN 3 AND 8 THEN 1.0 ELSE 0.5 END)::DOUBLE + least({ALPHA} / 0.8::DOUBLE, 1.0::DOUBLE) + least({SPACE} / 0.15::DOUBLE, 1.0::DOUBLE)) / 3 END)"
# single letters are the tokens of word characters with one character, as RE2 has no look-around
_SINGLE = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) = 1 AND regexp_matches(x, '^[a-z]$')))"
_ART = f"least({_ratio(f'({_SINGLE} + ' + ' + '.join(_count('text', p) for p in (r'\|{2,}', '_{3,}', r'\.{3,}', r'\?{2,}', '[0-9][a-zA-Z][0-9]')) + ')', 'length(text)')}, 1.0)"
_DENS = _ratio(_chars("text", r"[\p{L}\p{N}]"), "length(text)")
_QUOTES = f"translate(text, '‘’“”{chr(0xA0)}', '''''\"\" ')"


def _case_lang(c: str = "text") -> str:
    n = f"length({c})"
    items = []
    for i, (code, cls) in enumerate(language.CLASSES.items()):
        items.append(f"{{'score': ({n} - length({_rm(c, f'[{cls}]')}))::DOUBLE / {n}, 'place': {-i}, 'language': '{code}'}}")
    return f"list_reverse_sort([{', '.join(items)}])[1]"


_BLANK = f"(text IS NULL OR NOT regexp_matches(text, '{NWS}'))"
_LANG = f"CASE WHEN {_BLANK} THEN {{'language': 'unknown', 'confidence': 0.0::DOUBLE}} WHEN b.score < 0.3 THEN {{'language': 'en', 'confidence': 0.5::DOUBLE}} ELSE {{'language': b.language, 'confidence': b.score}} END"


def _rl(c: str, p: str) -> str:
    return f"coalesce(regexp_matches({c}, '{p}'), false)"


def _pattern_sql() -> dict[str, str]:
    out = {}
    for name, ps in classify.PATTERNS.items():
        out[name] = "(" + " + ".join(_rl("lower(text)", p.replace(r"\s", WS)) + "::INT" for p in ps) + f") / {float(len(ps))}::DOUBLE"
    return out


# Fixed values, written out again so that the SQL does not share the operator's lists.
_KEYWORDS = {
    "financial": (["tax", "income", "payment", "amount", "total", "balance", "account"], 100), "legal": (["contract", "agreement", "terms", "conditions", "party", "whereas"], 50),
    "medical": (["patient", "diagnosis", "treatment", "medical", "doctor", "physician"], 30),
}


def _other_sql() -> dict[str, str]:
    out = {"long_document": "CASE WHEN len(string_split(text, chr(10))) > 50 THEN 0.7 END", "has_signatures": f"CASE WHEN {_rl('lower(text)', 'signature|signed|date.*signed')} THEN 0.6 END"}
    out["has_tables"] = "CASE WHEN n_tables > 0 THEN least(n_tables / 10.0::DOUBLE, 1.0::DOUBLE) END"
    out["financial_tables"] = "CASE WHEN n_tables > 0 AND money THEN 0.8::DOUBLE END"
    out["has_forms"] = "CASE WHEN n_forms > 0 THEN least(n_forms / 20.0::DOUBLE, 1.0::DOUBLE) END"
    out["tax_forms"] = "CASE WHEN n_forms > 0 AND taxed THEN 0.9::DOUBLE END"
    for name, (words, norm) in _KEYWORDS.items():
        n = "len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + ")))"
        out[f"{name}_keywords"] = f"CASE WHEN {n} > 0 THEN least({n} / {float(norm)}::DOUBLE, 1.0::DOUBLE) END"
    for name, (p, v) in classify.FORMATS.items():
        out[f"has_{name}"] = f"CASE WHEN {_rl('text', p)} THEN {v}::DOUBLE END"
    low = "lower(title)"
    out["tax_in_title"] = f"CASE WHEN {_rl(low, 'tax|1040')} THEN 0.9::DOUBLE END"
    out["invoice_in_title"] = f"CASE WHEN NOT {_rl(low, 'tax|1040')} AND contains({low}, 'invoice') THEN 0.9::DOUBLE END"
    out["statement_in_title"] = f"CASE WHEN NOT {_rl(low, 'tax|1040|invoice')} AND contains({low}, 'statement') THEN 0.8::DOUBLE END"
    for name, ps in classify.PHRASES.items():
        out[f"{name}_content"] = "(" + " + ".join(f"contains(lower(text), '{p}')::INT" for p in ps) + f") / {float(len(ps))}::DOUBLE"
    return out


def _decide_sql() -> str:
    totals = {k: f"coalesce({v}, 0) * 2" for k, v in _pattern_sql().items()}
    for k, v in _other_sql().items():
        t = classify.signal_type(k)
        if t:
            totals[t] = totals.get(t, "0") + f" + coalesce({v}, 0)"
    return "list_reverse_sort([" + ", ".join(f"{{'score': ({v})::DOUBLE, 'place': {-i}, 'name': '{k}'}}" for i, (k, v) in enumerate(totals.items())) + "])[1]"


def _count_sql() -> str:
    return " + ".join(f"coalesce({v} > 0, false)::INT" for v in [*_pattern_sql().values(), *_other_sql().values()])


_ISIZE = "CASE WHEN side >= 2000 THEN 1.0 WHEN side >= 1000 THEN 0.8 WHEN side >= 500 THEN 0.5 ELSE greatest(0.2, side / 500.0) END::DOUBLE"
_U = lambda c: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c})::DOUBLE))"
_ISCORE = f"(0.35::DOUBLE * {_U('lap / 500.0')} + 0.25::DOUBLE * {_U('dev / 75.0')} + 0.2::DOUBLE * {_U('1 - noise / 30.0')} + 0.2::DOUBLE * {_ISIZE})"


def _doc(select: str, tail: str = "") -> str:
    return f"SELECT {select} FROM documents WHERE text IS NOT NULL {tail}"


_UNC = [p.replace("'", "''") for p in quality.UNCERTAIN]
_TRANS = "0.8::DOUBLE * CASE WHEN length(text) < 3 THEN 0.7 ELSE 1.0 END::DOUBLE" + "".join(f" * CASE WHEN contains(text, '{s}') THEN 0.6 ELSE 1.0 END::DOUBLE" for s in ("|||", "___", "...", "???")) + f" * CASE WHEN {ALPHA} < 0.3 THEN 0.7 ELSE 1.0 END::DOUBLE"
_UNCLEAR = "(length(text) - length(replace(lower(text), '[unclear]', ''))) / 9"
_VIS = f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, (0.85::DOUBLE - 0.1::DOUBLE * least({_UNCLEAR}, 3.0::DOUBLE)) * CASE WHEN length(text) < 10 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN {ALPHA} < 0.2 THEN 0.9 ELSE 1.0 END::DOUBLE))"
_ANS = "0.8::DOUBLE * CASE WHEN length(text) < 20 THEN 0.6 WHEN length(text) > 200 THEN 1.1 ELSE 1.0 END::DOUBLE" + "".join(f" * CASE WHEN contains(lower(text), '{p}') THEN 0.8 ELSE 1.0 END::DOUBLE" for p in _UNC) + " * CASE WHEN " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in quality.ELEMENTS) + " > 2 THEN 1.1 ELSE 1.0 END::DOUBLE"
_CONF = "CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END"


_E = f"""e AS (SELECT document_id, coalesce(n_text, 0) AS n_text, coalesce(n_forms, 0) AS n_forms, coalesce(conf, 0.5) AS conf, f_conf FROM (SELECT DISTINCT document_id FROM doc_profiles)
 LEFT JOIN (SELECT document_id, sum(length(text)) AS n_text, avg(round({_CONF}, 4)) AS conf FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY text IS NULL, engine_ord, ocr_id) = 1) GROUP BY 1) USING (document_id)
 LEFT JOIN (SELECT document_id, count(*) AS n_forms, avg(confidence) AS f_conf FROM (SELECT DISTINCT field_id, document_id, value, confidence FROM form_fields WHERE document_id IS NOT NULL) GROUP BY 1) USING (document_id)),
s AS (SELECT *, CASE WHEN n_forms > 0 THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN n_forms > 5 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN f_conf > 0.7 THEN 0.4 ELSE 0 END::DOUBLE AS form,
 CASE WHEN n_text > 500 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN n_text > 900 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN conf > 0.7 THEN 0.3 ELSE 0 END::DOUBLE + 0.2::DOUBLE AS tab FROM e),
t AS (SELECT *, ((n_text > 500)::INT + (n_forms > 0)::INT + 1) / 4.0::DOUBLE * 0.4::DOUBLE + (tab + form + 0.5::DOUBLE) / 3 * 0.6::DOUBLE AS structure,
 CASE WHEN n_text > 0 OR n_forms > 0 THEN (CASE WHEN n_text > 0 THEN least(n_text / 1000.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END + CASE WHEN n_forms > 0 THEN least(n_forms / 5.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END) / ((n_text > 0)::INT + (n_forms > 0)::INT) ELSE 0.5 END AS coverage,
 ((n_text = 0)::INT + 1 + (n_forms > 0)::INT + 1) / 4.0::DOUBLE AS consistency FROM s),
u AS (SELECT *, ((n_text > 0)::INT + (n_forms > 0)::INT + 1) / 3.0::DOUBLE * 0.7::DOUBLE + coverage * 0.3::DOUBLE AS completeness FROM t),
v AS (SELECT *, (structure * 0.25::DOUBLE + conf * 0.2::DOUBLE + completeness * 0.15::DOUBLE + consistency * 0.1::DOUBLE) / (0.25::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE) AS overall FROM u)"""

SQL = {
    "text_quality_by_lang": _doc(f"lang, count(*) AS n, round(avg({QUALITY}), 6) AS avg_quality, round(avg({ALPHA}), 6) AS avg_alpha", "GROUP BY lang"),
    "text_quality_class": f"WITH q AS ({_doc(f'{QUALITY} AS s')}) SELECT CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'good' WHEN s >= 0.4 THEN 'fair' ELSE 'poor' END AS quality_class, count(*) AS n FROM q GROUP BY 1",
    "readable_filter": _doc(f"source, count(*) AS n, count(*) FILTER ({READABLE}) AS n_readable, count(*) FILTER (length({_strip('text')}) < 3 OR {ALPHA} < 0.5) AS n_garbage", "GROUP BY source"),
    "text_validation": f"SELECT ocr_id, coalesce(length({_strip('text')}) >= 10, false) AS valid, round(CASE WHEN text IS NULL THEN 0 ELSE {ALPHA} END, 6) AS alpha_ratio, coalesce({READABLE}, false) AS readable FROM (SELECT DISTINCT ocr_id, text FROM ocr_results)",
    "text_clean_pipeline": f"""WITH {_NOISY}, a AS (SELECT *, {_CIDCLEAN} AS t1, {CID} AS cid FROM d), b AS (SELECT *, {_artifacts('t1')} AS t2 FROM a),
c AS (SELECT *, {_strip(_rm('t2', ' +', ' '))} AS t3 FROM b)
SELECT doc_id, md5(t3) AS digest, length(text) AS original_length, length(t3) AS cleaned_length, cid AS cid_codes,
 array_to_string(list_filter([CASE WHEN cid > 0 THEN 'cid_codes' END, CASE WHEN length(t2) < length(t1) THEN 'ocr_artifacts' END, CASE WHEN length(t3) < length(t2) THEN 'whitespace' END], lambda x: x IS NOT NULL), ',') AS steps FROM c""",
    "text_artifacts_removed": f"WITH {_NOISY} SELECT doc_id, md5({_artifacts('text')}) AS artifacts, md5({_CIDCLEAN}) AS cid, md5({_strip('regexp_replace(' + _rm('text', ' +', ' ') + ', ' + chr(39) + '[' + chr(92) + 'n]{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS whitespace FROM d",
    "text_special_characters": _doc(f"doc_id, md5({_collapse(_rm('text', '[^a-zA-Z0-9' + WS[1:-1] + r'.,!?;:\-' + chr(39) * 2 + chr(34) + r'()\[\]{}]'))}) AS kept, md5({_collapse(_rm('text', '[^a-zA-Z0-9' + WS[1:-1] + ']'))}) AS bare"),
    "cid_trigger": "WITH d AS (SELECT doc_id, text || repeat('(cid:12)', (doc_id % 40)::INT) AS text FROM documents WHERE text IS NOT NULL), n AS (SELECT *, (length(text) - length(replace(text, '(cid:', ''))) / 5 AS c FROM d) SELECT doc_id, coalesce(c > 10 AND c / (length(text) / 100.0) > 0.1, false) AS repair FROM n",
    "valid_names": f"""WITH f AS (SELECT DISTINCT field_id, value FROM form_fields), t AS (SELECT field_id, {_collapse(_rm('value', '[^a-zA-Z0-9' + WS[1:-1] + r'.,!?;:\-' + chr(39) * 2 + chr(34) + r'()\[\]{}]'))} AS text FROM f)
SELECT field_id, CASE WHEN text IS NULL OR length({_strip('text')}) < 3 OR {ALPHA} < 0.7 OR length(text) < 2 OR {_chars('text', '[0-9]')} = length(text) OR {_chars('text', '[0-9]')} > 0.3 * length(text) THEN NULL ELSE text END AS name FROM t""",
    "ocr_spacing": "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS clean FROM orders",
    "dates_from_ocr": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders",
    "document_numbers": "SELECT o_orderkey, 'A' || o_orderkey || 'B' AS number FROM orders",
    "admission_classes": "WITH r AS (SELECT c_custkey, (['H', 'F', 'x'])[c_custkey % 3 + 1] AS a, c_custkey % 10 AS n, (['B', ''])[c_custkey % 2 + 1] AS z FROM customer) SELECT c_custkey, CASE WHEN a = 'x' THEN a || n || z ELSE a || '-' || n || z END AS class FROM r",
    "upper_names": f"SELECT c_custkey, upper({_collapse('replace(c_name, ' + chr(39) + '#' + chr(39) + ', ' + chr(39) + '   ' + chr(39) + ') || ' + chr(39) + ' x' + chr(39))}) AS name FROM customer",
    "named_fields": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS birth_date, upper(c_name) AS full_name, 'P' || o_orderkey AS passport_number, 'NEW ZEALAND' AS country, o_orderstatus AS note FROM orders JOIN customer ON o_custkey = c_custkey",
    "character_fixes": "SELECT field_id, translate(value, 'lO', '10') AS cell, translate(value, '0', 'O') AS transcript, CASE WHEN regexp_matches(translate(value, 'l', '1'), '[0-9]') THEN translate(translate(value, 'l', '1'), 'OS', '05') ELSE translate(value, 'l', '1') END AS handwriting FROM (SELECT DISTINCT field_id, value FROM form_fields WHERE value IS NOT NULL)",
    "json_in_text": "SELECT record_id, coalesce(json_valid(payload) AND payload LIKE '{%', false) AS found FROM (SELECT DISTINCT record_id, payload FROM extraction_records)",
    "json_clean_text": f"""WITH {PAGES}, q AS (SELECT ocr_id, text, {_QUOTES} AS t FROM p)
SELECT ocr_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: {_collapse('y')}), lambda y: y <> ''), chr(10))), lambda x: x <> ''), chr(10) || chr(10))) AS kept,
 md5({_collapse('t')}) AS line, md5({_collapse("translate(replace(replace(text, '–', '-'), '—', '--'), '‘’“”" + chr(0xA0) + "', '''''" + chr(34) * 2 + " ')")}) AS plain FROM q""",
    "kv_split": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN contains(t, ':') THEN instr(t, ':') ELSE instr(t, '=') END AS i FROM l WHERE contains(t, ':') OR contains(t, '='))
SELECT doc_id, line, {_strip('left(t, i - 1)')} AS key, {_strip('substring(t, i + 1)')} AS value, CASE WHEN contains(t, ':') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM k""",
    "tokens_and_sentences": _doc(f"doc_id, {TOKENS} AS n_tokens, len(string_split(text, '.')) AS n_sentences, regexp_matches(lower(text), 'check|select|choose|click') AS form_word"),
    "format_text_content": f"WITH {PAGES} SELECT ocr_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM p WHERE text IS NOT NULL",
    "flesch_by_source": f"WITH f AS ({_doc(f'source, round({_FLESCH}, 6) AS f')}) SELECT source, count(*) AS n, round(avg(f), 4) AS flesch, round(max(f), 4) AS best, round(min(f), 4) AS worst FROM f GROUP BY source",
    "quality_scores": f"WITH c AS ({_doc(f'doc_id, {_COH} AS c, {_ART} AS a, {_DENS} AS d, {_FLESCH} AS f')}) SELECT doc_id, round(c, 6) AS coherence, round(a, 6) AS artifacts, round(d, 6) AS density, round(0.3::DOUBLE * least(f / 100, 1.0::DOUBLE) + 0.3::DOUBLE * c + 0.2::DOUBLE * (1 - a) + 0.2::DOUBLE * least(d, 1.0::DOUBLE), 6) AS score FROM c",
    "character_distribution": _doc(f"doc_id, round({ALPHA}, 6) AS alphabetic, round({_ratio(_chars('text', r'\p{Nd}'), 'length(text)')}, 6) AS numeric, round({_ratio(_chars('text', '[.,!?;:]'), 'length(text)')}, 6) AS punctuation, round({SPACE}, 6) AS whitespace"),
    "confidence_stats": f"""WITH {PAGES}, a AS (SELECT engine, level, coalesce(avg(c), 0.5) AS m, coalesce(var_pop(c), 0) AS v, coalesce(min(c), 0) AS lo, coalesce(max(c), 0) AS hi, count(c) AS n FROM (SELECT *, round({_CONF}, 4) AS c FROM p) GROUP BY 1, 2)
SELECT engine, level, round(m, 6) AS average, round(v, 6) AS variance, round(lo, 6) AS minimum, round(hi, 6) AS maximum, CASE WHEN n = 0 THEN 'unknown' WHEN m > 0.8 AND v < 0.05 THEN 'high_consistent' WHEN m > 0.6 AND v < 0.1 THEN 'good_consistent' WHEN v > 0.2 THEN 'highly_variable' WHEN m < 0.4 THEN 'low_confidence' ELSE 'moderate' END AS distribution FROM a""",
    "extraction_quality": f"""WITH {PAGES}, {_E} SELECT document_id, round(structure, 6) AS structure, round(coverage, 6) AS coverage, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(overall, 6) AS overall,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN structure < 0.5 THEN 'Consider using Table Transformer for better structure extraction' END, CASE WHEN conf < 0.6 THEN 'Low confidence scores - consider manual review of results' END, CASE WHEN overall < 0.4 THEN 'Overall quality is low - consider using advanced extraction features' WHEN overall > 0.8 THEN 'High quality extraction - results are reliable' END], lambda x: x IS NOT NULL), ','), ''), 'Extraction quality appears acceptable') AS advice FROM v""",
    "image_scores": f"""WITH s AS (SELECT p_partkey, p_partkey % 700 AS lap, p_partkey % 90 AS dev, p_partkey % 40 AS noise, p_partkey % 2300 + 50 AS side FROM part), q AS (SELECT *, {_ISCORE} AS s FROM s)
SELECT p_partkey, round(s, 9) AS score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS level, CASE WHEN s >= 0.7 THEN 'fast' WHEN s >= 0.4 THEN 'enhanced' ELSE 'vlm' END AS pipeline,
 round(({_U('1 - abs(dev * 2 - 128) / 128.0')} + {_U('dev / 64.0')} + {_U('lap / 1000.0')} + {_U('1 - noise / 50.0')}) / 4, 9) AS brightness_score FROM q""",
    "model_confidences": f"""WITH {PAGES}, t AS (SELECT ocr_id, text || (['', ' |||', ' [unclear] ', ' it appears to be a table with a header and a footer', ' ___ ....'])[ocr_id % 5 + 1] AS text FROM p WHERE text IS NOT NULL)
SELECT ocr_id, round({_TRANS}, 6) AS transcript, round({_VIS}, 6) AS vision, round(CASE WHEN length(trim(text)) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, {_ANS}) END, 6) AS answer FROM t""",
    "language_detect": f"WITH s AS (SELECT doc_id, text, CASE WHEN NOT {_BLANK} THEN {_case_lang()} END AS b FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, {_LANG} AS r FROM s) SELECT doc_id, r.language AS language, round(r.confidence, 6) AS confidence FROM r",
    "language_confusion": f"WITH {PAGES}, s AS (SELECT document_id, text, CASE WHEN NOT {_BLANK} THEN {_case_lang()} END AS b FROM p), r AS (SELECT document_id, ({_LANG}).language AS language FROM s) SELECT label, language, count(*) AS n FROM r JOIN (SELECT DISTINCT document_id, language AS label FROM doc_profiles) USING (document_id) GROUP BY 1, 2",
    "translate_identity": _doc("lang, count(*) AS n, sum(length(text))::BIGINT AS n_chars, 0.0::DOUBLE AS confidence", "GROUP BY lang"),
    "classify_documents": f"""WITH {_BUSINESS}, c AS (SELECT *, {_decide_sql()} AS x, {_count_sql()} AS n_signals FROM b), d AS (SELECT *, CASE WHEN x.score > 0 THEN x.name ELSE 'unknown' END AS document_type, CASE WHEN x.score > 0 THEN least(x.score / 3, 1.0::DOUBLE) ELSE 0.0 END AS sure FROM c)
SELECT o_orderkey, document_type, round(sure, 6) AS confidence, CASE WHEN document_type IN ('tax_form_1040', 'tax_form_w2') THEN nullif(regexp_extract(text, '([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})', 1), '') END AS ssn,
 CASE WHEN document_type IN ('bank_statement', 'credit_card_statement') THEN nullif(regexp_extract(lower(text), 'account\\s+(?:number|#)?\\s*:?\\s*([0-9]+)', 1), '') END AS account_number,
 CASE WHEN document_type = 'invoice' THEN nullif(regexp_extract(lower(text), 'invoice\\s+(?:number|#)?\\s*:?\\s*([A-Za-z0-9-]+)', 1), '') END AS invoice_number,
 array_to_string(list_concat(CASE WHEN sure < 0.5 THEN ['Low confidence classification - manual review recommended'] ELSE [] END, CASE document_type WHEN 'tax_form_1040' THEN ['Consider extracting tax fields: income, deductions, tax liability', 'Validate SSN and EIN formats']
 WHEN 'bank_statement' THEN ['Extract transaction history and account balances', 'Validate account numbers and amounts'] WHEN 'credit_card_statement' THEN ['Extract transaction history and account balances', 'Validate account numbers and amounts']
 WHEN 'invoice' THEN ['Extract invoice details: number, date, amounts, line items', 'Validate payment terms and due dates'] WHEN 'legal_contract' THEN ['Extract parties, terms, and signature information', 'Identify key clauses and obligations'] ELSE [] END,
 CASE WHEN n_signals < 3 THEN ['Limited classification signals - consider additional analysis'] ELSE [] END), '|') AS suggestions FROM d""".replace(chr(92) * 2, chr(92)),
    "classify_signals": f"WITH {_BUSINESS} SELECT o_orderkey, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in {**_pattern_sql(), **{k: v for k, v in _other_sql().items() if k.split('_')[-1] in ('keywords', 'content', 'title') or k.startswith('has_c')}}.items()) + " FROM b",
    "simple_document_type": _doc("doc_id, CASE WHEN regexp_matches(lower(text), 'invoice|bill') THEN 'invoice' WHEN regexp_matches(lower(text), 'agreement|contract') THEN 'contract' WHEN regexp_matches(lower(text), 'resume|cv') THEN 'resume' WHEN contains(lower(text), 'report') THEN 'report' WHEN contains(lower(text), 'form') THEN 'form' ELSE 'generic' END AS document_type, CASE WHEN regexp_matches(lower(text), 'invoice|bill') THEN 0.8 WHEN regexp_matches(lower(text), 'agreement|contract') THEN 0.7 WHEN regexp_matches(lower(text), 'resume|cv') THEN 0.8 WHEN contains(lower(text), 'report') THEN 0.6 WHEN contains(lower(text), 'form') THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence"),
    "block_types": "SELECT document_id, id, CASE WHEN element_type = 'heading' AND 20 - 2 * level > 14 THEN 'heading' WHEN regexp_matches(lower(text), 'total|sum|amount|[$€£]') THEN 'financial' WHEN regexp_matches(lower(text), 'date|time|schedule') THEN 'temporal' WHEN length(text) < 5 AND regexp_matches(text, '^[0-9]+$') THEN 'numeric' ELSE 'body_text' END AS block_type FROM (SELECT DISTINCT document_id, id, text, element_type, level FROM elements)",
}
