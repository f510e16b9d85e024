"""Whole extractions, cache, features, dispatch, dialect and sinks on small cases and odd inputs."""

import json

import pytest
from pyspark.sql import functions as F

from papyra.functions import classify, features, language, quality
from papyra.operators import dialect, extraction, planning, sheets
from papyra.sources import files

TABLE = "struct<headers:array<string>,data:array<array<string>>,confidence:double,shape:struct<rows:int,cols:int>,bbox:array<double>>"
FORM = "struct<fields:map<string,string>,field_types:map<string,string>,confidence:double,bbox:array<double>>"
SCHEMA = f"doc_id int, text string, text_confidence double, tables array<{TABLE}>, forms array<{FORM}>, images array<string>, metadata map<string,string>, headings array<string>, layout string, regions array<string>"


def test_assessment_of_good_poor_and_empty_extractions(spark):
    good = (
        1, "This is a well written text with clear sentences. It has enough words to be read easily, and nothing in it looks broken.", 0.95,
        [(["a", "b"], [["1", "2"], ["3", "4"]], 0.9, (2, 2), None)], [({"name": "Ada", "city": None}, {"name": "text"}, 0.85, None)], None, {"title": "x"}, None, None, None,
    )
    poor = (2, "a|||b ___ c?? 1l1 ... x y z ||| ___", 0.3, [], [], None, {}, None, None, None)
    empty = (3, None, None, None, None, None, None, None, None, None)
    got = {r.doc_id: r for r in extraction.assess(spark.createDataFrame([good, poor, empty], SCHEMA)).collect()}
    assert got[1].overall > 0.5 and got[1].text_score > 0.5 and got[1].average > 0.7 and got[1].distribution == "high_consistent"
    assert got[2].overall < 0.7 and got[2].average < 0.5 and quality.ADVICE["artifacts"] in got[2].recommendations
    assert got[3].overall >= 0 and got[3].average == 0.5 and got[3].distribution == "unknown" and got[3].artifacts == 1.0 and got[3].consistency == 1.0
    text = spark.createDataFrame([good, empty], SCHEMA).select(extraction.all_text(F.col("text"), F.col("tables"), F.col("forms")).alias("t")).collect()
    assert text[0].t.endswith("broken. 1 2 3 4 Ada None") and text[1].t == ""
    assert extraction.assess(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_keys(spark):
    df = spark.createDataFrame([(1, [(["a"], None, 0.5, None, None), (["b"], None, None, None, [1.0])]), (2, [(["a"], None, None, None, None), (None, [["x"]], None, None, None)]), (3, [(["a"], None, None, None, None)])], f"k int, t array<{TABLE}>")
    assert {r.k: r.s for r in df.select("k", extraction.shared_keys(F.col("t"), extraction.TABLE_PARTS).alias("s")).collect()} == {1: ["headers"], 2: [], 3: None}


def test_blocks_are_combined(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0, [1]), (1, 2, "b", 2.0, [2, 3]), (1, 3, "a", 9.0, []), (2, 1, "z", None, None)], "g int, o int, k string, v double, items array<int>")
    assert {r.g: r.merged for r in extraction.combine_maps(df, ["g"], "o", "k", "v").collect()} == {1: {"a": 9.0, "b": 2.0}, 2: {"z": None}}
    assert {r.g: r.merged for r in extraction.combine_lists(df.filter("items is not null"), ["g"], "o", "items").collect()} == {1: [1, 2, 3]}


def test_clean_json_to_any_depth(spark):
    schema = "`a ` string, n int, x double, m map<string,struct<ok:boolean,note:string>>, l array<array<double>>"
    row = (" “q” – r — s’t ", 7, float("inf"), {" k ": (True, "  "), "": (False, "v")}, [[1.5, float("nan")], None])
    df = spark.createDataFrame([row, (None, None, None, None, None)], schema)
    got = [json.loads(r.j) for r in df.select(extraction.clean_json(df).alias("j")).collect()]
    assert got[0] == {"a": '"q" - r -- s\'t', "n": "7", "x": None, "m": {"k": {"ok": "True", "note": None}, "unknown_key": {"ok": "False", "note": "v"}}, "l": [[1.5, None], None]}
    assert got[1] == {"a": None, "n": None, "x": None, "m": None, "l": None}


def test_unified_markdown_of_bare_documents(spark):
    schema = "doc_id int, title string, author string, page_count int, created string, elements array<struct<type:string,level:int,text:string>>, pages array<struct<page_number:int,tables:array<string>,fields:array<struct<type:string,label:string,value:string,is_checked:boolean>>,handwritten:array<string>>>"
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "T", "A", 1, "2024", [], [(None, None, None, None)])], schema)
    got = {r.doc_id: r.markdown for r in extraction.unified_markdown(df).collect()}
    assert got[1] == "# Untitled Document\n\n## Document Information\n\n- **Author:** Unknown\n- **Pages:** 0\n"
    assert got[2].endswith("- **Created:** 2024\n\n## Document Structure\n\n\n## Page 0\n")


def test_mean_reading(spark):
    df = spark.createDataFrame([("a", 90.7), ("a", -1.0), ("a", 0.0), ("a", 70.0), ("b", -1.0), ("b", None)], "g string, c double")
    assert {r.g: r.m for r in df.groupBy("g").agg(extraction.mean_reading(F.col("c")).alias("m")).collect()} == {"a": 0.8, "b": 0.5}


def test_cache(spark):
    entries = "file_hash string, size_mb double, count long, priority double, last_access timestamp"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    memory, disk = spark.createDataFrame([("a", 1.0, 1, 1.0, None)], entries), spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "file_hash string, size_mb double")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "file_hash string").withColumn("at", now)
    found = planning.cache_get(asked, memory, disk)
    assert sorted(r.found for r in found.collect()) == ["disk", "disk", "memory", "miss"]
    after = planning.cache_after(memory, disk, asked, now)
    assert {r.file_hash: (r["count"], r.size_mb) for r in after.collect()} == {"a": (2, 1.0), "b": (2, 2.0)}
    put = planning.cache_put(after, spark.createDataFrame([("a", 9.0, 1, 3.0, None), ("big", 60.0, 1, 3.0, None), ("low", 30.0, 1, 1.0, None)], entries), 100.0)
    assert {r.file_hash: r.size_mb for r in put.collect()} == {"a": 9.0, "b": 2.0}
    warm = planning.cache_warm(put, disk, spark.createDataFrame([("c",), ("c",), ("nowhere",)], "file_hash string"), now)
    assert {r.file_hash for r in warm.collect()} == {"a", "b", "c"}
    s = planning.cache_stats(after, asked, 6.0, found).head()
    assert (s.memory_entries, s.total_accesses, s.memory_utilization, s.tracked_patterns, s.hits, s.misses, s.hit_rate) == (2, 4, 0.5, 3, 3, 1, 0.75)
    none = planning.cache_stats(memory.limit(0), asked.limit(0), 6.0, found.limit(0)).head()
    assert (none.memory_entries, none.avg_accesses_per_entry, none.hit_rate) == (0, 0.0, 0.0)


def test_features_and_presets(tmp_path):
    f = features.Features(lambda p: p in ("scikit-learn", "scipy", "aiofiles", "asyncio"))
    assert f.preset("quality") and f.on == {"quality_assessment"} and not f.preset("nothing") and not f.enable("trocr") and f.missing("trocr") == ["torch", "transformers", "torchvision"]
    assert f.enable("trocr", check=False) and f.disable("quality_assessment") and not f.disable("unheard of")
    f.save(str(tmp_path / "f.json"))
    g = features.Features(lambda p: False)
    g.load(str(tmp_path / "f.json"))
    assert g.on == {"trocr"} and g.available() == [] and set(f.available()) == {"quality_assessment", "async_processing"}


def test_language_dispatch(spark):
    df = spark.createDataFrame([("Это предложение",), (" ",), (None,)], "t string")
    fails = {"bad": lambda c: F.lit(None).cast("struct<language:string,confidence:double>")}
    auto, bad, gone = (df.select(language.dispatch(F.col("t"), m, d).alias("x")).select("x.*").collect() for m, d in (("auto", None), ("auto", fails), ("polyglot", fails)))
    assert [r.language for r in auto] == ["ru", "unknown", "unknown"] and auto[0].method == "heuristic" and auto[1].error == "Empty text"
    assert bad[0].error == "detection failed" and gone[0].error == "Method 'polyglot' not available" and gone[0].confidence == 0
    assert len(language.supported(True, True, True)["translation"]) == 39 and language.supported() == {"detection": [], "processing": [], "translation": []}


def test_word_lists_of_classes(spark):
    df = spark.createDataFrame([("financial legal medical",), ("tax contract patient",)], "t string")
    got = df.select(*[v.alias(k) for k, v in classify.keyword_signals(F.col("t")).items()]).collect()
    assert tuple(got[0]) == (None, None, 1 / 30) and tuple(got[1]) == (0.01, 0.02, 1 / 30)
    for patterns in classify.PATTERNS.values():
        for p in patterns:
            word = classify.longest_word(p)
            assert word in p.replace("?", "")


def test_dialect_places_slices_and_literals(spark):
    q = lambda e: spark.sql(dialect.translate(f"SELECT {e} AS x")).head().x
    assert q("[10, 20, 30][1]") == 10 and q("[10, 20, 30][-1]") == 30 and q("[10][5]") is None and q("[10][0]") is None
    assert q("string_split('a-b', '-')[2]") == "b" and q("[1, 2, 3, 4][2:3]") == [2, 3] and q("[1, 2, 3][2:]") == [2, 3] and q("[1, 2, 3][:2]") == [1, 2]
    assert q("{'a': 1, 'b': [7, 8]}['b'][2]") == 8 and q("[[1], [2, 3]][2][1]") == 2 and q("'[1]'") == "[1]"
    t = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "k int, v int")
    got = sheets.query({"t": t}, "SELECT k, v FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1 AND count(*) OVER (PARTITION BY k) > 1")
    assert [tuple(r) for r in got.collect()] == [(1, 9)]
    assert {tuple(r) for r in sheets.query({"t": t}, "SELECT * REPLACE (v * 2 AS v) FROM t").select("k", "v").collect()} == {(1, 10), (1, 18), (2, 6)}


def test_tables_are_replaced_by_document(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "doc_id int, w string")
    files.write_tables({"a": a, "b": b}, folder, mode="upsert")
    files.write_tables({"a": a.filter("doc_id = 1").withColumn("v", F.lit("new")), "b": b.limit(0)}, folder, mode="upsert")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/a").collect()} == {(1, "new"), (2, "b")}
    # a document without rows in a table any more loses those it had
    assert spark.read.parquet(f"{folder}/b").count() == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]


def test_sqlite_both_ways(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    df = spark.createDataFrame([(i, f"t{i}" if i % 2 else None, i / 2) for i in range(50)], "doc_id long, v string, x double")
    files.write_sqlite({"documents": df}, path)
    files.write_sqlite({"documents": df.filter("doc_id < 3").withColumn("v", F.lit("again"))}, path)
    got = {r.doc_id: (r.v, r.x) for r in files.read_sqlite(spark, path, "documents", block_rows=7).collect()}
    assert len(got) == 50 and got[1] == ("again", 0.5) and got[10] == (None, 5.0)
    files.write_sqlite({"none": df.limit(0)}, path)
    assert files.read_sqlite(spark, path, "none").count() == 0
    with pytest.raises(ValueError):
        files.read_sqlite(spark, path, "absent")


def test_csv_by_splits(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n\nx,\"y,z\"\n" + "".join(f"{i},\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r.row, r.col): r.text for r in files.read_csv_cells(spark, str(tmp_path), multi_line=False).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0, 0] == "a" and got[2, 1] == "y,z" and all(got[i + 3, 0] == str(i) for i in range(3000)) and len(got) == 3004


def test_json_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "doc_id long, l array<string>")
    files.write_result(df, str(tmp_path / "j"), "json")
    assert {r.doc_id: r.l for r in extraction.read_json(spark, str(tmp_path / "j"), "doc_id long, l array<string>").collect()} == {1: ["a"], 2: None}
    (tmp_path / "one.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert {r.a for r in extraction.read_json(spark, str(tmp_path / "one.json")).collect()} == {1, 2}


def test_sheet_documents_as_streams(spark, tmp_path):
    df = spark.createDataFrame([(2, "x|y", 1.5), (1, None, float("nan"))], "_row int, `Na me` string, v double")
    sheets.write_document(str(tmp_path / "d.json"), "f.xlsx", {"S": df, "E": df.limit(0)})
    got = json.loads((tmp_path / "d.json").read_text())
    assert got == {"filename": "f.xlsx", "sheet_count": 2, "sheets": {"S": {"row_count": 2, "columns": ["Na me", "v"], "data": [{"Na me": None, "v": None}, {"Na me": "x|y", "v": 1.5}]}, "E": {"row_count": 0, "columns": ["Na me", "v"], "data": []}}}
    assert sheets.document("f.xlsx", {"S": df}, "markdown") == "# f.xlsx\n\n## S\n\n| Na me | v |\n| --- | --- |\n|  |  |\n| x\\|y | 1.5 |\n"
    assert json.loads(sheets.document("f", {})) == {"filename": "f", "sheet_count": 0, "sheets": {}}


def test_models_and_prompts(spark):
    df = spark.createDataFrame([("tax_documents", ["anthropic"]), ("poems", ["openai"]), ("legal_contracts", ["google"]), (None, [])], "k string, p array<string>")
    got = [r.m for r in df.select(planning.choose_model(F.col("k"), F.col("p"), F.lit("none")).alias("m")).collect()]
    assert got == ["claude-3-5-sonnet", "gpt-4o-mini", "none", "none"]
    assert [r.p for r in df.limit(1).select(planning.prompt(F.lit("unheard of")).alias("p")).collect()] == [planning.PROMPTS["general"]]
