"""Layout, sheets, sources, documents and streaming on small literal cases."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.operators import dialect, documents, layout, planning, ranking, segments, sheets, structure, tables
from papyra.sources import files, xlsx
from papyra.streaming import ingest


def test_heading_parents_match_a_stack(spark):
    rng = random.Random(2)
    rows = [(d, i, "t", rng.choice([1, 1, 2, 3]), 0.0, i / 1000.0, 1.0, 1.0, rng.choice([20, 17, 15, 13, 10, 10]), rng.random() < 0.6) for d in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, block_ord int, text string, page int, x1 double, y1 double, x2 double, y2 double, font_size int, is_bold boolean")
    got = {(r.doc_id, r.element_id): r for r in structure.heading_parents(structure.elements(df)).collect()}
    for d in range(12):
        stack = []
        for r in sorted((r for (e, _), r in got.items() if e == d), key=lambda r: (r.page, r.y1, r.block_ord)):
            if r.element_type == "heading":
                above = [s for s in stack if s[0] < r.level]
                assert r.parent_element == (above[-1][1] if above else None)
                stack.append((r.level, r.element_id))
            else:
                assert r.parent_element == (stack[-1][1] if stack else None)


def test_columns_and_order(spark):
    rows = [("d", f"l{i}", i, 1, 0.05, i / 10, 0.40, i / 10 + 0.05) for i in range(5)] + [("d", f"r{i}", 10 + i, 1, 0.60, i / 10, 0.95, i / 10 + 0.05) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, elem_id string, ord int, page int, x1 double, y1 double, x2 double, y2 double")
    assert {r.elem_id[0]: r.column for r in layout.columns(df).collect()} in ({"l": 0, "r": 1}, {"l": 0, "r": 0})
    order = [r.elem_id for r in layout.reading_order(df).orderBy("position").collect()]
    assert len(order) == 10 and order[0] == "l0"


def test_chunks(spark):
    rng = random.Random(5)
    values = ["", "short"] + ["".join(rng.choice("ab. \n") for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    for size, overlap in ((40, 5), (60, 0)):
        flat = segments.chunks(df, "k", "t", size, overlap).orderBy("k", "chunk_index").collect()
        folded = df.select("k", F.explode(segments.chunk_array(F.col("t"), size, overlap)).alias("c")).select("k", "c.start", "c.text").collect()
        assert sorted((r.k, r.start, r.text) for r in flat) == sorted((r.k, r.start, r.text) for r in folded)
        for k, v in enumerate(values):
            own = [r for r in flat if r.k == k]
            assert "".join(v[r.start : r.start + len(r.text)] for r in own[:0]) == "" and all(v[r.start : r.start + len(r.text)] == r.text and len(r.text) <= size for r in own)
            at = 0
            for r in own:
                assert r.start <= at
                at = r.start + len(r.text)
            assert at == len(v)
    with pytest.raises(ValueError):
        segments.chunks(df, "k", "t", 10, 10)


def test_sheet_pipeline(spark):
    df = spark.createDataFrame([(1, "a", "1.5", None, "x"), (2, None, None, None, None), (3, "b|c", "bad", None, "y")], "_row int, `My Name` string, Amount string, Nothing string, `Unnamed: 3` string")
    o = sheets.SheetOptions(rename={"My Name": "name"}, cast={"Amount": "double"})
    out = sheets.clean(df, o)
    assert sheets.data_columns(out) == ["name", "Amount"] and out.count() == 2
    md = [r.value for r in sheets.markdown_rows(out).orderBy("ord").collect()]
    assert md == ["| name | Amount |", "| --- | --- |", "| a | 1.5 |", "| b\\|c |  |"]
    assert "*No data in this sheet*" in sheets.document("f.xlsx", {"s": out.limit(0)}, "markdown")
    assert sheets.sheet_query(out, "SELECT nope FROM {sheet}", "passthrough").count() == 2
    with pytest.raises(Exception):
        sheets.sheet_query(out, "SELECT nope FROM {sheet}")
    assert sheets.query({"My Sheet-1": df}, 'SELECT count("My Name") AS n FROM My_Sheet_1').head().n == 2


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sales" r:id="r1"/><sheet name="Other One" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><r><t>Prod</t></r><r><t>uct</t></r></si><si><t>Laptop</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Ok</t></is></c></row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="A4" s="2"><v>45292.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    _workbook(path)
    got = sheets.load(spark, path)
    rows = got["Sales"].orderBy("_row").collect()
    assert got["Sales"].columns == ["_sheet", "_row", "Date", "Product", "Unnamed: 2", "Ok"]
    assert [tuple(r)[1:] for r in rows] == [(2, "2024-01-01", "Laptop", "1.5", "true"), (4, "2024-01-01T12:00:00", None, None, None)]
    assert sheets.load(spark, path, ["No such"]) == {} and got["Other One"].count() == 0
    assert spark.read.format("papyra_xlsx").option("path", path).load().filter("_sheet = 'Sales'").count() == 2
    with pytest.raises(ValueError):
        xlsx.Workbook("x.xls")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(bytes(range(256)) * 20)
    (tmp_path / "in/b.bin").write_bytes(b"bad")
    blocks = files.byte_blocks(spark, str(tmp_path / "in"), 1000).collect()
    a = b"".join(bytes(r.content) for r in sorted(blocks, key=lambda r: r.block) if r.path.endswith("a.bin"))
    assert a == bytes(range(256)) * 20
    calls = spark.read.format("binaryFile").load(str(tmp_path / "in"))

    def picky(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return 1, "ok"

    got = {r.status: r for r in files.extract(calls, picky).collect()}
    assert got["error"].attempts == 3 and "unreadable" in got["error"].error and got["success"].text == "ok"
    p = files.progress(files.extract(calls, picky)).head()
    assert (p.total, p.completed, p.failed, p.percent, p.is_complete) == (2, 1, 1, 100.0, True)
    (tmp_path / "c.csv").write_text('a,"x,\ny",\n,z\n')
    assert {(r.row, r.col, r.text) for r in files.read_csv_cells(spark, str(tmp_path / "c.csv")).collect()} == {(0, 0, "a"), (0, 1, "x,\ny"), (1, 1, "z")}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    files.write_tables({"t": df}, str(tmp_path / "out"))
    files.write_tables({"t": spark.createDataFrame([(2, "c")], "doc_id int, v string")}, str(tmp_path / "out"), mode="upsert")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/t")).collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        files.write_result(df, str(tmp_path / "z"), "full")


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"a": {"x": 1}, "b": 2}')
    monkeypatch.setenv("PAPYRA_A__Y", "9")
    got = files.load_config({"a": {"x": 0, "y": 0}, "b": 0, "c": 0}, str(tmp_path / "c.json"), args={"c": 5})
    assert got == {"a": {"x": 1, "y": "9"}, "b": 2, "c": 5}


def test_dialect():
    assert dialect.translate("SELECT 'a//b', [1] FROM t") == "SELECT 'a//b', array(1) FROM t"
    assert "date_format(x, 'yyyy-MM-dd')" in dialect.translate("SELECT strftime(x, '%Y-%m-%d') FROM t")


def test_row_numbers(spark):
    df = spark.range(5000).withColumn("v", F.xxhash64("id"))
    got = ranking.row_numbers(df, ["v"]).collect()
    assert [r.row_number for r in sorted(got, key=lambda r: r.v)] == list(range(1, 5001))


def test_grids(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, "h,1"), (1, 0, 1, 1, "h|2"), (1, 1, 1, 1, "old"), (1, 1, 1, 2, 'n"w')], "t int, row int, col int, ord int, text string")
    g = tables.as_grid(cells, ["t"])
    r = g.select(tables.grid_csv(F.col("grid")).alias("c"), tables.grid_markdown(F.col("grid")).alias("m"), tables.grid_records(F.col("grid")).alias("j")).head()
    assert r.c == '"h,1",h|2\n,"n""w"' and r.m.split("\n")[1] == "| --- | --- |" and r.j == [{"h,1": "", "h|2": 'n"w'}]


def test_documents(spark):
    schema = "doc_id int, file_name string, text string, images array<string>, tables array<struct<columns:array<string>,data:array<array<string>>,confidence:double>>, forms array<struct<type:string,text:string,page:int,bbox:array<double>>>, handwritten array<string>"
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "f", " a \n\n b", ["i"], [(["x"], [["1", "2"], []], 0.5), (["e"], [], 0.1)], [("text", "v", 1, [0.0, 1.0, 2.0, 3.456])], [])], schema)
    got = {r.doc_id: r.markdown for r in documents.markdown(df).collect()}
    assert got[1] == "# Document" and "a\n\nb" in got[2] and "| 1 |\n|  |" in got[2] and "*Empty table*" in got[2] and "3.46" in got[2]
    assert documents.embedding_view(df).count() == 2 and documents.summary(df).filter("doc_id = 1").head().n_tables == 0


def test_predict_and_evict(spark):
    e = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0)], "k string, s double").withColumn("at", F.timestamp_seconds("s"))
    got = {r.k: round(r.probability, 3) for r in planning.predict_hits(e, "k", "at", F.timestamp_seconds(F.lit(15))).collect()}
    assert got == {"a": 0.5, "b": 0.0}
    c = spark.createDataFrame([("x", 3.0, 50.0), ("y", 2.0, 60.0), ("z", 1.0, 10.0)], "file_hash string, score double, size_mb double")
    assert {r.file_hash: r.evicted for r in planning.evictions(c, 100.0).collect()} == {"x": False, "y": True, "z": True}
    assert planning.evictions(c.limit(0), 1.0).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(i, i * 600, "a" if i % 2 else "b") for i in range(30)], "id int, s long, kind string").select("id", F.timestamp_seconds("s").alias("ts"), "kind").write.parquet(src)
    s = ingest.stream_parquet(spark, src, "id int, ts timestamp, kind string")
    ingest.run_available(ingest.windowed_counts(s, "ts", "kind", delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    static = {tuple(r) for r in ingest.windowed_counts(spark.read.parquet(src), "ts", "kind").collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= static


def test_aligned_clusters_of_all_orders(spark, tmp_path):
    from papyra.plans import layout_queries

    rows = [(k, n, n + 3 * c, 1, 5.0) for k in (1, 2, 5) for n in range(1, 6) for c in range(3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.doc_id for r in layout_queries.aligned_clusters(spark, str(tmp_path)).collect()} == {1, 2, 5}
