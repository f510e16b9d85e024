"""Sheets: cleaning pipeline, SQL over named sheets, rendering.

Steps run in this order: rows without any value are dropped, columns without any value, columns named ``Unnamed: n``, then the
first ``max_rows`` by the row number, then columns are renamed and cast, then SQL runs. A sheet is a DataFrame; a column
``_row`` (from the reader, or given) holds its order, as rows of a DataFrame have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.operators.dialect import translate

HIDDEN = ("_sheet", "_row")


@dataclass
class SheetOptions:
    drop_empty_rows: bool = True
    drop_empty_columns: bool = True
    drop_unnamed: bool = True
    max_rows: int | None = None
    rename: dict[str, str] = field(default_factory=dict)
    cast: dict[str, str] = field(default_factory=dict)
    sql: str | None = None
    on_error: str = "raise"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def clean(df: DataFrame, o: SheetOptions) -> DataFrame:
    """The steps before SQL. Dropping columns depends on the rows and takes one aggregate over all columns when it is called."""
    names = data_columns(df)
    if o.drop_empty_rows and names:
        df = df.dropna(how="all", subset=names)
    if o.drop_unnamed:
        df = df.drop(*[_q(c) for c in names if c.startswith("Unnamed:")])
        names = data_columns(df)
    if o.drop_empty_columns and names:
        counts = df.agg(*[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(names)]).head()
        df = df.drop(*[_q(c) for c, n in zip(names, counts) if not n])
    if o.max_rows is not None:
        df = df.orderBy("_row").limit(o.max_rows) if "_row" in df.columns else df.limit(o.max_rows)
    df = df.withColumnsRenamed(o.rename)
    for name, kind in o.cast.items():
        df = df.withColumn(name, _q(name).try_cast(kind))
    return df


def view_name(sheet: str) -> str:
    return sheet.replace(" ", "_").replace("-", "_")


def query(sheets: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over all sheets by name, blanks and hyphens as underscores; sheets without columns are not there. Errors are raised.

    The views belong to this call: the plan is resolved, then they are dropped.
    """
    spark = next(iter(sheets.values())).sparkSession
    named = {view_name(n): df for n, df in sheets.items() if data_columns(df)}
    for n, df in named.items():
        df.createOrReplaceTempView(n)
    try:
        out = spark.sql(translate(sql))
        out.schema  # noqa: B018  resolves the names while the views are there
        return out
    finally:
        for n in named:
            spark.catalog.dropTempView(n)


def sheet_query(df: DataFrame, sql: str, on_error: str = "raise") -> DataFrame:
    """SQL over one sheet, written ``{sheet}``; with ``on_error`` passthrough a failing query leaves the rows as they are."""
    try:
        return query({"sheet_data": df}, sql.replace("{sheet}", "sheet_data"))
    except Exception:
        if on_error == "passthrough":
            return df
        raise


def process(sheets: dict[str, DataFrame], o: SheetOptions) -> dict[str, DataFrame]:
    out = {}
    for name, df in sheets.items():
        df = clean(df, o)
        out[name] = sheet_query(df, o.sql, o.on_error) if o.sql and data_columns(df) else df
    return out


def info(df: DataFrame) -> dict:
    names = data_columns(df)
    return {"row_count": df.count(), "columns": names, "column_count": len(names)}


def load(spark: SparkSession, path: str, sheets: list[str] | None = None, header: bool = True) -> dict[str, DataFrame]:
    """The sheets of a workbook by name; unknown names are left out, as is a sheet that cannot be read."""
    from papyra.sources import xlsx

    xlsx.register(spark)
    known = xlsx.sheet_names(path)
    wanted = known if sheets is None else [s for s in sheets if s in known]
    return {s: spark.read.format("papyra_xlsx").option("path", path).option("sheet", s).option("header", str(header).lower()).load() for s in wanted}


def _value(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    v = _q(c)
    if kind in ("double", "float"):
        return F.when(~F.isnan(v), v)
    if kind.startswith("timestamp"):
        return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "date":
        return F.date_format(v, "yyyy-MM-dd")
    return v


def _ordered(df: DataFrame, order: str) -> DataFrame:
    return df.select(order, *data_columns(df)) if order in df.columns else df


def json_rows(df: DataFrame) -> DataFrame:
    """(value): one JSON object a row, NaN as null, times in ISO form. A sink for sheets of any size."""
    return df.select(F.to_json(F.struct(*[_value(df, c).alias(c) for c in data_columns(df)]), {"ignoreNullFields": "false"}).alias("value"))


def markdown_rows(df: DataFrame, order: str = "_row") -> DataFrame:
    """(ord, value): the lines of a Markdown table; nulls empty, bars escaped. Line 0 is the header, 1 the rule."""
    spark = df.sparkSession
    names = data_columns(df)
    cell = lambda c: F.replace(F.coalesce(_value(df, c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |"))
    body = df.select((F.col(order) + 1).cast("long").alias("ord"), line.alias("value"))
    head = spark.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "| " + " | ".join("---" for _ in names) + " |")], "ord long, value string")
    return head.unionByName(body)


def document_parts(file_name: str, sheets: dict[str, DataFrame], kind: str = "json", order: str = "_row") -> Iterator[str]:
    """All sheets as one JSON or Markdown text, piece by piece: rows come to the driver one partition at a time."""
    import json
    import textwrap

    if kind == "json":
        yield f'{{\n  "filename": {json.dumps(file_name, ensure_ascii=False)},\n  "sheet_count": {len(sheets)},\n  "sheets": {{'
        for i, (name, df) in enumerate(sheets.items()):
            rows = json_rows(df.orderBy(order) if order in df.columns else df)
            columns = textwrap.indent(json.dumps(data_columns(df), indent=2, ensure_ascii=False), "      ").lstrip()
            yield f'{"," if i else ""}\n    {json.dumps(name, ensure_ascii=False)}: {{\n      "row_count": {df.count()},\n      "columns": {columns},\n      "data": ['
            empty = True
            for r in rows.toLocalIterator():
                one = textwrap.indent(json.dumps(json.loads(r["value"]), indent=2, ensure_ascii=False), "        ")
                yield ("" if empty else ",") + "\n" + one
                empty = False
            yield ("" if empty else "\n      ") + "]\n    }"
        yield ("\n  " if sheets else "") + "}\n}"
        return
    yield f"# {file_name}\n\n"
    for i, (name, df) in enumerate(sheets.items()):
        yield ("\n\n" if i else "") + f"## {name}\n\n"
        if order not in df.columns or not df.head(1):
            yield "*No data in this sheet*"
            continue
        for j, r in enumerate(markdown_rows(df, order).orderBy("ord").toLocalIterator()):
            yield ("\n" if j else "") + r["value"]
    yield "\n"


def document(file_name: str, sheets: dict[str, DataFrame], kind: str = "json", order: str = "_row") -> str:
    """The text of ``document_parts`` as one value, for sheets that fit a document; ``write_document`` takes any size."""
    return "".join(document_parts(file_name, sheets, kind, order))


def write_document(path: str, file_name: str, sheets: dict[str, DataFrame], kind: str = "json", order: str = "_row") -> None:
    """The same to a file, as a stream."""
    with open(path, "w", encoding="utf-8") as f:
        for part in document_parts(file_name, sheets, kind, order):
            f.write(part)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time (null if there is none).

    Both sides are merged by key and time and the last right row is carried forward, so no pair of rows is formed. A hot key is
    cut into ranges of time: rows are carried within a range, and the last right row of each earlier range is carried over.
    """
    item = F.struct(F.col(right_time).alias("_rt"), *columns)
    span = 86_400 * 7
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span)
    lids = [F.col(c) for c in left.columns]
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lids).alias("_l"), F.lit(None).cast(right.select(item.alias("x")).schema[0].dataType).alias("_r"), bucket(left_time).alias("_b"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*lids).alias("x")).schema[0].dataType).alias("_l"), item.alias("_r"), bucket(right_time).alias("_b"))
    keys = [f"_k{i}" for i in range(len(on))]
    both = a.unionByName(b)
    within = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_last", F.last("_r", ignorenulls=True).over(within)).filter("_side = 1")
    ends = b.groupBy(*keys, "_b").agg(F.max_by("_r", "_t").alias("_e"))
    spans = got.select(*keys, "_b").distinct().unionByName(ends.select(*keys, "_b")).distinct().join(ends, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_b", F.last("_e", ignorenulls=True).over(before).alias("_c"))
    out = got.join(carried, [*keys, "_b"], "left").withColumn("_m", F.coalesce("_last", "_c"))
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_m.{c}").alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows whose ``point`` lies in [low, high) of a right row, by buckets of ``width``: an equi-join with a residual.

    Intervals are listed in every bucket they touch, so ``width`` should be near their usual length.
    """
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    a = left.withColumn("_a", F.floor(F.col(point) / width))
    return a.join(b, F.col("_a") == F.col("_b")).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_a", "_b")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their rank in the given orders; the longer side goes on with nulls."""
    from papyra.operators.ranking import row_numbers

    a, b = row_numbers(left, left_order, "_n"), row_numbers(right, right_order, "_m")
    return a.join(b, F.col("_n") == F.col("_m"), "full").drop("_n", "_m")
