"""Other sources and sinks: raw bytes in blocks, opaque extractors behind a seam, result tables, CSV, JSON and parquet."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTRACTED = "path string, sha256 string, size long, status string, attempts int, error string, page_count int, text string"


def validate(path: str, extensions: list[str] | None = None) -> Path:
    """The path if it is a file with one of the extensions (case does not matter); otherwise a clear error."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if not p.is_file():
        raise ValueError(f"{path} is no file")
    if extensions and p.suffix.lower() not in {e.lower() for e in extensions}:
        raise ValueError(f"{path} does not end in {', '.join(extensions)}")
    return p


def load_config(defaults: dict, path: str | None = None, prefix: str = "PAPYRA_", args: dict | None = None) -> dict:
    """Settings: defaults, then the JSON file, then the environment, then arguments; dictionaries are merged in depth."""
    import json

    def merge(a: dict, b: dict) -> dict:
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    out = merge({}, defaults)
    if path:
        out = merge(out, json.loads(Path(path).read_text()))
    for name, value in os.environ.items():
        if name.startswith(prefix):
            at = out
            *heads, last = name[len(prefix) :].lower().split("__")
            for h in heads:
                at = at.setdefault(h, {})
            at[last] = value
    return merge(out, args or {})


def read_env(path: str) -> dict[str, str]:
    """Assignments of an environment file that are not set yet."""
    out = {}
    for line in Path(path).read_text().splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name and not name.startswith("#") and name not in os.environ:
            out[name] = value.strip().strip("\"'")
    return out


def file_system(path: str) -> tuple[Any, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_size(path: str) -> int:
    files, at = file_system(path)
    return files.get_file_info(at).size


def read_range(path: str, offset: int, length: int) -> bytes:
    """So many bytes of a file from an offset on, fewer at its end; nothing else of it is read."""
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        return f.read_at(length, offset)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder, by name: what a listing gives, no content."""
    from pyarrow import fs

    files, at = file_system(path)
    info = files.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + i.path if scheme else i.path, i.size) for i in found if i.type == fs.FileType.File)


def byte_blocks(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(path, block, content): the bytes of the files in blocks of a fixed size, on any file system all executors see.

    Files are cut by length before any byte is read, and each block is read by itself, so a giant file is spread over tasks.
    """
    files = list_files(path)
    sizes = spark.createDataFrame(files, "path string, size long")
    blocks = sizes.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / block_bytes)))).alias("block"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["block"]):
                yield pd.DataFrame([(p, int(b), read_range(p, int(b) * block_bytes, block_bytes))], columns=["path", "block", "content"])

    return blocks.repartition(max(1, min(10_000, sum(size // block_bytes + 1 for _, size in files))), "path", "block").mapInPandas(read, "path string, block long, content binary")


def plain_text(content: bytes) -> tuple[int | None, str]:
    """Default extractor without libraries: the bytes as UTF-8 text; the number of pages by form feeds."""
    text = content.decode("utf-8", "replace")
    return text.count("\f") + 1, text


def extract(files: DataFrame, extractor: Callable[[bytes], tuple[int | None, str]] = plain_text, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """One row for each file of a ``binaryFile`` frame, good or failed: the seam for decoders and models.

    Empty files are not listed by that source and so give no row. A file that fails is tried again in place, up to ``retries`` times, so one bad file costs no other file of its partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = bytes(content) if content is not None else b""
                for attempt in range(1, retries + 1):
                    try:
                        pages, text = extractor(raw)
                        rows.append((path, hashlib.sha256(raw).hexdigest(), len(raw), "success", attempt, None, pages, text))
                        break
                    except Exception as e:  # any failure of an opaque extractor is a result
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retries:
                            time.sleep(wait)
                else:
                    rows.append((path, hashlib.sha256(raw).hexdigest(), len(raw), "error", retries, error, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def progress(records: DataFrame) -> DataFrame:
    """One row: total, completed, failed, processed, percent, whether complete."""
    done, failed = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "error")
    total = F.count(F.lit(1))
    return records.agg(total.alias("total"), done.alias("completed"), failed.alias("failed"), (done + failed).alias("processed"), F.when(total > 0, (done + failed) * 100.0 / total).otherwise(0.0).alias("percent"), (done + failed == total).alias("is_complete"))


def read_csv_cells(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(path, row, col, text) of the non-empty fields of CSV files; rows count from 0 within a file, in file order.

    With ``multi_line`` a field may span lines, so a file is read as a whole by one task. Without it a file is read by splits of
    any number of tasks: each numbers its rows, and prefix sums over the splits of a file make these the numbers in the file.
    """
    fields = "row int, col int, text string"
    if multi_line:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for p, v in zip(pdf["path"], pdf["value"]):
                    got = [(p, i, j, x) for i, r in enumerate(csv.reader(io.StringIO(v))) for j, x in enumerate(r) if x]
                    yield pd.DataFrame(got, columns=["path", "row", "col", "text"])

        return raw.mapInPandas(rows, f"path string, {fields}")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")

    def split_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple[str, int], int] = {}
        for pdf in batches:
            got = []
            for p, s, v in zip(pdf["path"], pdf["split"], pdf["value"]):
                i = at[p, s] = at.get((p, s), -1) + 1
                # a row for each line, also of one without fields, keeps the count
                got.append((p, s, i, -1, None))
                got += [(p, s, i, j, x) for j, x in enumerate(next(csv.reader([v]), [])) if x]
            yield pd.DataFrame(got, columns=["path", "split", "row", "col", "text"])

    found = lines.mapInPandas(split_rows, f"path string, split long, {fields}")
    sizes = found.filter("col = -1").groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.filter("col >= 0").join(sizes.select("path", "split", before.alias("before")), ["path", "split"]).select("path", (F.col("row") + F.col("before")).cast("int").alias("row"), "col", "text")


def write_tables(frames: dict[str, DataFrame], folder: str, key: str = "doc_id", mode: str = "overwrite") -> None:
    """Normalised tables side by side as parquet, on any file system; exporting documents again replaces their rows in each table.

    With ``mode`` upsert the documents in the new frames replace those stored, also in tables where they have no rows any more,
    and nothing is doubled. A table is written beside the stored one and takes its place by renaming, so a job that fails
    leaves what was there.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    docs = None
    for df in frames.values():
        keys = df.select(key)
        docs = keys if docs is None else docs.unionByName(keys)
    docs = docs.distinct()
    fresh = []
    for name, df in frames.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        system = target.getFileSystem(conf)
        if mode == "upsert" and system.exists(target):
            old = spark.read.parquet(f"{folder}/{name}")
            df = old.join(docs, key, "left_anti").unionByName(df)
        df.write.mode("overwrite").parquet(f"{folder}/{name}.new")
        fresh.append((system, target, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.new"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.old")))
    # all are written before the first is renamed
    for system, target, new, old in fresh:
        if system.exists(target):
            system.delete(old, True)
            system.rename(target, old)
        system.rename(new, target)
        system.delete(old, True)


def write_sqlite(frames: dict[str, DataFrame], path: str, key: str = "doc_id") -> None:
    """Tables of a SQLite file: documents exported again replace their rows. The format has one writer, so rows come to the driver
    one partition at a time and are written in one transaction."""
    import sqlite3

    with sqlite3.connect(path) as db:
        for name, df in frames.items():
            kinds = ", ".join(f'"{f.name}" {"INTEGER" if f.dataType.typeName() in ("integer", "long", "short", "byte", "boolean") else "REAL" if f.dataType.typeName() in ("double", "float") else "TEXT"}' for f in df.schema)
            db.execute(f'CREATE TABLE IF NOT EXISTS "{name}" ({kinds})')
            db.execute(f'CREATE INDEX IF NOT EXISTS "{name}_{key}" ON "{name}" ("{key}")')
            for r in df.select(key).distinct().toLocalIterator():
                db.execute(f'DELETE FROM "{name}" WHERE "{key}" IS ?', (r[0],))
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


def read_sqlite(spark: SparkSession, path: str, name: str, block_rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file that all executors see, read in ranges of its row numbers by as many tasks."""
    import sqlite3

    kinds = {"INTEGER": "long", "REAL": "double"}
    with sqlite3.connect(path) as db:
        columns = [(c[1], kinds.get(c[2].upper(), "string")) for c in db.execute(f'PRAGMA table_info("{name}")')]
        if not columns:
            raise ValueError(f"{path} has no table {name}")
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
    starts = [] if low is None else [(i,) for i in range(low, high + 1, block_rows)]
    ranges = spark.createDataFrame(starts, "low long").repartition(max(1, min(len(starts), 10_000)), "low")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"long": pa.int64(), "double": pa.float64()}.get(k, pa.string()) for _, k in columns]
        for batch in batches:
            for start in batch.column(0).to_pylist():
                with sqlite3.connect(path) as db:
                    rows = db.execute(f'SELECT * FROM "{name}" WHERE rowid >= ? AND rowid < ?', (start, start + block_rows)).fetchall()
                values = list(zip(*rows)) if rows else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c for c, _ in columns])

    return ranges.mapInArrow(read, ", ".join(f"`{c}` {k}" for c, k in columns))


def write_result(df: DataFrame, path: str, kind: str) -> None:
    """Write as json, markdown (a single text column), csv, parquet or summary (json); any other kind is an error."""
    if kind in ("json", "summary"):
        df.write.mode("overwrite").json(path)
    elif kind == "markdown":
        df.write.mode("overwrite").text(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no such format: {kind}")


def post_each(df: DataFrame, send: Callable[[dict], None]) -> None:
    """Send each row by ``send`` from the executors, partition by partition: the seam for services."""

    def run(rows: Iterator) -> None:
        for r in rows:
            send(r.asDict(recursive=True))

    df.foreachPartition(run)


def check_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """The rows whose vector has the right length; others raise, as a vector store with a fixed dimension would."""
    ok = F.size(column) == dim
    return df.withColumn(column, F.when(ok | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: a vector is not {dim} long but "), F.size(column).cast("string")))))
