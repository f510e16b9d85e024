"""Evaluation texts inside training text: Wu-Manber search over words.

A word is a run of ASCII letters and digits, compared without regard to case; whatever stands between words is ignored. The
patterns are all windows of ``n`` consecutive words of the test items, the symbols are words and a block is two of them. The
shift table says how far the search may jump after looking at the block at the end of the current position: blocks that
occur in no pattern allow a jump of ``n - 1`` words. Where a block ends a pattern (shift 0) its bucket names the patterns
with that suffix and a comparison of all words decides.

The items are the stated query set. They are broadcast in groups of at most ``GROUP_BYTES`` of text; more items mean more
passes over the corpus, never a larger broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 12
GROUP_BYTES = 8_000_000

_WORDS = re.compile(rb"[a-z0-9]+").findall


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.lower())


class Patterns:
    """Shift table and suffix buckets of all windows of ``n`` words of the items."""

    def __init__(self, items: list[tuple[object, bytes]], n: int = WINDOW):
        self.n = n
        self.owners: dict[tuple[bytes, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            for i in range(len(words) - n + 1):
                self.owners.setdefault(tuple(words[i : i + n]), set()).add(k)
        self.shift: dict[tuple[bytes, bytes], int] = {}
        self.buckets: dict[tuple[bytes, bytes], dict[tuple[bytes, ...], set[int]]] = {}
        for pattern, owners in self.owners.items():
            for j in range(1, n):
                block = pattern[j - 1 : j + 1]
                self.shift[block] = min(self.shift.get(block, n - 1), n - 1 - j)
            self.buckets.setdefault(pattern[-2:], {})[pattern] = owners

    def search(self, words: list[bytes]) -> dict[int, int]:
        """Number of places at which a window of each item (by its number) begins."""
        found: dict[int, int] = {}
        n, shift, buckets = self.n, self.shift.get, self.buckets
        far, end = n - 1, len(words)
        i = n - 1
        while i < end:
            block = (words[i - 1], words[i])
            step = shift(block, far)
            if step:
                i += step
                continue
            owners = buckets[block].get(tuple(words[i - n + 1 : i + 1]))
            if owners:
                for k in owners:
                    found[k] = found.get(k, 0) + 1
            i += 1
        return found


def leaked_items(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """(``key``, ``item_key``, n_windows): the items of which a row of ``corpus`` holds at least ``n`` consecutive words.

    n_windows counts the places where a shared window begins; a passage of m >= n words gives m - n + 1. Null and empty texts
    and items under ``n`` words match nothing. Rows of ``corpus`` are searched one by one, so repeated rows give repeated
    results; other columns are not read, whatever their names.
    """
    if n < 2:
        raise ValueError("a window has at least two words")
    spark = corpus.sparkSession
    queries = items.select(F.col(item_key).alias("k"), F.encode(item_text, "UTF-8").alias("t")).filter("t is not null").distinct()
    groups = max(1, -(-int(queries.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]) // GROUP_BYTES))
    schema = T.StructType([T.StructField(key, corpus.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType), T.StructField("n_windows", T.LongType())])
    kinds = pa.schema([pa.field(item_key, _arrow(items.schema[item_key].dataType))])
    texts = corpus.select(F.col(key), F.encode(text, "UTF-8").alias("t")).filter("t is not null")
    parts = []
    for g in range(groups):
        rows = [(r.k, bytes(r.t)) for r in queries.filter(F.pmod(F.xxhash64("k", "t"), F.lit(groups)) == g).sort("k", "t").collect()]
        shared = spark.sparkContext.broadcast({"n": n, "rows": rows})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            given = shared.value
            n, rows = given["n"], given["rows"]
            # the tables are built once in a worker, not in each of its tasks
            patterns = given.get("patterns") or given.setdefault("patterns", Patterns(rows, n))
            for batch in batches:
                at, ks, counts = [], [], []
                for i, raw in enumerate(batch.column(1)):
                    words = words_of(raw.as_buffer().to_pybytes())
                    if len(words) >= n:
                        for k, count in patterns.search(words).items():
                            at.append(i)
                            ks.append(rows[k][0])
                            counts.append(count)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ks, kinds.field(0).type), pa.array(counts, pa.int64())], names=[key, item_key, "n_windows"])

        parts.append(texts.mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
