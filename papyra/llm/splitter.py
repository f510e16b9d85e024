"""Oversized texts cut into pieces at natural boundaries, by ranges with halos.

A text is a chain of ranges of ``TEXT_RANGE`` characters (``RANGE`` bytes, for files). Where two ranges meet, the first cut is
the best boundary in a fixed window at the start of the later one, so it is found without knowledge of any other range. For
files these cuts are a table of their own: workers read only the windows, the boundary tables of all ranges are stitched (each
range ends where the next begins), and then each range is read by its offsets, from its cut to the next, with the overlap as
halo. Texts in rows are in memory as a whole, so there each range finds the next one's cut again in its halo, which is the
same. Numbers of pieces are prefix sums over the ranges. So a giant text is worked on by as many tasks as it has ranges, and
no task holds more than one. Within a range cuts are made greedily: the last boundary of the best kind in the second half of
what may still be taken. Kinds, best first: end of a paragraph, of a line, of a sentence, of a word; where there is none the
text is cut between two characters, though not inside a character sequence joined by combining marks, variation selectors or
zero-width joiners if that can be avoided.

A piece begins ``overlap`` characters before the end of the one before, or at a later natural boundary if there is one
among these characters (so that a piece does not begin within a word); only then do two pieces share less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, TEXT_RANGE, RANGE = 1000, 100, 4096, 1 << 20

# Signs that end a sentence, among them those of Chinese, Japanese, Arabic and Hindi.
_KINDS = [
    re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?…؟۔][\"'”’)\]]*\s+|[。！？।]+[」』”]*\s*"),
    re.compile(r"\s+|[、，；]"),
]
_JOINED = re.compile("[̀-ًͯ-ٟऺ-ॏ‍︀-️\U0001f3fb-\U0001f3ff]")


def _last(text: str, low: int, high: int) -> int:
    """The best boundary in (low, high]: text is cut before the character at that place."""
    window = text[max(0, low) : high]
    base = max(0, low)
    for kind in _KINDS:
        best = -1
        for m in kind.finditer(window):
            # a boundary that goes on behind the window is used up to its end
            if m.end() > 0 and base + m.end() > low:
                best = base + m.end()
        if best > low:
            return best
    at = high
    while at > low + 1 and at > high - 16 and at < len(text) and (_JOINED.match(text[at]) or text[at - 1] == "\u200d"):
        at -= 1
    return at


def _begin(text: str, end: int, overlap: int, floor: int) -> int:
    """Where the piece after a cut at ``end`` begins: ``overlap`` before it, or at the first later boundary."""
    at = max(end - overlap, floor)
    if at <= 0 or at >= end:
        return max(0, min(at, end))
    if not (text[at - 1].isspace() or text[at - 1] in "。！？।、，；"):
        m = _KINDS[3].search(text, at, end)
        if m and m.end() < end:
            return m.end()
        while at < end and (_JOINED.match(text[at]) or text[at - 1] == "\u200d"):
            at += 1
    return at


def _greedy(text: str, begin: int, last: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces from ``begin`` to the cut at ``stop``, where the piece before ended at ``last``."""
    out: list[tuple[int, int]] = []
    while begin + limit < stop:
        high, rest = begin + limit, stop - begin
        if rest <= limit + limit // 2:  # two pieces are left: neither may vanish in the overlap of the next
            high = min(high, begin + (rest + overlap) // 2 + limit // 8)
        # at least half of the new characters are used, so pieces do not become small
        end = _last(text, max(begin + overlap, (last + high) // 2), high)
        out.append((begin, end))
        last = end
        begin = max(_begin(text, end, overlap, begin + 1), end - overlap)
    if stop > last:
        out.append((begin, stop))
    return out


def first_cut(window: str, limit: int) -> int:
    """The cut by which two ranges meet: the best boundary in the ``limit // 2`` characters at the start of the later one."""
    return _last(window, 0, min(len(window), limit // 2))


def range_pieces(text: str, offset: int, own: int, first: bool, last: bool, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of one range. ``text`` starts ``offset`` characters (the halo) before the range, which has ``own`` characters.

    The range's pieces lie between its first cut and that of the next range; a piece that follows the first cut of the
    range begins in the halo, by the overlap.
    """
    start = 0 if first else offset + first_cut(text[offset:], limit)
    stop = len(text) if last else offset + own + first_cut(text[offset + own :], limit)
    begin = start if first else max(_begin(text, start, overlap, 0), start - overlap)
    return _greedy(text, begin, start, stop, limit, overlap)


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap * 4 <= limit or limit < 16:
        raise ValueError("the limit is at least 16 and the overlap at most a quarter of it")


def split_texts(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, span: int = TEXT_RANGE) -> DataFrame:
    """(keys, n_range, in_range, begin, end, text) of the rows whose text has more than ``limit`` characters.

    begin and end are places in the text, in characters; joining the pieces without their overlaps gives the text. Null, empty
    and short texts have no pieces. Repeated rows (same keys, same text) count once; other columns are not read. Characters
    are Unicode code points. ``number_pieces`` numbers the pieces within their text.
    """
    _check(limit, overlap)
    if span < 2 * limit:
        raise ValueError("a range holds at least two pieces")
    fields = [df.schema[k] for k in keys]
    wide = df.select(*keys, F.col(text).alias("_t")).filter(F.length("_t") > limit).dropDuplicates()
    halo = limit
    schema = T.StructType([*fields, T.StructField("n_range", T.IntegerType()), T.StructField("in_range", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i0 in range(0, batch.num_rows, 64):
                part = batch.slice(i0, 64)
                at, cols = [], ([], [], [], [], [])
                for i, whole in enumerate(part.column(len(keys)).to_pylist()):
                    n = len(whole)
                    for r in range(-(-n // span)):
                        low = max(0, r * span - halo)
                        last = (r + 1) * span >= n
                        text = whole[low : (r + 1) * span + halo]
                        for k, (a, b) in enumerate(range_pieces(text, r * span - low, span, r == 0, last, limit, overlap)):
                            at.append(i)
                            for col, v in zip(cols, (r, k, low + a, low + b, text[a:b])):
                                col.append(v)
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j).take(index) for j in range(len(keys))), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
                    names=schema.names,
                )

    return wide.select(*keys, "_t").mapInArrow(run, schema)


def number_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered numbers of the pieces of each text, by prefix sums over its ranges: no text and no piece is gathered.

    The ranges of one text (a row for each ``RANGE`` characters) are the largest group of the window.
    """
    from pyspark.sql import Window

    per_range = pieces.groupBy(*keys, "n_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("n_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    before = per_range.select(*named, F.col("n_range").alias("_r"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("n_range") == F.col("_r")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return pieces.join(before, cond).select(*keys, (F.col("_before") + F.col("in_range")).cast("int").alias("piece"), "begin", "end", "text")


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """(path, piece, begin, end, text) of UTF-8 files on any file system all executors see, each read range by range.

    First only the windows at the ranges' starts are read and give the boundary table; stitched, it tells where each range
    begins and ends; then each range is read by these offsets, with ``overlap`` before it. ``begin`` and ``end`` are byte
    offsets. Invalid bytes become U+FFFD and make offsets within their range approximate. Empty files have no pieces.
    """
    from papyra.sources.files import file_size, read_range

    _check(limit, overlap)
    if span < 8 * limit:
        raise ValueError("a range holds at least eight pieces")
    sizes = [(p, file_size(p)) for p in paths]
    n_ranges = sum(-(-s // span) for _, s in sizes)
    ranges = spark.createDataFrame([x for x in sizes if x[1]], "path string, size long").select(
        "path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / span).cast("int"))).alias("n_range")
    )
    ranges = ranges.repartition(max(1, min(n_ranges, 10_000)), "path", "n_range")

    def whole(raw: bytes, ends: bool) -> tuple[int, str]:
        """Where the first whole character begins, and the text up to the last whole one."""
        low, high = 0, len(raw)
        while low < min(4, high) and raw[low] & 0xC0 == 0x80:
            low += 1
        back = high
        while not ends and back > max(low, high - 4):
            back -= 1
            if raw[back] & 0xC0 != 0x80:
                need = 1 if raw[back] < 0x80 else 2 if raw[back] < 0xE0 else 3 if raw[back] < 0xF0 else 4
                high = back if back + need > high else high
                break
        return low, raw[low:high].decode("utf-8", "replace")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for path, size, r in zip(*(c.to_pylist() for c in batch.columns)):
                if not r:
                    starts.append(0)
                    continue
                wanted = min(size - r * span, 2 * limit + 8)
                low, text = whole(read_range(path, r * span, wanted), r * span + wanted == size)
                starts.append(r * span + low + len(text[: first_cut(text, limit)].encode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=["path", "size", "n_range", "start"])

    from pyspark.sql import Window

    met = ranges.mapInArrow(meet, "path string, size long, n_range int, start long")
    stitched = met.select("path", "n_range", "start", F.coalesce(F.lead("start").over(Window.partitionBy("path").orderBy("n_range")), F.col("size")).alias("stop"))
    stitched = stitched.repartition(max(1, min(n_ranges, 10_000)), "path", "n_range")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, r, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                first = max(0, start - 4 * overlap - 4)
                raw = read_range(path, first, stop - first)
                low, before = whole(raw[: start - first], True)
                text = before + raw[start - first :].decode("utf-8", "replace")
                at, seen, rows = first + low, 0, []
                begin = max(_begin(text, len(before), overlap, 0), len(before) - overlap) if r else 0
                for k, (a, b) in enumerate(_greedy(text, begin, len(before), len(text), limit, overlap)):
                    at += len(text[seen:a].encode()) if a >= seen else -len(text[a:seen].encode())
                    seen = a
                    rows.append((path, r, k, at, at + len(text[a:b].encode()), text[a:b]))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["path", "n_range", "in_range", "begin", "end", "text"])

    return number_pieces(stitched.mapInArrow(emit, "path string, n_range int, in_range int, begin long, end long, text string"), ["path"])
