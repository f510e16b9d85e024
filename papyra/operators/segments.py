"""Page fingerprints to segments, chunks for embedding, vectors and the choice among OCR results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMILAR = 0.9
CHUNK, OVERLAP = 1000, 100


def page_similarity(len1: Column, len2: Column, alpha1: Column, alpha2: Column, hash1: Column, hash2: Column) -> Column:
    """Likeness of two pages from 0 to 1 by text length, share of letters and 64-bit visual hash."""
    share = lambda a, b: F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))
    return 0.3 * share(len1, len2) + 0.1 * share(alpha1, alpha2) + 0.6 * (1 - F.bit_count(hash1.bitwiseXOR(hash2)) / 64.0)


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, page, similarity, segment): a page less than 0.9 like the one before begins a new segment, counted from 0."""
    w = Window.partitionBy("doc_id").orderBy("page")
    prev = {c: F.lag(c).over(w) for c in ("text_length", "alpha_ratio", "visual_hash")}
    out = pages.withColumns({f"_{c}": e for c, e in prev.items()})
    sim = page_similarity(F.col("text_length"), F.col("_text_length"), F.col("alpha_ratio"), F.col("_alpha_ratio"), F.col("visual_hash"), F.col("_visual_hash"))
    out = out.withColumn("similarity", F.when(F.col("_text_length").isNotNull(), sim))
    starts = F.when(F.col("similarity") < SIMILAR, 1).otherwise(0)
    return out.withColumn("segment", F.sum(starts).over(w)).select("doc_id", "page", "similarity", "segment")


def segment_pages(found: DataFrame) -> DataFrame:
    """(doc_id, segment, n_segments, first_page, last_page, n_pages): the chunk of pages each segment parses."""
    s = found.groupBy("doc_id", "segment").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_pages"))
    return s.withColumn("n_segments", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))


def mixed_documents(pages: DataFrame, sample: int = 10) -> DataFrame:
    """(doc_id, variance, mixed): whether the hashes of ten evenly spaced pages vary; documents of ten pages or less are not mixed.

    The ten pages are the feature, not a shortcut; the pairs of ten are the largest group.
    """
    w = Window.partitionBy("doc_id")
    p = pages.select("doc_id", "visual_hash", (F.row_number().over(w.orderBy("page")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    k = F.sequence(F.lit(0), F.lit(sample - 1))
    taken = p.filter(F.col("n") > sample).filter(F.array_contains(F.transform(k, lambda i: F.floor(i * (F.col("n") - 1) / (sample - 1)).cast("int")), F.col("i")))
    a, b = taken.select("doc_id", F.col("i").alias("i1"), F.col("visual_hash").alias("h1")), taken.select("doc_id", F.col("i").alias("i2"), F.col("visual_hash").alias("h2"))
    pairs = a.join(b, "doc_id").filter("i1 < i2").select("doc_id", F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))).alias("d"))
    varied = pairs.groupBy("doc_id").agg((F.var_pop("d") / 64.0).alias("variance"))
    docs = p.select("doc_id").distinct().join(varied, "doc_id", "left")
    return docs.select("doc_id", "variance", F.coalesce(F.col("variance") > 0.05, F.lit(False)).alias("mixed"))


def chunk_array(c: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Chunks of a text as an array of structs (start, text), by a fold that ends at the end of the text.

    A chunk ends at the last boundary in it, of the best kind there is (empty line, full stop and line end, full stop and
    blank, line end), if the next chunk then starts later than this one; else after ``size`` characters.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    n = F.length(c)
    kind = "array<struct<start:int,text:string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    # each chunk advances by at least one character beyond the overlap
    most = F.greatest(F.lit(1), F.ceil(n / 1.0 / max(1, (size - overlap) // 50)).cast("int") + 1)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        window = F.substr(c, at + 1, F.lit(size))
        cut = F.lit(None).cast("int")
        for b in ("\n\n", ".\n", ". ", "\n"):
            back = F.instr(F.reverse(window), b[::-1])
            place = F.when(back > 0, F.length(window) - back + 1)
            good = (place - len(b) > 0) & (place - overlap > 0)
            cut = F.coalesce(cut, F.when(good, place))
        end = F.when(at + size >= n, n).otherwise(at + F.coalesce(cut, F.lit(size)))
        piece = F.struct(at.cast("int").alias("start"), F.substr(c, at + 1, end - at).alias("text"))
        after = F.when(end >= n, n).otherwise(end - overlap)
        done = at >= n
        return F.struct(F.when(done, at).otherwise(after).cast("int").alias("at"), F.when(done, s["out"]).otherwise(F.concat(s["out"], F.array(piece))).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), most), first, step, lambda s: s["out"]))


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_id, chunk_index, total_chunks, start, text): each text in chunks; empty and null texts have none.

    One pass over each text by an Arrow-fed generator, as a fold in expressions is quadratic for long texts; ``chunk_array``
    gives the same. The id is a digest of key and index, the same on every run.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["t"]):
                at, n, own = 0, len(t), []
                while at < n:
                    end = min(at + size, n)
                    if end < n:
                        for b in ("\n\n", ".\n", ". ", "\n"):
                            i = t.rfind(b, at, end)
                            if i > at and i + len(b) - overlap > at:
                                end = i + len(b)
                                break
                    own.append((at, t[at:end]))
                    at = n if end >= n else end - overlap
                rows += [(k, i, len(own), a, x) for i, (a, x) in enumerate(own)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "start", "text"])

    out = df.select(key, F.col(text).alias("t")).filter("length(t) > 0").mapInPandas(run, f"{key} {kind}, chunk_index int, total_chunks int, start int, text string")
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; null for a zero vector or different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for a stated, small query set the k most similar vectors, by a scan of all vectors.

    The queries are a bounded set given by the caller (at most 10,000 are accepted); they are broadcast, the vectors are not moved.
    """
    if queries.limit(10_001).count() > 10_000:
        raise ValueError("a query set of at most 10,000; use the permutation index for more")
    q = F.broadcast(queries.select(F.col(id).alias("query_id"), F.col(vector).alias("q")))
    scored = vectors.select(F.col(id), F.col(vector).alias("v")).join(q, F.col(id) != F.col("query_id")).select("query_id", id, cosine(F.col("q"), F.col("v")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return scored.filter("score is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", id, "score")


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder without a model: words hashed to signed places, normalised. For tests and as a default."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


# Order in which engines are tried at each level of image quality.
ROUTES = {"high": ["tesseract", "doctr", "easyocr"], "medium": ["doctr", "easyocr", "tesseract"], "low": ["easyocr", "doctr", "tesseract"]}


def route(results: DataFrame, keys: list[str], threshold: float = 0.7, best: bool = False) -> DataFrame:
    """(keys, engine, confidence, passed, use_vlm): the first engine in the order of the level that reaches the threshold.

    If none does, the last tried as in the original, or with ``best`` the surest; on low images a vision model is called for.
    """
    level = F.lower("level")
    place = F.lit(None).cast("int")
    for name, order in ROUTES.items():
        place = F.when(level == name, F.array_position(F.array(*map(F.lit, order)), F.col("engine")).cast("int")).otherwise(place)
    passed = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    r = results.withColumns({"_place": place, "passed": passed}).filter("_place > 0")
    fallback = F.desc("confidence") if best else F.desc("_place")
    w = Window.partitionBy(*keys).orderBy(F.desc("passed"), F.when(F.col("passed"), F.col("_place")), fallback, "_place")
    first = r.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.select(*keys, "engine", "confidence", "passed", (~F.col("passed") & (level == "low")).alias("use_vlm"))


def ensemble(results: DataFrame, keys: list[str], order: str = "engine_ord") -> DataFrame:
    """(keys, engine, confidence, text): the surest result, or a later one nearly as sure with a text over 1.2 times as long."""
    item = F.struct(F.col(order).alias("o"), F.col("engine").alias("engine"), F.col("confidence").alias("confidence"), F.col("text").alias("text"))
    good = results.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    rows = good.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    top = F.element_at(F.array_sort(F.transform("items", lambda x: F.struct((-F.coalesce(x["confidence"], F.lit(0.0))).alias("c"), x["o"].alias("o"), x.alias("x")))), 1)["x"]

    def step(b: Column, x: Column) -> Column:
        better = (F.coalesce(x["confidence"], F.lit(0.0)) >= 0.9 * F.coalesce(b["confidence"], F.lit(0.0))) & (F.length(x["text"]) > 1.2 * F.length(b["text"]))
        return F.when(better, x).otherwise(b)

    return rows.select(*keys, F.aggregate("items", top, step).alias("r")).select(*keys, "r.engine", "r.confidence", "r.text")


def enhancement_plan(level: Column) -> Column:
    steps = ["shadow", "background", "deskew", "upscaling", "denoise", "contrast"]
    return F.when(F.lower(level) == "high", F.array(F.lit("light_contrast"))).otherwise(F.array(*map(F.lit, steps)))


def best_text(direct: Column, ocr: Column, second: Column) -> Column:
    """The text of a chain of extractors: the direct one if readable; another extractor where characters are missing; else OCR."""
    from papyra.functions.text import cid_count, is_readable_text, needs_cid_repair, strip

    short = F.length(F.coalesce(strip(direct), F.lit(""))) <= 10
    other = F.when(is_readable_text(second) & (cid_count(second) < cid_count(direct)), second)
    scanned = F.when(is_readable_text(ocr), ocr)
    return (
        F.when(short, F.coalesce(F.when(F.length(strip(second)) > 10, second), F.when(F.length(strip(ocr)) > 10, ocr), direct))
        .when(needs_cid_repair(direct), F.coalesce(other, scanned, direct)).when(~is_readable_text(direct), F.coalesce(scanned, direct)).otherwise(direct)
    )
