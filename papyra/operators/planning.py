"""Processing plans, estimates, cache decisions and resources, as expressions over profiles and cache entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import stored

MB = 1024 * 1024


def complexity(size: Column, pages: Column, images: Column, tables: Column, forms: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    size, pages = F.coalesce(size, F.lit(0)), F.coalesce(pages, F.lit(0))
    score = F.when(size > 10 * MB, 2).when(size > MB, 1).otherwise(0) + F.when(pages > 50, 2).when(pages > 10, 1).otherwise(0) + yes(images) + yes(tables) + yes(forms)
    return F.when(score >= 5, "complex").when(score >= 2, "medium").otherwise("simple")


def estimate_seconds(pages: Column, kind: Column, workers: Column) -> Column:
    base = pages * 1.5 * F.when(kind == "complex", 2.0).when(kind == "medium", 1.5).otherwise(1.0)
    return base / F.greatest(F.least(workers, pages) * 0.7, F.lit(1.0))


def estimate_memory(pages: Column, dpi: Column, max_pages: Column) -> Column:
    """MB; no limit of pages (null or 0) means all."""
    n = F.least(pages, F.when(F.coalesce(max_pages, F.lit(0)) == 0, pages).otherwise(max_pages))
    ratio = dpi / 200.0
    return 100 + n * ratio * ratio * 50


# Strategies with (name, workers, pages of images, dpi, text, factor of time); workers 0 for the most there are.
STRATEGIES = [("fast", 0, 3, 150, True, 0.5), ("accurate", 2, None, 300, True, 2.0), ("balanced", 4, 10, 200, True, 1.0), ("tables", 2, 0, 150, False, 0.3), ("text", 1, 0, 150, True, 0.2)]
FIXED_MEMORY = {"tables": 200.0, "text": 100.0}


def plans(profiles: DataFrame, key: str = "profile_id", most_workers: int = 8) -> DataFrame:
    """One row a profile and strategy with its settings and estimates. Profiles need the columns of ``complexity``."""
    rows = [F.struct(F.lit(n).alias("strategy"), F.lit(w or most_workers).alias("workers"), F.lit(p).cast("int").alias("image_pages"), F.lit(d).alias("dpi"), F.lit(t).alias("with_text"), F.lit(f).alias("factor")) for n, w, p, d, t, f in STRATEGIES]
    e = profiles.withColumn("s", F.explode(F.array(*rows))).select("*", "s.*")
    pages = F.coalesce("page_count", F.lit(0))
    images = F.when(F.col("strategy") == "balanced", F.least(pages, F.lit(10))).otherwise(F.col("image_pages"))
    seconds = estimate_seconds(pages, F.col("complexity"), F.col("workers")) * F.col("factor")
    memory = F.lit(None).cast("double")
    for name, mb in FIXED_MEMORY.items():
        memory = F.when(F.col("strategy") == name, mb).otherwise(memory)
    memory = F.coalesce(memory, estimate_memory(pages, F.col("dpi"), images))
    return e.select(
        key, "strategy", "workers", images.alias("image_pages"), "dpi", "with_text", F.when(F.col("strategy") == "tables", True).when(F.col("strategy") == "text", False).when(F.col("strategy") == "fast", F.col("has_tables"))
        .when(F.col("strategy") == "accurate", True).otherwise(F.col("has_tables")).alias("with_tables"), seconds.alias("seconds"), memory.alias("memory_mb"),
    )


def adaptive_plan(pages: Column, kind: Column, scanned: Column, images: Column, most_workers: int = 8) -> Column:
    """Struct of the adaptive plan: workers by pages, images by whether the document is scanned or has any, model if not simple."""
    workers = F.when(pages <= 5, 2).when(pages <= 20, 4).otherwise(min(most_workers, 6))
    image_pages = F.when(scanned, pages).when(images, F.least(pages, F.lit(10))).otherwise(3)
    dpi = F.when(scanned, 300).when(images, 200).otherwise(150)
    return F.struct(workers.alias("workers"), image_pages.alias("image_pages"), dpi.alias("dpi"), kind.isin("medium", "complex").alias("use_model"))


def recent(df: DataFrame, order: Column, n: int = 100, key: str | None = None) -> DataFrame:
    """The last ``n`` rows of the history, or of each ``key``; a top-n that needs no full sort of one partition without key."""
    if key is None:
        return df.orderBy(order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def cache_priority(kind: Column, pages: Column, size: Column) -> Column:
    p = F.when(kind == "complex", 2.0).when(kind == "medium", 1.5).otherwise(1.0) * F.when(pages > 50, 1.5).when(pages > 20, 1.2).otherwise(1.0)
    return p * F.when(size > 10 * MB, 0.7).otherwise(1.0)


def admit(size_mb: Column, priority: Column, budget_mb: float) -> Column:
    return F.when(size_mb > 0.5 * budget_mb, False).when(priority > 2, True).otherwise(priority > 0.1 * size_mb)


def eviction_score(age_seconds: Column, count: Column, priority: Column, size_mb: Column) -> Column:
    return 0.3 / (age_seconds + 1) + 0.3 * count + 0.3 * priority - 0.1 * size_mb


def evictions(entries: DataFrame, budget_mb: float, key: str = "file_hash", buckets: int = 200) -> DataFrame:
    """(key, score, evicted): entries by score from the lowest, evicted until the rest is within the budget.

    The running sum over all entries is made in two steps, by sampled ranges of (score, key) and within them, so no task sees all
    rows, however many share a score.
    """
    e = stored(entries.repartitionByRange(buckets, F.desc("score"), F.col(key)).withColumn("_b", F.spark_partition_id()))
    sums = e.groupBy("_b").agg(F.sum("size_mb").alias("mb"))
    above = sums.select("_b", F.coalesce(F.sum("mb").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))
    within = F.sum("size_mb").over(Window.partitionBy("_b").orderBy(F.desc("score"), key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.join(above, "_b").select(key, "score", (F.col("above") + within > budget_mb).alias("evicted"))


def predict_hits(accesses: DataFrame, key: str, at: str, now: Column, in_memory: DataFrame | None = None) -> DataFrame:
    """(key, probability): by the mean gap between accesses and the time since the last; under two accesses 0, in memory 1."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    w = Window.partitionBy(key).orderBy(at)
    gaps = accesses.withColumn("_t", seconds(F.col(at))).withColumn("_gap", F.col("_t") - F.lag("_t").over(w))
    g = gaps.groupBy(key).agg(F.avg("_gap").alias("mean"), F.max("_t").alias("last"))
    p = F.when(F.col("mean").isNull(), 0.0).when(F.col("mean") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (seconds(now) - F.col("last")) / F.col("mean")))
    out = g.select(key, p.alias("probability"))
    if in_memory is not None:
        hit = in_memory.select(F.col(key).alias("_k"), F.lit(True).alias("_m")).distinct()
        out = out.join(hit, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_m"), 1.0).otherwise(F.col("probability")).alias("probability"))
    return out


def misses(files: DataFrame, results: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files whose content digest has no stored result yet."""
    return files.join(results.select(key), key, "left_anti")


def workers(asked: Column, cpus: Column, cpu_percent: Column, memory_mb: Column, per_worker_mb: Column, most: Column) -> Column:
    """Number of workers by request, free processors, four fifths of the memory and a limit; at least one."""
    return F.greatest(F.lit(1), F.least(asked, F.floor(cpus * (1 - cpu_percent / 100)), F.floor(0.8 * memory_mb / per_worker_mb), most)).cast("int")


def resolution(dpi: Column, free_mb: Column, needed_mb: Column) -> Column:
    """A resolution that fits the memory, at least 150."""
    return F.when(needed_mb <= free_mb, dpi).otherwise(F.greatest(F.lit(150), F.floor(dpi * F.sqrt(free_mb / needed_mb)))).cast("int")


def cache_get(asked: DataFrame, memory: DataFrame, disk: DataFrame, key: str = "file_hash") -> DataFrame:
    """(asked columns, found): memory, disk or miss for each access; what is on both is found in memory."""
    m = memory.select(F.col(key).alias("_mk")).distinct()
    d = disk.select(F.col(key).alias("_dk")).distinct()
    out = asked.join(m, F.col(key) == F.col("_mk"), "left").join(d, F.col(key) == F.col("_dk"), "left")
    return out.select(*asked.columns, F.when(F.col("_mk").isNotNull(), "memory").when(F.col("_dk").isNotNull(), "disk").otherwise("miss").alias("found"))


def cache_after(memory: DataFrame, disk: DataFrame, accesses: DataFrame, now: Column, key: str = "file_hash") -> DataFrame:
    """The memory cache after accesses (key, at): entries found have their count raised and their last access set; entries found
    on disk only are promoted, with one access, priority 1 and the size they have there. Entries are (key, size_mb, count,
    priority, last_access). An access to what is nowhere changes nothing."""
    n = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    kept = memory.join(n, key, "left").select(key, "size_mb", (F.col("count") + F.coalesce("_n", F.lit(0))).alias("count"), "priority", F.coalesce("_at", "last_access").alias("last_access"))
    promoted = disk.join(n, key).join(memory.select(key), key, "left_anti")
    # the first access promotes, the others count
    return kept.unionByName(promoted.select(key, "size_mb", F.col("_n").alias("count"), F.lit(1.0).alias("priority"), F.coalesce("_at", now).alias("last_access")))


def cache_put(memory: DataFrame, results: DataFrame, budget_mb: float, key: str = "file_hash") -> DataFrame:
    """The memory cache with new results (entries as in ``cache_after``) that are admitted; a result replaces the entry of its key."""
    fresh = results.filter(admit(F.col("size_mb"), F.col("priority"), budget_mb))
    return memory.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*memory.columns))


def cache_warm(memory: DataFrame, disk: DataFrame, wanted: DataFrame, now: Column, key: str = "file_hash") -> DataFrame:
    """The memory cache with the wanted keys that are on disk and not in memory yet, each with one access."""
    missing = disk.join(wanted.select(key).distinct(), key).join(memory.select(key), key, "left_anti")
    return memory.unionByName(missing.select(key, "size_mb", F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("priority"), now.alias("last_access")))


def cache_stats(memory: DataFrame, patterns: DataFrame, budget_mb: float, found: DataFrame | None = None, key: str = "file_hash") -> DataFrame:
    """One row: entries, size and use of the memory, accesses and their mean, tracked patterns; with the ``found`` of ``cache_get``
    also hits, misses and the rate of hits."""
    one = memory.agg(F.count(F.lit(1)).alias("memory_entries"), F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("memory_size_mb"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_accesses"))
    one = one.withColumns({"memory_utilization": F.col("memory_size_mb") / budget_mb, "avg_accesses_per_entry": F.when(F.col("memory_entries") > 0, F.col("total_accesses") / F.col("memory_entries")).otherwise(0.0)})
    one = one.crossJoin(patterns.agg(F.count_distinct(key).alias("tracked_patterns")))
    if found is None:
        return one
    hit = found.agg(F.count_if(F.col("found") != "miss").alias("hits"), F.count_if(F.col("found") == "miss").alias("misses"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0)
    return one.crossJoin(hit).withColumn("hit_rate", rate)


# Public models with what they take (provider, tokens of the answer, size of the context), and the models preferred by kind of
# document. What a provider charges changes and is no part of the catalogue.
MODELS = {
    "gpt-4o": ("openai", 4096, 128_000), "gpt-4o-mini": ("openai", 4096, 128_000), "gpt-4-turbo": ("openai", 4096, 128_000), "claude-3-5-sonnet": ("anthropic", 4096, 200_000), "claude-3-haiku": ("anthropic", 4096, 200_000),
    "gemini-2.0-flash": ("google", 8192, 1_000_000), "gemini-2.5-flash": ("google", 8192, 1_000_000), "gemini-2.5-pro": ("google", 8192, 1_000_000), "azure-gpt-4o": ("azure_openai", 4096, 128_000), "llama-3.2-vision": ("ollama", 4096, 8192),
}
_LARGE, _SMALL = ["gpt-4o", "claude-3-5-sonnet", "gemini-1.5-pro"], ["gpt-4o-mini", "claude-3-haiku", "gemini-1.5-flash"]
PREFERRED = {
    "tax_documents": _LARGE, "financial_statements": _LARGE, "legal_contracts": _LARGE[:2], "medical_records": _LARGE[:2], "invoices_receipts": _SMALL, "research_papers": _LARGE, "general_documents": _SMALL,
}
# Prompts by information type, and what is added to some.
PROMPTS = {
    "general": "Analyze this document and provide a detailed description of its content, structure, and purpose.",
    "tables": "Identify and describe all tables in this document. For each table, describe its structure, headers, and key data. Format your response to clearly separate each table and its contents.",
    "forms": "Identify all form fields in this document. List the field names, types, and any filled values you can see. Present the form fields in a structured format.",
    "metadata": "Extract metadata from this document including title, author, date, document type, and any other identifying information. Present the metadata in a structured format with clear labels.",
    "summary": "Provide a concise summary of this document's main points and key information.",
}


def choose_model(kind: Column, providers: Column, default: Column) -> Column:
    """The first model preferred for a kind of document (general for an unknown one) that the catalogue has and whose provider is
    in the array of those with a key; else the default."""
    pick = lambda names: F.coalesce(*[F.when(F.array_contains(providers, MODELS[m][0]), m) for m in names if m in MODELS], default)
    out = pick(PREFERRED["general_documents"])
    for name, models in PREFERRED.items():
        out = F.when(kind == name, pick(models)).otherwise(out)
    return out


def prompt(kind: Column) -> Column:
    """The prompt of an information type; that of ``general`` for an unknown one."""
    out = F.lit(PROMPTS["general"])
    for name, text in PROMPTS.items():
        out = F.when(kind == name, text).otherwise(out)
    return out
