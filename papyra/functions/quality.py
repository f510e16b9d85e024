"""Quality scores of texts, tables, forms and whole extractions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import WS, alpha_ratio, let, letters, ratio, removed, tokens

# Weights of the overall score.
WEIGHTS = {"text": 0.3, "structure": 0.25, "confidence": 0.2, "completeness": 0.15, "consistency": 0.1}


def syllables(c: Column) -> Column:
    """Runs of vowels, one less if the whole text ends in an e, at least one."""
    n = F.regexp_count(c, F.lit("[aeiouyAEIOUY]+")) - F.when(c.rlike(r"[eE]\z"), 1).otherwise(0)
    return F.greatest(n, F.lit(1))


def _measures(c: Column) -> dict[str, Column]:
    """What the scores of a text are made of; each is one pass over the text."""
    return {
        "n": F.length(c), "words": tokens(c), "sentences": F.regexp_count(c, F.lit("[.!?]+")) + 1, "syllables": syllables(c), "letters": letters(c), "blanks": removed(c, WS), "signs": artifacts(c), "dense": removed(c, r"[\p{L}\p{N}]"),
    }


def _flesch(m: Column) -> Column:
    score = 206.835 - 1.015 * (m["words"] / m["sentences"]) - 84.6 * (m["syllables"] / m["words"])
    return F.when(m["words"] >= 10, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def _coherence(m: Column) -> Column:
    length, space, alpha = ratio(m["n"] - m["blanks"], m["words"]), ratio(m["blanks"], m["n"]), ratio(m["letters"], m["n"])
    score = (F.when(length.between(3, 8), 1.0).otherwise(0.5) + F.least(alpha / 0.8, F.lit(1.0)) + F.least(space / 0.15, F.lit(1.0))) / 3
    return F.when(m["n"] == 0, 0.0).when(m["words"] < 5, 0.5).otherwise(score)


def _of(c: Column, f: Callable[[Column], Column], *names: str) -> Column:
    parts = _measures(c)
    return let(f, **{n: parts[n] for n in names})


def flesch(c: Column) -> Column:
    """Reading ease from 0 to 100; under ten words 0."""
    return _of(c, _flesch, "words", "sentences", "syllables")


def coherence(c: Column) -> Column:
    return _of(c, _coherence, "n", "words", "letters", "blanks")


def single_letters(c: Column) -> Column:
    """Tokens of one small letter a to z, between characters that are no word characters."""
    return F.regexp_count(c, F.lit(r"(?<![\p{L}\p{N}_])[a-z](?![\p{L}\p{N}_])"))


def artifacts(c: Column) -> Column:
    """Number of places that look like errors of a reader."""
    hits = single_letters(c)
    for pattern in (r"\|{2,}", "_{3,}", r"\.{3,}", r"\?{2,}", "[0-9][a-zA-Z][0-9]"):
        hits = hits + F.regexp_count(c, F.lit(pattern))
    return hits


def artifact_ratio(c: Column) -> Column:
    return _of(c, lambda m: F.least(ratio(m["signs"], m["n"]), F.lit(1.0)), "n", "signs")


def density(c: Column) -> Column:
    return ratio(removed(c, r"[\p{L}\p{N}]"), F.length(c))


def character_distribution(c: Column) -> Column:
    n = F.length(c)
    return F.struct(
        alpha_ratio(c).alias("alphabetic"), ratio(removed(c, r"\p{Nd}"), n).alias("numeric"), ratio(removed(c, "[.,!?;:]"), n).alias("punctuation"), ratio(removed(c, WS), n).alias("whitespace")
    )


def text_metrics(c: Column) -> Column:
    """Struct (readability, coherence, artifacts, density, score) of a text; each pass over it is made once."""

    def make(m: Column) -> Column:
        parts = {"readability": _flesch(m), "coherence": _coherence(m), "artifacts": F.least(ratio(m["signs"], m["n"]), F.lit(1.0)), "density": ratio(m["dense"], m["n"])}
        score = lambda p: 0.3 * F.least(p["readability"] / 100, F.lit(1.0)) + 0.3 * p["coherence"] + 0.2 * (1 - p["artifacts"]) + 0.2 * F.least(p["density"], F.lit(1.0))
        return let(lambda p: F.struct(*[p[k].alias(k) for k in parts], score(p).alias("score")), **parts)

    return let(make, **_measures(c))


def text_score(c: Column) -> Column:
    return text_metrics(c)["score"]


def confidence_class(average: Column, variance: Column) -> Column:
    """Class of a distribution of confidences by mean and population variance."""
    return (
        F.when((average > 0.8) & (variance < 0.05), "high_consistent").when((average > 0.6) & (variance < 0.1), "good_consistent")
        .when(variance > 0.2, "highly_variable").when(average < 0.4, "low_confidence").otherwise("moderate")
    )


def confidence_stats(values: Column) -> list[Column]:
    """Aggregates over a group of confidences; without any: 0.5, 0, 0, 0, unknown."""
    n = F.count(values)
    mean, var = F.avg(values), F.var_pop(values)
    return [
        F.coalesce(mean, F.lit(0.5)).alias("average"), F.coalesce(var, F.lit(0.0)).alias("variance"), F.coalesce(F.min(values), F.lit(0.0)).alias("minimum"),
        F.coalesce(F.max(values), F.lit(0.0)).alias("maximum"), F.when(n == 0, "unknown").otherwise(confidence_class(mean, var)).alias("distribution"),
    ]


def table_score(has_data: Column, has_headers: Column, confidence: Column, rows: Column, cols: Column) -> Column:
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return yes(has_data, 0.3) + yes(has_headers, 0.2) + yes(confidence > 0.7, 0.3) + yes((rows > 1) & (cols > 1), 0.2)


def form_score(has_fields: Column, has_types: Column, confidence: Column) -> Column:
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return yes(has_fields, 0.4) + yes(has_types, 0.2) + yes(confidence > 0.7, 0.4)


def structure_score(has_tables: Column, has_forms: Column, has_images: Column, has_hierarchy: Column, table_quality: Column, form_quality: Column, layout_quality: Column) -> Column:
    flags = sum((c.cast("int") for c in (has_forms, has_images, has_hierarchy)), has_tables.cast("int")) / 4.0
    return flags * 0.4 + (table_quality + form_quality + layout_quality) / 3 * 0.6


def coverage(text_length: Column, n_tables: Column, n_forms: Column) -> Column:
    """Mean of what is there: the text by length up to 1000, tables and forms by number up to five; 0.5 if nothing is."""
    parts = [F.when(text_length > 0, F.least(text_length / 1000.0, F.lit(1.0)))] + [F.when(n > 0, F.least(n / 5.0, F.lit(1.0))) for n in (n_tables, n_forms)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n).otherwise(0.5)


def completeness(has_text: Column, has_structured: Column, has_metadata: Column, covered: Column) -> Column:
    return (has_text.cast("int") + has_structured.cast("int") + has_metadata.cast("int")) / 3.0 * 0.7 + covered * 0.3


def consistency(text: Column, bbox_uniform: Column, keys_shared: Column, strict_encoding: bool = False) -> Column:
    """Mean of four checks. As documented for the original, the encoding check fails for any text that is not empty;
    ``strict_encoding`` gives the evident intent instead: it fails for texts with U+FFFD."""
    encoding = ~text.contains("�") if strict_encoding else F.length(F.coalesce(text, F.lit(""))) == 0
    return (F.coalesce(encoding, F.lit(True)).cast("int") + bbox_uniform.cast("int") + keys_shared.cast("int") + 1) / 4.0


def overall(scores: dict[str, Column]) -> Column:
    """Weighted mean over the scores given, weights made to sum to one."""
    total = sum(WEIGHTS[k] for k in scores)
    out = F.lit(0.0)
    for k in WEIGHTS:
        if k in scores:
            out = out + scores[k] * WEIGHTS[k]
    return out / total


# Advice by what is found.
ADVICE = {
    "text": "Consider using advanced OCR engines (TrOCR) for better text recognition", "artifacts": "High OCR artifacts detected - consider image preprocessing", "structure": "Consider using Table Transformer for better structure extraction",
    "confidence": "Low confidence scores - consider manual review of results", "image": "Poor image quality detected - consider image enhancement", "low": "Overall quality is low - consider using advanced extraction features",
    "high": "High quality extraction - results are reliable", "none": "Extraction quality appears acceptable",
}


def recommendations(text: Column, artifacts: Column, structure: Column, average: Column, image: Column, total: Column) -> Column:
    """Sentences of advice in this order; a part that is null was not assessed."""
    found = F.array_compact(
        F.array(
            F.when(text < 0.5, ADVICE["text"]), F.when(artifacts > 0.1, ADVICE["artifacts"]), F.when(structure < 0.5, ADVICE["structure"]), F.when(average < 0.6, ADVICE["confidence"]),
            F.when(image < 0.5, ADVICE["image"]), F.when(total < 0.4, ADVICE["low"]).when(total > 0.8, ADVICE["high"]),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit(ADVICE["none"]))).otherwise(found)


def image_score(laplacian: Column, deviation: Column, noise: Column, short_side: Column) -> Column:
    """Score of an image from its statistics: sharpness, contrast, noise and resolution."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    size = F.when(short_side >= 2000, 1.0).when(short_side >= 1000, 0.8).when(short_side >= 500, 0.5).otherwise(F.greatest(F.lit(0.2), short_side / 500.0))
    return 0.35 * unit(laplacian / 500.0) + 0.25 * unit(deviation / 75.0) + 0.2 * unit(1 - noise / 30.0) + 0.2 * size


def image_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def image_pipeline(level: Column) -> Column:
    return F.when(level == "high", "fast").when(level == "medium", "enhanced").otherwise("vlm")


def brightness_score(mean: Column, deviation: Column, laplacian: Column, noise: Column) -> Column:
    """Mean of brightness around the middle, contrast, sharpness and freedom from noise, for images given by statistics."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return (unit(1 - F.abs(mean - 128) / 128.0) + unit(deviation / 64.0) + unit(laplacian / 1000.0) + unit(1 - noise / 50.0)) / 4


def transcript_confidence(c: Column) -> Column:
    """Confidence of a transcript: 0.8, less for short texts, artifacts and few letters."""
    out = F.lit(0.8) * F.when(F.length(c) < 3, 0.7).otherwise(1.0)
    for sign in ("|||", "___", "...", "???"):
        out = out * F.when(c.contains(sign), 0.6).otherwise(1.0)
    return out * F.when(alpha_ratio(c) < 0.3, 0.7).otherwise(1.0)


def vision_confidence(c: Column) -> Column:
    """Confidence of a vision model's reading: 0.85, less for unclear places, short texts and few letters."""
    unclear = (F.length(c) - F.length(F.replace(F.lower(c), F.lit("[unclear]"), F.lit("")))) / 9
    out = (0.85 - 0.1 * F.least(unclear, F.lit(3.0))) * F.when(F.length(c) < 10, 0.8).otherwise(1.0) * F.when(alpha_ratio(c) < 0.2, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), out))


# Phrases of doubt and words for elements in a model's answer.
UNCERTAIN = ["i'm not sure", "unclear", "difficult to determine", "cannot see clearly", "appears to be", "seems like"]
ELEMENTS = "table form header footer paragraph list bullet number date signature".split()


def answer_confidence(c: Column) -> Column:
    """Confidence of a model's answer: by length, doubt and elements named; empty 0."""
    low = F.lower(c)
    out = F.lit(0.8) * F.when(F.length(c) < 20, 0.6).when(F.length(c) > 200, 1.1).otherwise(1.0)
    for phrase in UNCERTAIN:
        out = out * F.when(low.contains(phrase), 0.8).otherwise(1.0)
    named = F.lit(0)
    for w in ELEMENTS:
        named = named + low.contains(w).cast("int")
    out = out * F.when(named > 2, 1.1).otherwise(1.0)
    return F.when(F.length(F.trim(c)) == 0, 0.0).otherwise(F.least(F.lit(1.0), out))
