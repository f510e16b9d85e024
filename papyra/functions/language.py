"""Heuristic language of a text by character classes, with seams for detectors and translators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import let, removed

_BLANK = r"\t-\r\x1c-\x20\x85\p{Z}"
# Character classes of the languages, in the order that decides ties.
CLASSES = {
    "en": f"a-zA-Z{_BLANK}", "es": f"a-zA-Zñáéíóúü{_BLANK}ÑÁÉÍÓÚÜ", "fr": f"a-zA-Zàâäéèêëïîôöùûüÿç{_BLANK}ÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ", "de": f"a-zA-Zäöüß{_BLANK}ÄÖÜ",
    "it": f"a-zA-Zàèéìíîòóùú{_BLANK}ÀÈÉÌÍÎÒÓÙÚ", "pt": f"a-zA-Záâãàéêíóôõúç{_BLANK}ÁÂÃÀÉÊÍÓÔÕÚÇ", "ru": f"а-яёА-ЯЁ{_BLANK}", "zh": "一-鿿", "ja": "぀-ゟ゠-ヿ一-鿿", "ko": "가-힯", "ar": "؀-ۿ", "hi": "ऀ-ॿ",
}
SUPPORTED = list(CLASSES)
# Languages by component.
DETECTION = "en es fr de it pt ru zh ja ko ar hi nl sv da no fi pl tr he".split()
PROCESSING = "en es fr de it pt zh ja ru nl".split()
TRANSLATION = [*DETECTION, *"th vi id ms tl sw am bn gu kn ml mr ne or pa si ta te ur".split()]
LEAST, UNSURE = 0.3, 0.5


def scores(m: Column) -> dict[str, Column]:
    """Share of the text in each class, from what ``measures`` gives. ASCII letters and blanks are in most classes, so they are
    counted once, and the letters of each class in the rest, which most texts have little of."""
    out = {}
    for code, cls in CLASSES.items():
        own = F.length(m["rest"]) - F.length(F.regexp_replace(m["rest"], f"[{cls}]+", ""))
        out[code] = (own + (m["common"] if cls.startswith("a-zA-Z") else m["blanks"] if _BLANK in cls else F.lit(0))) / m["n"]
    return out


def measures(c: Column) -> dict[str, Column]:
    """Length, ASCII letters and blanks, blanks alone, and what is neither ASCII nor blank."""
    return {"n": F.length(c), "common": removed(c, f"[a-zA-Z{_BLANK}]"), "blanks": removed(c, f"[{_BLANK}]"), "rest": F.regexp_replace(c, rf"[\x00-\x7f{_BLANK}]+", "")}


def detect(c: Column) -> Column:
    """Struct (language, confidence): the class with most of the text, the first on ties; under 0.3 English with 0.5.

    Null, empty and blank texts are unknown with 0.
    """
    ranked = lambda m: F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(code).alias("language")) for i, (code, s) in enumerate(scores(m).items())])
    best = let(lambda m: F.when(m["n"] > 0, F.array_max(ranked(m))), **measures(c))
    return let(lambda p: _answer(c, p["best"]), best=best)


def _answer(c: Column, best: Column) -> Column:
    found = F.when(best["score"] < LEAST, F.struct(F.lit("en").alias("language"), F.lit(UNSURE).alias("confidence"))).otherwise(F.struct(best["language"].alias("language"), best["score"].alias("confidence")))
    blank = c.isNull() | ~c.rlike(f"[^{_BLANK}]")
    return F.when(blank, F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))).otherwise(found)


def supported(detector: bool = False, processor: bool = False, translator: bool = False) -> dict[str, list[str]]:
    """Languages of each component that is there; a component without its library supports none."""
    return {"detection": DETECTION if detector else [], "processing": PROCESSING if processor else [], "translation": TRANSLATION if translator else []}


def dispatch(c: Column, method: str = "auto", detectors: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Struct (language, confidence, method, error) by the first detector there is, else by the heuristic.

    ``detectors`` are expressions by name (Pandas UDFs for libraries), in order of preference; each gives a struct (language,
    confidence). ``method`` auto takes the first; a name takes that one; heuristic the heuristic. Blank text is unknown with 0
    for any method, and so is a method that is not there; a detector that gives null has failed.
    """
    known = detectors or {}
    blank = c.isNull() | ~c.rlike(f"[^{_BLANK}]")
    chosen = method if method != "auto" else next(iter(known), "heuristic")
    answer = lambda lang, sure, by, error: F.struct(lang.alias("language"), sure.alias("confidence"), F.lit(by).alias("method"), error.alias("error"))
    unknown = lambda why: answer(F.lit("unknown"), F.lit(0.0), method, F.lit(why))
    if chosen == "heuristic":
        x = detect(c)
    elif chosen in known:
        x = known[chosen](c)
    else:
        return F.when(blank, unknown("Empty text")).otherwise(unknown(f"Method '{method}' not available"))
    found = answer(F.coalesce(x["language"], F.lit("unknown")), F.coalesce(x["confidence"].cast("double"), F.lit(0.0)), chosen, F.when(x.isNull(), "detection failed"))
    return F.when(blank, unknown("Empty text")).otherwise(found)


def translate(df: DataFrame, text: str, source: Column, target: str, translator: Callable[[Column, Column, str], Column] | None = None) -> DataFrame:
    """Adds translated_text and translation_confidence. Without a translator the text stays as it is, with confidence 0."""
    if translator is None:
        return df.withColumns({"translated_text": F.col(text), "translation_confidence": F.lit(0.0)})
    return df.withColumns({"translated_text": translator(F.col(text), source, target), "translation_confidence": F.lit(1.0)})
