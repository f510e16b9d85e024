"""Cleaning, normalising and filtering of text, as column expressions (inside whole-stage codegen, no Python workers).

Null text gives null unless stated otherwise; empty text gives empty text, and ratios of empty text are 0. Patterns spell out
their classes, as the regular expressions of Java are ASCII by default: letters ``\\p{L}``, word characters letters, numbers
and the underscore, white space as in Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Thresholds of readability.
MIN_LENGTH, MIN_ALPHA, MAX_GARBAGE, MIN_WORDS = 10, 0.5, 0.1, 3
MAX_CID, MAX_CID_RATIO = 10, 0.1
# Field names by the kind of normalisation they take.
DATE_FIELDS = "birth_date date_of_birth dob arrival_date date_of_arrival admit_until_date expiration_date processing_date issue_date".split()
NAME_FIELDS = "first_name last_name full_name given_name surname middle_name".split()
DOCUMENT_FIELDS = "document_number i94_number i94_record_number admission_number passport_number".split()
CLASS_FIELDS = ["class_of_admission"]
COUNTRY_FIELDS = "country_of_citizenship country nationality passport_country country_of_issuance".split()


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of the values, each of which is computed once however often ``f`` uses it, also within conditions."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def removed(c: Column, pattern: str) -> Column:
    """Number of characters that a pattern of one character matches; they are taken off run by run."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{pattern}+", ""))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.when(whole.isNotNull(), F.lit(0.0)))


def letters(c: Column) -> Column:
    return removed(c, r"\p{L}")


def alpha_ratio(c: Column) -> Column:
    return ratio(letters(c), F.length(c))


def tokens(c: Column) -> Column:
    """Number of tokens between white space."""
    return F.regexp_count(c, F.lit(f"{NOT_WS}+"))


def token_list(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Parts between full stops, empty ones kept."""
    return F.split(c, r"\.")


def cid_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\(cid:[0-9]+\)"))


def clean_cid_codes(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"\(cid:[0-9]+\)", ""))


def clean_ocr_artifacts(c: Column) -> Column:
    for pattern in (r"\|{2,}", "_{3,}", "~{2,}", "`{2,}", r"\^{2,}", r"\\{2,}"):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, rf"{WS}+[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x85\p{{Z}}]{WS}+", " ")
    return collapse(c)


def clean_special_characters(c: Column, keep_punctuation: bool = True) -> Column:
    kept = r"[^a-zA-Z0-9\t-\r\x1c-\x20\x85\p{Z}.,!?;:\-'\"()\[\]{}]" if keep_punctuation else r"[^a-zA-Z0-9\t-\r\x1c-\x20\x85\p{Z}]"
    return collapse(F.regexp_replace(c, f"{kept}+", ""))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, " +", " "), r"\n{3,}", "\n\n"))


def clean_extracted_text(c: Column, cid: bool = True, artifacts: bool = True, special: bool = False, whitespace: bool = True, min_alpha: float | None = None) -> Column:
    """Struct of the cleaned text and what was done; a step is listed if it shortened the text (the first if it found codes)."""
    steps = [(wanted, name, step) for wanted, name, step in (
        (cid, "cid_codes", clean_cid_codes), (artifacts, "ocr_artifacts", clean_ocr_artifacts), (special, "special_characters", clean_special_characters), (whitespace, "whitespace", normalize_whitespace),
    ) if wanted]

    def done(raw: Column, texts: list[Column], codes: Column) -> Column:
        text = texts[-1]
        did = [F.when(codes > 0 if name == "cid_codes" else F.length(after) < F.length(before), F.lit(name)) for (_, name, _), before, after in zip(steps, [raw, *texts], texts)]
        before, now = F.length(raw), F.length(text)
        fields = [
            text.alias("text"), before.alias("original_length"), now.alias("cleaned_length"), (before - now).alias("removed"),
            F.when(before > 0, (before - now) * 100.0 / before).otherwise(0.0).alias("reduction_percent"), codes.alias("cid_codes"),
            alpha_ratio(raw).alias("alpha_before"), alpha_ratio(text).alias("alpha_after"), F.array_compact(F.array(*did)).alias("steps"),
        ]
        if min_alpha is not None:
            fields.append(is_garbage_text(text, min_alpha).alias("garbage"))
        return F.struct(*fields)

    def go(raw: Column, codes: Column, texts: list[Column]) -> Column:
        if len(texts) == len(steps):
            return done(raw, texts or [raw], codes)
        return let(lambda p: go(raw, codes, [*texts, p["t"]]), t=steps[len(texts)][2](texts[-1] if texts else raw))

    return let(lambda p: go(p["raw"], p["codes"], []), raw=F.coalesce(c, F.lit("")), codes=cid_count(F.coalesce(c, F.lit(""))) if cid else F.lit(0))


def is_garbage_text(c: Column, min_alpha: float = 0.5) -> Column:
    """Null, under three characters, or too few letters."""
    return c.isNull() | (F.length(strip(c)) < 3) | (alpha_ratio(c) < min_alpha)


def garbage_ratio(c: Column) -> Column:
    return ratio(removed(c, r"[<>;()\[\]{}@#$%^&*]"), F.length(c))


def is_readable_text(c: Column) -> Column:
    """Long enough, mostly letters, few stray signs and three words of three letters; null is not readable."""
    words = F.regexp_count(c, F.lit(r"\p{L}{3,}"))
    good = (F.length(c) >= MIN_LENGTH) & (alpha_ratio(c) >= MIN_ALPHA) & (garbage_ratio(c) <= MAX_GARBAGE) & (words >= MIN_WORDS)
    return F.coalesce(good, F.lit(False))


def validate_text_quality(c: Column) -> Column:
    return F.struct(
        F.coalesce(F.length(strip(c)) >= MIN_LENGTH, F.lit(False)).alias("valid"), F.coalesce(alpha_ratio(c), F.lit(0.0)).alias("alpha_ratio"), is_readable_text(c).alias("readable")
    )


def needs_cid_repair(c: Column) -> Column:
    """Whether so many characters are missing from the font's table that another extractor should be tried."""
    n = (F.length(c) - F.length(F.replace(c, F.lit("(cid:"), F.lit("")))) / 5
    return F.coalesce((n > MAX_CID) & (n / (F.length(c) / 100.0) > MAX_CID_RATIO), F.lit(False))


def extract_valid_name(c: Column, min_alpha: float = 0.7) -> Column:
    """The text cleaned as a name, or null if it cannot be one."""
    t = clean_special_characters(c)
    digits = removed(t, "[0-9]")
    return F.when(is_garbage_text(t, min_alpha) | (F.length(t) < 2) | (digits == F.length(t)) | (digits > 0.3 * F.length(t)), F.lit(None)).otherwise(t)


def average_word_length(c: Column) -> Column:
    """Mean length of the tokens."""
    return ratio(F.length(c) - removed(c, WS), tokens(c))


def text_quality(c: Column) -> Column:
    """Score from 0 to 1: mean of five features of the text."""

    def score(m: Column) -> Column:
        n = m["n"]
        space, special, word = ratio(m["blanks"], n), ratio(m["special"], n), ratio(n - m["blanks"], m["words"])
        parts = [
            F.least(ratio(m["letters"], n) / 0.8, F.lit(1.0)), F.when(space < 0.3, F.least(space / 0.15, F.lit(1.0))).otherwise(0.5), F.lit(1.0) - F.least(special / 0.1, F.lit(1.0)),
            F.when(word.between(3, 8), 1.0).otherwise(0.5), F.when(m["codes"] == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - m["codes"] / 100.0)),
        ]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return F.when(n > 0, total / 5).otherwise(F.lit(0.0))

    return let(score, n=F.length(c), blanks=removed(c, WS), special=removed(c, r"[^\p{L}\p{N}\t-\r\x1c-\x20\x85\p{Z}]"), letters=letters(c), words=tokens(c), codes=cid_count(c))


def quality_class(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def normalize_ocr_spacing(c: Column) -> Column:
    """Blanks that scanners put between single letters, digits and around dates taken out."""
    c = F.regexp_replace(c, r"(?U)\b([A-Z])\s+(?=[A-Z]\b)", "$1")
    c = F.regexp_replace(c, r"(?U)(\d)\s+(?=\d)", "$1")
    c = F.regexp_replace(c, r"(?U)(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{2,4})", "$1/$2/$3")
    c = F.regexp_replace(c, r"(?U)(\d{1,2})\s*-\s*(\d{1,2})\s*-\s*(\d{2,4})", "$1-$2-$3")
    c = F.regexp_replace(c, r"(?U)([A-Z])\s+(\d)", "$1$2")
    c = F.regexp_replace(c, r"(?U)(\d)\s+([A-Z])", "$1$2")
    return strip(c)


def extract_date(c: Column) -> Column:
    """The date of the first pattern that matches and is valid, as DATE; of each pattern only the first match is tried."""
    t = normalize_ocr_spacing(c)

    def of(pattern: str, year: int, month: int, day: int, century: bool = False) -> Column:
        y = F.regexp_extract(t, pattern, year)
        if century:
            y = F.concat(F.when(y.try_cast("int") <= 50, "20").otherwise("19"), y)
        parts = [y, F.lpad(F.regexp_extract(t, pattern, month), 2, "0"), F.lpad(F.regexp_extract(t, pattern, day), 2, "0")]
        return F.when(F.regexp_extract(t, pattern, 0) != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))

    return F.coalesce(
        of(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3, 1, 2), of(r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", 3, 2, 1), of(r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", 1, 2, 3),
        of(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})(?![0-9])", 3, 1, 2, True), of(r"(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{4})(?![0-9])", 3, 1, 2),
    )


def normalize_document_number(c: Column) -> Column:
    return F.nullif(F.regexp_replace(normalize_ocr_spacing(c), WS, ""), F.lit(""))


def normalize_class_of_admission(c: Column) -> Column:
    t = normalize_ocr_spacing(c)
    m = lambda i: F.regexp_extract(t, r"^([A-Z])([0-9]+)([A-Z]?)$", i)
    return F.when(m(0) != "", F.concat(m(1), F.lit("-"), m(2), m(3))).otherwise(t)


def normalize_name(c: Column) -> Column:
    return F.upper(collapse(normalize_ocr_spacing(c)))


def normalize_fields(fields: dict[str, Column]) -> dict[str, Column]:
    """Normal forms of named fields by the kind their name tells; empty values are left out of the result as null."""
    out = {}
    for name, c in fields.items():
        if name in DATE_FIELDS:
            new = F.date_format(extract_date(c), "yyyy-MM-dd")
        elif name in NAME_FIELDS or name in COUNTRY_FIELDS:
            new = normalize_name(c)
        elif name in DOCUMENT_FIELDS:
            new = normalize_document_number(c)
        elif name in CLASS_FIELDS:
            new = normalize_class_of_admission(c)
        else:
            new = c
        out[name] = F.when(c != "", new)
    return out


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“” ", "''\"\" ")


def clean_text_for_json(c: Column, preserve: bool = True) -> Column:
    """One line, or with ``preserve`` one for each line of each paragraph, paragraphs parted by an empty line."""
    t = straight_quotes(c)
    if not preserve:
        return collapse(t)
    paragraphs = F.transform(F.split(t, "\n\n"), lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), collapse), lambda x: x != ""), "\n"))
    return F.array_join(F.filter(paragraphs, lambda x: x != ""), "\n\n")


def wrap_form_text(c: Column, width: int = 80) -> Column:
    """Greedy wrapping of each line to ``width``; a list item ``a—`` begins ``a — `` and goes on with four blanks."""
    item = r"^([a-z]{1,2})—[ \t]*"

    def wrap(line: Column) -> Column:
        lead = F.regexp_extract(line, item, 1)
        is_item = lead != ""
        body = F.when(is_item, F.concat(lead, F.lit(" — "), F.regexp_replace(line, item, ""))).otherwise(line)
        words = F.filter(F.split(body, " +"), lambda x: x != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(s: Column, w: Column) -> Column:
            fits = (s["now"] == "") | (F.length(s["now"]) + 1 + F.length(w) <= width)
            gap = F.when(s["now"] == "", "").otherwise(" ")
            fresh = F.when(is_item, F.concat(F.lit("    "), w)).otherwise(w)
            return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits, F.concat(s["now"], gap, w)).otherwise(fresh).alias("now"))

        return F.aggregate(words, start, step, lambda s: F.array_join(F.concat(s["done"], F.array(s["now"])), "\n"))

    return F.array_join(F.transform(F.split(c, "\n"), lambda x: wrap(strip(x))), "\n")


def unicode_cleanup(c: Column) -> Column:
    t = F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("--"))
    return collapse(straight_quotes(t))


def ocr_character_fixes(c: Column, where: str = "cell") -> Column:
    """Substitutions of look-alikes for table cells, transcripts or handwriting; they destroy right text, so none is a default."""
    if where == "cell":
        return F.translate(c, "lO", "10")
    if where == "transcript":
        return F.translate(c, "0", "O")
    if where == "handwriting":
        t = F.translate(c, "l", "1")
        return F.when(t.rlike("[0-9]"), F.translate(t, "OS", "05")).otherwise(t)
    raise ValueError(f"no such use: {where}")


def first_json_object(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` if it is valid JSON, else null."""
    cut = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(cut).isNotNull() & (cut != ""), cut)


def key_value(c: Column) -> Column:
    """Struct (key, value, confidence) of a text with a colon (.9) or else an equals sign (.8); null without either."""

    def at(sign: str, sure: float) -> Column:
        i = F.instr(c, sign)
        return F.struct(strip(F.substr(c, F.lit(1), i - 1)).alias("key"), strip(F.substr(c, i + 1)).alias("value"), F.lit(sure).alias("confidence"))

    return F.when(F.instr(c, ":") > 0, at(":", 0.9)).when(F.instr(c, "=") > 0, at("=", 0.8))


def form_keyword(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("check|select|choose|click"), F.lit(False))


def paragraphs(c: Column) -> Column:
    """Text with its paragraphs stripped, empty ones dropped, parted by one empty line."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != ""), "\n\n")


def json_text(c: Column) -> Column:
    """Text for JSON output: dashes and quotes made plain, stripped, empty to null."""
    t = F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("--"))
    return F.nullif(strip(straight_quotes(t)), F.lit(""))


def json_number(c: Column) -> Column:
    """A number for JSON output: NaN and infinities to null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
