"""Rule-based classes of documents: signals, decision, key indicators, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import WS

# Patterns of each class, on lower-case text.
PATTERNS = {
    "tax_form_1040": [r"form\s+1040", r"u\.?s\.?\s+individual\s+income\s+tax\s+return", r"department\s+of\s+the\s+treasury", r"internal\s+revenue\s+service", r"adjusted\s+gross\s+income", r"taxable\s+income", r"filing\s+status"],
    "tax_form_w2": [r"form\s+w-?2", r"wage\s+and\s+tax\s+statement", r"employer\s+identification\s+number", r"wages,?\s+tips,?\s+other\s+compensation", r"federal\s+income\s+tax\s+withheld"],
    "tax_form_1099": [r"form\s+1099", r"miscellaneous\s+income", r"nonemployee\s+compensation", r"payer\s+information", r"recipient\s+information"],
    "bank_statement": [r"bank\s+statement", r"account\s+summary", r"beginning\s+balance", r"ending\s+balance", r"deposits?\s+and\s+credits?", r"withdrawals?\s+and\s+debits?", r"statement\s+period"],
    "credit_card_statement": [r"credit\s+card\s+statement", r"account\s+number", r"payment\s+due\s+date", r"minimum\s+payment", r"previous\s+balance", r"new\s+balance", r"available\s+credit"],
    "invoice": ["invoice", r"bill\s+to", r"invoice\s+number", r"due\s+date", r"amount\s+due", "subtotal", r"total\s+amount"],
    "receipt": ["receipt", r"thank\s+you\s+for\s+your\s+purchase", r"transaction\s+id", r"items?\s+purchased", r"total\s+paid", r"change\s+due"],
    "contract": ["contract", "agreement", r"terms\s+and\s+conditions", r"party\s+of\s+the\s+first\s+part", "whereas", r"in\s+consideration\s+of", "signature"],
    "legal_contract": [r"legal\s+contract", "attorney", r"law\s+firm", r"legal\s+counsel", "jurisdiction", r"governing\s+law", r"dispute\s+resolution"],
    "medical_record": [r"medical\s+record", r"patient\s+name", r"date\s+of\s+birth", "diagnosis", "treatment", "physician", r"medical\s+history"],
    "research_paper": ["abstract", "introduction", "methodology", "results", "conclusion", "references", "bibliography"],
    "passport": ["passport", r"united\s+states\s+of\s+america", "nationality", r"place\s+of\s+birth", r"date\s+of\s+issue", r"date\s+of\s+expiration"],
}
# Words, phrases and formats of the other signals.
KEYWORDS = {"financial": ("tax income payment amount total balance account".split(), 100), "legal": ("contract agreement terms conditions party whereas".split(), 50), "medical": ("medical patient diagnosis treatment doctor physician".split(), 30)}
PHRASES = {
    "tax": ["adjusted gross income", "taxable income", "filing status", "standard deduction", "itemized deduction", "tax liability"],
    "financial": ["account balance", "transaction history", "interest rate", "payment due", "credit limit", "available balance"],
    "legal": ["terms and conditions", "party of the first part", "in consideration of", "governing law", "dispute resolution", "force majeure"],
}
FORMATS = {"ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.9), "ein": (r"[0-9]{2}-[0-9]{7}", 0.8), "currency": (r"\$[0-9,]+\.?[0-9]*", 0.7), "dates": (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", 0.5)}
_ACCOUNTS = ["Extract transaction history and account balances", "Validate account numbers and amounts"]
SUGGESTIONS = {
    "tax_form_1040": ["Consider extracting tax fields: income, deductions, tax liability", "Validate SSN and EIN formats"], "bank_statement": _ACCOUNTS, "credit_card_statement": _ACCOUNTS,
    "invoice": ["Extract invoice details: number, date, amounts, line items", "Validate payment terms and due dates"], "legal_contract": ["Extract parties, terms, and signature information", "Identify key clauses and obligations"],
}
UNSURE, FEW = "Low confidence classification - manual review recommended", "Limited classification signals - consider additional analysis"


def wide(pattern: str) -> str:
    """The pattern with ``\\s`` as the white space of all scripts, which Java's own does not cover."""
    return pattern.replace(r"\s", WS)


def longest_word(pattern: str) -> str:
    """The longest run of letters every match of the pattern contains: a letter before ``?`` is none of it."""
    bare = re.sub(r"\\[a-z]|[a-z]\?", " ", pattern)
    return max(re.findall("[a-z0-9]+", bare), key=len)


def pattern_signals(text: Column, low: Column | None = None) -> dict[str, Column]:
    """Share of each class's phrases that occur in the text. ``low`` is the text in lower case where a column holds it already;
    patterns without white space or choices are looked for as they are."""
    low = F.lower(text) if low is None else low
    # most texts lack a phrase's longest word, which is looked for first
    there = lambda p: F.coalesce(low.contains(p) if p.isalpha() else low.contains(longest_word(p)) & low.rlike(wide(p)), F.lit(False)).cast("int")
    return {name: sum((there(p) for p in ps[1:]), there(ps[0])) / float(len(ps)) for name, ps in PATTERNS.items()}


def structure_signals(text: Column, n_tables: Column, n_forms: Column, table_money: Column, tax_form: Column) -> dict[str, Column]:
    some = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v)
    return {
        "has_tables": F.when(n_tables > 0, F.least(n_tables / 10.0, F.lit(1.0))), "financial_tables": some(table_money, 0.8), "has_forms": F.when(n_forms > 0, F.least(n_forms / 20.0, F.lit(1.0))),
        "tax_forms": some(tax_form, 0.9), "long_document": some(F.size(F.split(text, "\n")) > 50, 0.7), "has_signatures": some(F.lower(text).rlike("signature|signed|date.*signed"), 0.6),
    }


def financial_tables(tables: Column) -> Column:
    """Whether an amount in dollars stands in the first five rows of the first three tables (arrays of rows of texts)."""
    return F.exists(F.slice(tables, 1, 3), lambda t: F.exists(F.slice(t, 1, 5), lambda r: F.exists(r, lambda x: F.coalesce(x.rlike(r"\$[0-9,]+"), F.lit(False)))))


def tax_forms(forms: Column) -> Column:
    """Whether the first ten forms (as texts) speak of taxes or of numbers of taxpayers."""
    return F.lower(F.array_join(F.slice(forms, 1, 10), " ")).rlike(wide(r"(ssn|social\s+security|ein|tax)"))


def signal_count(signals: list[Column]) -> Column:
    """How many signals were found: those that are neither null nor 0."""
    return sum((F.coalesce(c > 0, F.lit(False)).cast("int") for c in signals[1:]), F.coalesce(signals[0] > 0, F.lit(False)).cast("int"))


def keyword_signals(text: Column, low: Column | None = None) -> dict[str, Column]:
    """Occurrences of each family's words over a norm, at most 1; null for none."""
    low = F.lower(text) if low is None else low
    out = {}
    for name, (words, norm) in KEYWORDS.items():
        n = F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])"))
        out[name] = F.when(n > 0, F.least(n / float(norm), F.lit(1.0)))
    return out


def format_signals(text: Column, title: Column) -> dict[str, Column]:
    out = {f"has_{name}": F.when(text.rlike(p), v) for name, (p, v) in FORMATS.items()}
    low = F.lower(title)
    out["tax_in_title"] = F.when(low.rlike("tax|1040"), 0.9)
    out["invoice_in_title"] = F.when(~low.rlike("tax|1040") & low.contains("invoice"), 0.9)
    out["statement_in_title"] = F.when(~low.rlike("tax|1040|invoice") & low.contains("statement"), 0.8)
    return out


def semantic_signals(text: Column, low: Column | None = None) -> dict[str, Column]:
    low = F.lower(text) if low is None else low
    return {name: sum((low.contains(p).cast("int") for p in ps[1:]), low.contains(ps[0]).cast("int")) / float(len(ps)) for name, ps in PHRASES.items()}


def signal_type(signal: str) -> str | None:
    """The class a signal without a class of its own speaks for, by its name."""
    for part, name in (("tax", "tax_form_1040"), ("financial", "bank_statement"), ("legal", "legal_contract"), ("medical", "medical_record")):
        if part in signal:
            return name
    return None


def decide(patterns: dict[str, Column], others: dict[str, Column]) -> Column:
    """Struct (document_type, confidence): patterns count twice, other signals once for the class their name tells.

    The highest score holds, the first class on ties; no score gives unknown with 0.
    """
    totals: dict[str, Column] = {name: F.coalesce(c, F.lit(0.0)) * 2 for name, c in patterns.items()}
    for signal, c in others.items():
        name = signal_type(signal)
        if name:
            totals[name] = totals.get(name, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, s) in enumerate(totals.items())]))
    return F.when(best["score"] > 0, F.struct(best["name"].alias("document_type"), F.least(best["score"] / 3, F.lit(1.0)).alias("confidence"))).otherwise(
        F.struct(F.lit("unknown").alias("document_type"), F.lit(0.0).alias("confidence"))
    )


def key_indicators(text: Column, kind: Column) -> Column:
    """Map of the indicators that are read for a class of document: numbers of taxpayers, accounts, invoices."""
    low = F.lower(text)
    found = lambda pattern, group, t=text: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    tax = kind.isin("tax_form_1040", "tax_form_w2")
    bank = kind.isin("bank_statement", "credit_card_statement")
    pairs = [
        ("ssn", F.when(tax, found(r"([0-9]{3}-[0-9]{2}-[0-9]{4})", 1))), ("ein", F.when(tax, found(r"([0-9]{2}-[0-9]{7})", 1))),
        ("account_number", F.when(bank, found(wide(r"account\s+(?:number|#)?\s*:?\s*([0-9]+)"), 1, low))), ("invoice_number", F.when(kind == "invoice", found(wide(r"invoice\s+(?:number|#)?\s*:?\s*([A-Za-z0-9-]+)"), 1, low))),
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def suggestions(kind: Column, confidence: Column, n_signals: Column) -> Column:
    parts = [F.when(confidence < 0.5, UNSURE)]
    for name, pair in SUGGESTIONS.items():
        parts += [F.when(kind == name, s) for s in pair]
    return F.array_compact(F.array(*parts, F.when(n_signals < 3, FEW)))


def simple_type(text: Column) -> Column:
    """Struct (document_type, confidence) by substrings, in this order."""
    low = F.lower(text)
    make = lambda name, v: F.struct(F.lit(name).alias("document_type"), F.lit(v).alias("confidence"))
    return (
        F.when(low.rlike("invoice|bill"), make("invoice", 0.8)).when(low.rlike("agreement|contract"), make("contract", 0.7)).when(low.rlike("resume|cv"), make("resume", 0.8))
        .when(low.contains("report"), make("report", 0.6)).when(low.contains("form"), make("form", 0.7)).otherwise(make("generic", 0.5))
    )


def block_type(text: Column, font_size: Column, bold: Column) -> Column:
    low = F.lower(text)
    digits = (F.length(text) < 5) & text.rlike(r"^[0-9]+$")
    return (
        F.when(bold & (font_size > 14), "heading").when(low.rlike("total|sum|amount|[$€£]"), "financial").when(low.rlike("date|time|schedule"), "temporal").when(digits, "numeric").otherwise("body_text")
    )
