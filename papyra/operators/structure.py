"""Section structure of documents from their text blocks: element types, heading hierarchy, references, contents.

Blocks have doc_id, block_ord, text, page, x1, y1, x2, y2, font_size, is_bold; order within a document is (page, y1, block_ord).
Windows run over a page of a document; what they need from earlier pages is carried by one row a page, so a large document
is no single group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import WORD, WS, strip

LEVELS = 6
# List bullets and footnote marks.
BULLETS = "•◦▪▫⁃⦿⦾⟡⟢⟣⟤⟥-–—"
FOOTNOTE = r"^(?:[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§]|\[[0-9]+\]|\([0-9]+\)|[0-9]+\.|\*+)"
REFERENCES = {"section": r"[Ss]ection\s+([0-9]+(?:\.[0-9]+)*)", "figure": r"[Ff]igure\s+([0-9]+(?:\.[0-9]+)*)", "table": r"[Tt]able\s+([0-9]+(?:\.[0-9]+)*)"}


def heading_level(text: Column, size: Column, bold: Column) -> Column:
    """Level 1 to 6 of a heading, 0 for none: by number, by font, or bold and short with a colon or full stop at the end."""
    t = F.coalesce(text, F.lit(""))
    s, b = F.coalesce(size, F.lit(0)), F.coalesce(bold, F.lit(False))
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    font = s > 0
    return (
        F.when(strip(t) == "", 0).when(t.rlike(rf"^(?:[0-9]+\.)+[0-9]*{WS}+{WORD}"), F.least(dots, F.lit(LEVELS)))
        .when(font & (s > 18) & b, 1).when(font & (s > 16) & b, 2).when(font & (s > 14), 3).when(font & (s > 12) & b, 4).when(font & b, 5)
        .when((F.length(t) < 100) & strip(t).rlike("[:.]$") & b, 6).otherwise(0)
    )


def list_marker(text: Column) -> Column:
    """Struct (list_type, marker) of a list item, null for none. Levels are always 0, as in the original."""
    t = F.coalesce(text, F.lit(""))
    number = F.regexp_extract(t, rf"^({WS}*(?:[0-9]+\.|\([a-zA-Z0-9]+\)|[a-zA-Z0-9]+[.)])){WS}+", 1)
    make = lambda kind, m: F.struct(F.lit(kind).alias("list_type"), m.alias("marker"))
    return F.when(strip(t) == "", F.lit(None)).when(F.instr(F.lit(BULLETS), F.substring(t, 1, 1)) > 0, make("bulleted", F.substring(t, 1, 1))).when(number != "", make("numbered", strip(number)))


def footnote_mark(text: Column, y1: Column) -> Column:
    """The mark of a footnote in the lowest fifth of the page, null for none."""
    return F.when((y1 > 0.8) & (strip(text) != ""), F.nullif(F.regexp_extract(text, f"^({FOOTNOTE[1:]})", 1), F.lit("")))


def elements(blocks: DataFrame) -> DataFrame:
    """Adds element_type, level, confidence and element_id: heading before list item before footnote before paragraph."""
    level = heading_level(F.col("text"), F.col("font_size"), F.col("is_bold"))
    item, note = list_marker(F.col("text")), footnote_mark(F.col("text"), F.col("y1"))
    kind = F.when(level > 0, "heading").when(item.isNotNull(), "list_item").when(note.isNotNull(), "footnote").otherwise("paragraph")
    out = blocks.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumns({"element_type": kind, "level": F.when(level > 0, level).otherwise(0)})
    sure = F.when(F.col("element_type") == "heading", 0.9).when(F.col("element_type") == "paragraph", 0.7).otherwise(0.8)
    return out.withColumns({"confidence": sure, "element_id": F.concat_ws("_", "element_type", "block_ord")})


def heading_parents(found: DataFrame) -> DataFrame:
    """Adds parent_element: of a heading the nearest heading before with a smaller level, of others the nearest before."""
    at = F.struct("page", "y1", "block_ord", "element_id")
    here = Window.partitionBy("doc_id", "page").orderBy("y1", "block_ord").rowsBetween(Window.unboundedPreceding, -1)
    of_level = lambda k: F.when((F.col("element_type") == "heading") & (F.col("level") == k), at)
    local = found.select("*", *[F.last(of_level(k), ignorenulls=True).over(here).alias(f"_h{k}") for k in range(1, LEVELS + 1)])
    pages = found.groupBy("doc_id", "page").agg(*[F.max(of_level(k)).alias(f"_p{k}") for k in range(1, LEVELS + 1)])
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carry = pages.select(F.col("doc_id").alias("_d"), F.col("page").alias("_pg"), *[F.last(f"_p{k}", ignorenulls=True).over(before).alias(f"_c{k}") for k in range(1, LEVELS + 1)])
    both = local.join(carry, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_pg")))
    nearest = [F.coalesce(f"_h{k}", f"_c{k}") for k in range(1, LEVELS + 1)]
    above = F.greatest(*nearest)
    smaller = F.when(F.col("level") <= 1, F.lit(None))
    for level in range(2, LEVELS + 1):
        smaller = smaller.when(F.col("level") == level, F.greatest(*nearest[: level - 1]) if level > 2 else nearest[0])
    parent = F.when(F.col("element_type") == "heading", smaller).otherwise(above)
    return both.select(*found.columns, parent["element_id"].alias("parent_element"))


def children(parents: DataFrame) -> DataFrame:
    """(doc_id, element_id, child_ids) of elements with children, in reading order."""
    kids = parents.filter("parent_element is not null").groupBy("doc_id", F.col("parent_element").alias("element_id"))
    return kids.agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "y1", "block_ord", F.col("element_id").alias("kid")))), lambda x: x["kid"]).alias("child_ids"))


def references(found: DataFrame) -> DataFrame:
    """(doc_id, element_id, kind, number, target): references to sections, figures and tables that exist; the last target holds."""
    start = F.col("text")
    number = lambda p: F.nullif(F.regexp_extract(start, p, 1), F.lit(""))
    own = [
        ("section", F.when(F.col("element_type") == "heading", number(r"^([0-9]+(?:\.[0-9]+)*)\s+"))),
        ("table", F.when((F.col("element_type") == "paragraph") & F.lower("text").startswith("table "), number("^" + REFERENCES["table"]))),
        ("figure", F.when((F.col("element_type") == "paragraph") & F.lower("text").startswith("figure "), number("^" + REFERENCES["figure"]))),
    ]
    targets = found.select(F.col("doc_id").alias("t_doc"), F.struct("page", "y1", "block_ord").alias("at"), "element_id", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("number")) for k, n in own]), lambda x: x["number"].isNotNull())).alias("t"))
    targets = targets.groupBy("t_doc", F.col("t.kind").alias("t_kind"), F.col("t.number").alias("t_number")).agg(F.max_by("element_id", "at").alias("target"))

    def numbers(kind: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(REFERENCES[kind]), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))

    named = F.flatten(F.array(*map(numbers, REFERENCES)))
    refs = found.select("doc_id", "element_id", F.explode(named).alias("r")).select("doc_id", "element_id", "r.kind", "r.number")
    same = (F.col("doc_id") == F.col("t_doc")) & (F.col("kind") == F.col("t_kind")) & (F.col("number") == F.col("t_number"))
    return refs.join(targets, same).select("doc_id", "element_id", "kind", "number", "target")


def contents(found: DataFrame) -> DataFrame:
    """(doc_id, element_id, number, title, page_number, heading): entries of the table of contents with the heading they name."""
    at = F.struct("page", "y1", "block_ord")
    head = (F.col("element_type") == "heading") & F.lower("text").rlike("content|toc")
    begins = found.filter(head).groupBy(F.col("doc_id").alias("c_doc")).agg(F.min(at).alias("c_at"))
    after = found.join(begins, F.col("doc_id") == F.col("c_doc")).filter(at > F.col("c_at"))
    ends = after.filter("element_type = 'heading' and level <= 2 and level > 0").groupBy(F.col("doc_id").alias("e_doc")).agg(F.min(at).alias("e_at"))
    inside = after.join(ends, F.col("doc_id") == F.col("e_doc"), "left").filter(F.col("e_at").isNull() | (at < F.col("e_at")))
    entry = r"^([0-9]+(?:\.[0-9]+)*)\s+(.*?)\.{2,}\s*([0-9]+)$"
    part = lambda i: F.regexp_extract("text", entry, i)
    entries = inside.filter(part(1) != "").select("doc_id", "element_id", part(1).alias("number"), F.trim(part(2)).alias("title"), part(3).cast("int").alias("page_number"))
    # a heading that begins with the entry begins with its number and a blank, so the two meet on the number
    first = F.substring_index("text", " ", 1)
    heads = found.filter("element_type = 'heading'").select(F.col("doc_id").alias("h_doc"), first.alias("h_first"), F.col("text").alias("h_text"), at.alias("h_at"), F.col("element_id").alias("h_id"))
    joined = entries.join(heads, (F.col("doc_id") == F.col("h_doc")) & (F.col("number") == F.col("h_first")) & F.col("h_text").startswith(F.concat_ws(" ", "number", "title")), "left")
    return joined.groupBy("doc_id", "element_id", "number", "title", "page_number").agg(F.min_by("h_id", "h_at").alias("heading"))
