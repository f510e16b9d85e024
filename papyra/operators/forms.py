"""Form fields: detection cascades, labels, groups and structure.

Annotations have doc_id, ord, page, subtype, field_type, x1..y2, value, radio, field_name, state, option_value, label, options;
blocks and lines are those of the other layout operators. Each detector gives FIELD_COLUMNS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import WS, strip

FIELD_COLUMNS = ["doc_id", "field_id", "field_type", "page", "x1", "y1", "x2", "y2", "label", "value", "options", "is_checked", "confidence", "group_id"]


# Fixed value: how far a label may be from its field.
REACH = 0.2


def _fields(df: DataFrame, prefix: str, kind: str, confidence: float, **given: Column) -> DataFrame:
    none = {"label": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "options": F.lit(None).cast("array<string>"), "is_checked": F.lit(None).cast("boolean"), "group_id": F.lit(None).cast("string")}
    cols = {**{c: F.col(c) for c in ("doc_id", "page", "x1", "y1", "x2", "y2")}, **none, "field_id": F.concat(F.lit(prefix), F.col("ord").cast("string")), "field_type": F.lit(kind), "confidence": F.lit(confidence), **given}
    return df.select(*[cols[c].alias(c) for c in FIELD_COLUMNS])


def cascade(*sources: DataFrame) -> DataFrame:
    """For each document the fields of the first source that has any."""
    out, seen = sources[0], sources[0].select("doc_id").distinct()
    for s in sources[1:]:
        fresh = s.join(seen, "doc_id", "left_anti")
        out, seen = out.unionByName(fresh), seen.unionByName(fresh.select("doc_id")).distinct()
    return out


def checkboxes(annotations: DataFrame, images: DataFrame, blocks: DataFrame) -> DataFrame:
    """From button annotations, else from boxes found in the image, else from box signs in the text."""
    buttons = annotations.filter("subtype = 'Widget' and field_type = 'Btn'")
    a = _fields(buttons, "checkbox_", "checkbox", 0.9, label=F.col("label"), is_checked=F.coalesce(F.col("value") == "/Yes", F.lit(False)))
    b = _fields(images, "checkbox_", "checkbox", 0.7, is_checked=F.col("is_checked"))
    signs = blocks.filter(F.col("text").rlike(r"□|☐|\[ \]|\[x\]|\[X\]")).withColumn("ord", F.col("block_ord"))
    c = _fields(signs, "checkbox_", "checkbox", 0.6, label=F.col("text"), is_checked=F.col("text").rlike(r"\[x\]|\[X\]"))
    return cascade(a, b, c)


def radio_buttons(annotations: DataFrame) -> DataFrame:
    """One field a button, grouped by field name: the selected value, all options, and the place in the group as id."""
    r = annotations.filter("field_type = 'Btn' and radio")
    group, order = Window.partitionBy("doc_id", "field_name"), Window.partitionBy("doc_id", "field_name").orderBy("ord")
    chosen = F.max(F.when(F.col("state").isNotNull() & (F.col("state") != "/Off"), F.col("option_value"))).over(group)
    options = F.transform(F.array_sort(F.collect_list(F.struct("ord", "option_value")).over(group)), lambda x: x["option_value"])
    r = r.withColumns({"_value": chosen, "_options": options, "_place": F.row_number().over(order) - 1})
    cols = _fields(r, "radio_", "radio", 0.9, value=F.col("_value"), options=F.col("_options"), is_checked=F.coalesce(F.col("option_value") == F.col("_value"), F.lit(False)), group_id=F.col("field_name"), field_id=F.concat_ws("_", F.lit("radio"), "field_name", F.col("_place").cast("string")))
    return cols


def text_fields(annotations: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """From text annotations, else from long horizontal lines, else from underscores, dots or wide gaps in the text."""
    a = _fields(annotations.filter("field_type in ('Tx', 'Ch')"), "text_", "text", 0.9, label=F.col("label"), value=F.col("value"))
    long = lines.filter((F.abs(F.col("y2") - F.col("y1")) < 0.01) & (F.col("x2") - F.col("x1") > 0.1))
    b = _fields(long, "text_", "text", 0.7, y1=F.col("y1") - 0.02, y2=F.col("y1") + 0.005, value=F.lit(""))
    marks = blocks.filter(F.col("text").rlike(r"___|\.\.\.|   ")).withColumn("ord", F.col("block_ord"))
    c = _fields(marks, "text_", "text", 0.6, label=F.regexp_replace(F.split("text", r"___|\.\.\.|   ")[0], f"[:{WS[1:-1]}]+$", ""))
    return cascade(a, b, c)


def signatures(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Signature annotations, and blocks that speak of signing with an x or a line; of these the place is below the block."""
    a = _fields(annotations.filter("field_type = 'Sig'"), "signature_", "signature", 0.9, label=F.col("label"))
    low = F.lower("text")
    spoken = blocks.filter(low.contains("sign") & (low.contains("x") | low.contains("_"))).withColumn("ord", F.col("block_ord"))
    b = _fields(spoken, "signature_t", "signature", 0.7, label=F.col("text"), y1=F.col("y2"), y2=F.col("y2") + 0.05)
    return a.unionByName(b)


def all_fields(*detected: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), detected)


def nearest_label(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fields with missing labels filled from the nearest block to the left or above on their page, within 0.2.

    Of equally near blocks the first holds; a colon at the end is taken off; a blank block gives no label. Places are cut into
    squares as wide as the greatest distance: a field meets only the blocks whose centre lies in its square or one beside it, so
    a page with many of both makes no pairs far apart.
    """
    want = fields.filter("label is null")
    b = blocks.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), "block_ord", F.col("text").alias("b_text"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    square = lambda low, high: F.floor((F.col(low) + F.col(high)) / 2 / REACH)
    b = b.withColumns({"b_sx": square("b_x1", "b_x2"), "b_sy": square("b_y1", "b_y2")})
    beside = lambda c: F.explode(F.sequence(c - 1, c + 1))
    want = want.withColumn("_sx", beside(square("x1", "x2"))).withColumn("_sy", beside(square("y1", "y2")))
    near = (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & (F.col("_sx") == F.col("b_sx")) & (F.col("_sy") == F.col("b_sy")) & ((F.col("b_x2") < F.col("x1")) | (F.col("b_y2") < F.col("y1")))
    dx, dy = (F.col("x1") + F.col("x2")) / 2 - (F.col("b_x1") + F.col("b_x2")) / 2, (F.col("y1") + F.col("y2")) / 2 - (F.col("b_y1") + F.col("b_y2")) / 2
    hits = want.join(b, near).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") < REACH)
    best = hits.groupBy("doc_id", "field_id").agg(F.min_by("b_text", F.struct("dist", "block_ord")).alias("found"))
    label = F.nullif(F.regexp_replace(F.regexp_replace(strip(F.col("found")), ":+$", ""), f"{WS}+$", ""), F.lit(""))
    best = best.select("doc_id", "field_id", label.alias("found"))
    out = fields.join(best, ["doc_id", "field_id"], "left").withColumn("label", F.coalesce("label", "found"))
    return out.select(*fields.columns)


def checkbox_groups(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields with group_id of checkboxes whose labels agree before a bracket, where more than one does."""
    main = strip(F.split("label", r"\[")[0])
    is_box = (F.col("field_type") == "checkbox") & (F.coalesce("label", F.lit("")) != "")
    n = F.count(F.when(is_box, 1)).over(Window.partitionBy(key, "_main"))
    out = fields.withColumn("_main", F.when(is_box, main)).withColumn("_n", n)
    return out.withColumn("group_id", F.when(is_box & (F.col("_n") > 1), F.concat(F.lit("checkbox_group_"), "_main")).otherwise(F.col("group_id"))).drop("_main", "_n")


def groups(fields: DataFrame, key: str = "doc_id", field: str = "field_id") -> DataFrame:
    """(key, group_id, fields, n): ids of the fields of each group, in order."""
    return fields.filter("group_id is not null").groupBy(key, "group_id").agg(F.array_sort(F.collect_list(field)).alias("fields"), F.count(F.lit(1)).alias("n"))


def form_structure(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: number of fields, numbers by type and by page as maps, signature, complexity."""
    by = lambda c: fields.filter(F.col(c).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    total = fields.groupBy(key).agg(F.count(F.lit(1)).alias("n_fields"), F.coalesce(F.bool_or(F.col("field_type") == "signature"), F.lit(False)).alias("has_signature"))
    total = total.withColumn("complexity", F.when(F.col("n_fields") < 5, "simple").when(F.col("n_fields") < 20, "moderate").otherwise("complex"))
    return total.join(by("field_type"), key, "left").join(by("page"), key, "left")
