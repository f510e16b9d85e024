"""Parent-child rows as full hierarchies: path, depth, root, subtree size, nested-set range, descendants and loops.

Depth is unknown and may be large, so nothing walks level by level. Every element keeps a pointer to the ancestor 2^k steps up;
a round joins the pointers with themselves and doubles the reach, so a tree of depth d takes about log2(d) rounds. Elements
whose pointer ran out are set aside: a round joins and writes only those still on their way, and looks the others up.

* Upward: the number of descendants less than 2^k steps below is summed into the element 2^k steps up; the sums of all rounds
  give the subtree sizes.
* Downward: among siblings, prefix sums of the sizes allot ranges; the preorder number of an element is the sum of the
  offsets on its way from the root, again by doubling.
* Elements whose pointer never runs out get neither size nor range: they stand on a loop or below one.

Rows are keyed by (document, id) throughout; a document is never gathered. Where many rows point to one ancestor, adaptive
execution splits the skewed side of the join; sums into one ancestor are pre-aggregated before the shuffle; siblings are cut
into ranges of ids by a sampled range partitioning before their prefix sums, so a family of any size is spread over tasks.
Each round is a table in the checkpoint folder, deleted when the next is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import discard, stored


def _present(c: Column) -> Column:
    return F.when(c.rlike(r"[^\s]"), c)


def resolve_parents(df: DataFrame, doc: str = "document_id", id: str = "id", parent: str = "parent_id", children: str = "children_ids") -> DataFrame:
    """(doc, id, parent): one row for each element with the parent that holds for it.

    The parent is ``parent`` if not null or blank, else the element of the same document whose ``children`` names this one
    (the smallest id if several do). Repeated rows count once; of rows with one key that differ, the smallest non-blank
    parent holds. A null document is a document of its own; a null id is an element no other can name.
    """
    own = df.select(F.col(doc).alias("doc"), F.col(id).alias("id"), _present(F.col(parent)).alias("p"), F.lit(None).cast("string").alias("n"), F.lit(True).alias("real"))
    named = df.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(children)).alias("c"), F.col(id).alias("n")).filter("c is not null and n is not null")
    named = named.select("doc", F.col("c").alias("id"), F.lit(None).cast("string").alias("p"), "n", F.lit(False).alias("real"))
    both = own.unionByName(named).groupBy("doc", "id").agg(F.min("p").alias("p"), F.min("n").alias("n"), F.max("real").alias("real"))
    return both.filter("real").select("doc", "id", F.coalesce("p", "n").alias("parent"))


def _up(state: DataFrame, table: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """``state`` with the given columns, prefixed with u_, of the element of ``table`` its pointer names."""
    u = table.select(F.col("doc").alias("u_doc"), F.col("id").alias("u_id"), *[F.col(c).alias(f"u_{c}") for c in columns])
    return state.join(u, F.col("doc").eqNullSafe(F.col("u_doc")) & (F.col("ptr") == F.col("u_id")), how)


def unending(nodes: DataFrame) -> DataFrame:
    """(doc, id, parent) of the elements from which going from parent to parent never ends, from (doc, id, parent).

    Those on their way only are joined with each other: an element whose pointer names a root, or nothing, is gone after the
    round. Depths have no gaps, so when a round loses none the rest are on loops or below them.
    """
    state = stored(nodes.filter("parent is not null").select("doc", "id", "parent", F.col("parent").alias("ptr")))
    n = state.count()
    while n:
        new = stored(_up(state, state, "ptr").select("doc", "id", "parent", F.col("u_ptr").alias("ptr")))
        discard(state)
        before, state = n, new
        n = state.count()
        if n == before:
            break
    return state.select("doc", "id", "parent")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(doc, id, parent, depth, root, size, looped) from (doc, id, parent): the upward phase.

    A parent that is no element of the document makes a root. looped elements are those not processed: on a loop or below
    one; their depth, root and size are null.
    """
    nodes = stored(nodes.select("doc", "id", "parent"))
    known = nodes.select(F.col("doc").alias("u_doc"), F.col("id").alias("u_id"), F.lit(True).alias("found"))
    first = nodes.join(known, F.col("doc").eqNullSafe(F.col("u_doc")) & (F.col("parent") == F.col("u_id")), "left")
    parent, child = F.when(F.col("found"), F.col("parent")), F.col("found").isNotNull()
    first = first.select("doc", "id", parent.alias("parent"), parent.alias("ptr"), child.cast("long").alias("depth"), F.when(~child, F.col("id")).alias("root"), F.lit(1).cast("long").alias("size"))
    tables = [stored(first)]
    state, sums = tables[0].filter("ptr is not null"), []
    done = [tables[0].filter("ptr is null")]
    active = state.count()
    while active:
        more = stored(state.groupBy("doc", "ptr").agg(F.sum("size").alias("more")))
        sums.append(more)
        s = more.select(F.col("doc").alias("s_doc"), F.col("ptr").alias("s_id"), "more")
        step = _up(state, _union([state, *done]), "ptr", "depth", "root").join(s, F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("id") == F.col("s_id")), "left")
        step = stored(step.select("doc", "id", "parent", F.col("u_ptr").alias("ptr"), (F.col("depth") + F.col("u_depth")).alias("depth"), F.col("u_root").alias("root"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        tables.append(step)
        before, state = active, step.filter("ptr is not null")
        active = state.count()
        done.append(step.filter("ptr is null"))
        # depths have no gaps: where none lies between 2^k and 2^(k+1), only loops are left
        if active == before:
            break
    looped = F.col("ptr").isNotNull()
    every = _union([state, *done] if active else done).select("doc", "id", "parent", F.when(~looped, F.col("depth")).alias("depth"), F.when(~looped, F.col("root")).alias("root"), looped.alias("looped"))
    if not sums:
        return every.withColumn("size", F.lit(1).cast("long"))
    total = _union(sums).groupBy("doc", "ptr").agg(F.sum("more").alias("more")).select(F.col("doc").alias("s_doc"), F.col("ptr").alias("s_id"), "more")
    sized = every.join(total, F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("id") == F.col("s_id")), "left")
    out = stored(sized.select("doc", "id", "parent", "depth", "root", F.when(~F.col("looped"), 1 + F.coalesce("more", F.lit(0))).alias("size"), "looped"))
    for t in (nodes, *tables, *sums):
        discard(t)
    return out


def preorder(sized: DataFrame, separator: str | None = "/") -> DataFrame:
    """Adds (pre, last, path) to the processed elements of ``subtree_sizes``: the downward phase.

    Within its tree an element's descendants are exactly those with pre < their pre <= last. Siblings are in the order of their
    ids, whatever their number. The path goes from the root to the element; without a separator there is none, as all paths
    of a deep tree are far longer than its rows.
    """
    path = [] if separator is None else ["path"]
    good = sized.filter("not looped")
    kids = good.filter("parent is not null")
    # ranges of (doc, parent, id): a family lies in one range or in several that follow each other
    ranged = stored(kids.repartitionByRange("doc", "parent", "id").withColumn("bucket", F.spark_partition_id()))
    totals = ranged.groupBy("doc", "parent", "bucket").agg(F.sum("size").alias("total"))
    of_buckets = Window.partitionBy("doc", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("doc").alias("t_doc"), F.col("parent").alias("t_parent"), F.col("bucket").alias("t_bucket"), F.coalesce(F.sum("total").over(of_buckets), F.lit(0)).alias("earlier"))
    in_bucket = Window.partitionBy("doc", "parent", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    ranked = ranked.join(totals, F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("parent") == F.col("t_parent")) & (F.col("bucket") == F.col("t_bucket")))
    columns = ["doc", "id", "parent", "depth", "root", "size"]
    start = ranked.select(*columns, (F.lit(1) + F.col("within") + F.col("earlier")).alias("pre"), F.col("parent").alias("ptr"), *[F.col("id").alias(c) for c in path])
    start = start.unionByName(good.filter("parent is null").select(*columns, F.lit(0).cast("long").alias("pre"), F.lit(None).cast("string").alias("ptr"), *[F.col("id").alias(c) for c in path]))
    tables = [stored(start)]
    discard(ranged)
    state, done = tables[0].filter("ptr is not null"), [tables[0].filter("ptr is null")]
    while state.head(1):
        step = _up(state, _union([state, *done]), "ptr", "pre", *path)
        tables.append(stored(step.select(*columns, (F.col("pre") + F.col("u_pre")).alias("pre"), F.col("u_ptr").alias("ptr"), *[F.concat_ws(separator, f"u_{c}", c).alias(c) for c in path])))
        state, ready = tables[-1].filter("ptr is not null"), tables[-1].filter("ptr is null")
        done.append(ready)
    return _union(done).select(*columns, "pre", (F.col("pre") + F.col("size") - 1).alias("last"), *path)


def unplaced(sized: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc, id, parent) of the elements of ``subtree_sizes`` to which ``preorder`` gave no range: on a loop or below one."""
    placed = tree.select(F.col("doc").alias("t_doc"), F.col("id").alias("t_id"))
    return sized.join(placed, F.col("doc").eqNullSafe(F.col("t_doc")) & F.col("id").eqNullSafe(F.col("t_id")), "left_anti").select("doc", "id", "parent")


def loops(lost: DataFrame) -> DataFrame:
    """(doc, id, on_loop, loop) of the elements of ``unplaced`` or ``unending``; loop is the smallest id on the loop they stand on or lead to."""
    state = stored(lost.select("doc", "id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")))
    before = -1
    # the image of ever longer walks shrinks to the loops themselves; the smallest id met on a walk from a loop is the loop's
    while (now := state.select("doc", "ptr").distinct().count()) != before:
        before = now
        new = stored(_up(state, state, "ptr", "low").select("doc", "id", F.col("u_ptr").alias("ptr"), F.least("low", "u_low").alias("low")))
        discard(state)
        state = new
    on = state.select(F.col("doc").alias("l_doc"), F.col("ptr").alias("l_id")).distinct()
    marked = state.join(on, F.col("doc").eqNullSafe(F.col("l_doc")) & (F.col("id") == F.col("l_id")), "left")
    marked = stored(marked.select("doc", "id", "ptr", "low", F.col("l_id").isNotNull().alias("on_loop")))
    return _up(marked, marked, "low").select("doc", "id", "on_loop", F.col("u_low").alias("loop"))


def descendants(tree: DataFrame) -> DataFrame:
    """(doc, id, descendant, distance): all pairs of an element and a descendant, from the result of ``preorder``.

    A range join on nested sets: each range is cut into dyadic blocks (at most two of each size), each element names the blocks
    of all sizes it lies in, and the two meet in an equi-join. Every pair arises once; a large tree is spread over its blocks.
    """
    most = tree.agg(F.max("size")).head()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(max(0, int(most).bit_length())))
    kind = "array<struct<level:int,block:bigint>>"
    first = F.struct((F.col("pre") + 1).alias("a"), (F.col("last") + 1).alias("b"), F.array().cast(kind).alias("out"))

    def block(level: Column, at: Column, wanted: Column) -> Column:
        return F.when(wanted, F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))).otherwise(F.array().cast(kind))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right = (a < b) & (a % 2 == 1), (b % 2 == 1)
        a2 = F.when(left, a + 1).otherwise(a)
        right = right & (a2 < b)
        b2 = F.when(right, b - 1).otherwise(b)
        out = F.concat(s["out"], block(level, a, left), block(level, b - 1, right))
        done = a >= b
        return F.struct(
            F.when(done, a).otherwise(F.floor(a2 / 2).cast("long")).alias("a"), F.when(done, b).otherwise(F.floor(b2 / 2).cast("long")).alias("b"),
            F.when(done, s["out"]).otherwise(out).alias("out"),
        )

    upper = tree.filter("size > 1").select("doc", "root", "id", "depth", F.explode(F.aggregate(levels, first, step, lambda s: s["out"])).alias("x"))
    upper = upper.select("doc", "root", "id", "depth", "x.level", "x.block")
    lower = tree.filter("depth > 0").select(F.col("doc").alias("d_doc"), F.col("root").alias("d_root"), F.col("id").alias("descendant"), F.col("depth").alias("d_depth"), "pre", F.explode(levels).alias("d_level"))
    lower = lower.withColumn("d_block", F.floor(F.col("pre") / F.pow(F.lit(2), F.col("d_level"))).cast("long"))
    same = F.col("doc").eqNullSafe(F.col("d_doc")) & F.col("root").eqNullSafe(F.col("d_root")) & (F.col("level") == F.col("d_level")) & (F.col("block") == F.col("d_block"))
    return upper.join(lower, same).select("doc", "id", "descendant", (F.col("d_depth") - F.col("depth")).alias("distance"))
