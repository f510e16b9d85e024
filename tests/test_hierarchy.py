"""Hierarchies against plain walks over small forests, with loops, ties, nulls and empty tables."""

import random

from papyra.operators import hierarchy

SCHEMA = "document_id string, id string, parent_id string, children_ids array<string>, depth int, text string"


def brute(rows):
    own = {}
    for d, i, p, _ in rows:
        p = p if p and p.strip() else None
        old = own.get((d, i))
        own[d, i] = min(x for x in (old, p) if x) if old or p else None
    names = {}
    for d, i, _, kids in rows:
        for k in kids or []:
            if k is not None and i is not None:
                names[d, k] = min(names.get((d, k), i), i)
    parent = {}
    for (d, i), p in own.items():
        want = p or names.get((d, i))
        parent[d, i] = want if want is not None and (d, want) in own else None
    out = {}
    for d, i in own:
        path, at = [i], parent[d, i]
        while at is not None and at not in path:
            path.append(at)
            at = parent[d, at]
        looped = at is not None
        out[d, i] = None if looped else path[::-1]
    return parent, out


def forest(rng, n):
    rows = []
    for i in range(n):
        p = rng.choice([None, "", " ", f"e{rng.randrange(n)}", f"e{max(0, i - 1)}", "absent"])
        kids = rng.choice([None, [], [f"e{rng.randrange(n)}", None], [f"e{i}"] if rng.random() < 0.05 else []])
        rows.append((rng.choice(["a", "b", None]), f"e{i}", p, kids))
    return rows + rng.sample(rows, n // 10)


def test_trees_match_walks(spark):
    rng = random.Random(4)
    for n in (5, 60, 300):
        rows = forest(rng, n)
        parent, paths = brute(rows)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
        sized = hierarchy.subtree_sizes(hierarchy.resolve_parents(df))
        looped = {(r.doc, r.id) for r in sized.filter("looped").collect()}
        assert looped == {(r.doc, r.id) for r in hierarchy.unending(hierarchy.resolve_parents(df)).collect()}
        assert looped == {k for k, v in paths.items() if v is None}
        tree = {(r.doc, r.id): r for r in hierarchy.preorder(sized).collect()}
        assert set(tree) == {k for k, v in paths.items() if v is not None}
        below = {k: set() for k in tree}
        for (d, i), p in paths.items():
            if p is not None:
                r = tree[d, i]
                assert (r.path, r.depth, r.root) == ("/".join(p), len(p) - 1, p[0])
                for a in p[:-1]:
                    below[d, a].add(i)
        for (d, i), r in tree.items():
            assert r.size == len(below[d, i]) + 1
            inside = {x.id for (e, _), x in tree.items() if e == d and x.root == r.root and r.pre < x.pre <= r.last}
            assert inside == below[d, i]
        pairs = {(r.doc, r.id, r.descendant) for r in hierarchy.descendants(hierarchy.preorder(sized)).collect()}
        assert pairs == {(d, i, x) for (d, i), xs in below.items() for x in xs}


def test_deep_chain_and_wide_family(spark):
    chain = [("d", f"n{i:04d}", f"n{i - 1:04d}" if i else None, None, 0, "") for i in range(700)]
    wide = [("w", "root", None, [f"k{i}" for i in range(500)], 0, "")] + [("w", f"k{i}", None, None, 0, "") for i in range(500)]
    tree = hierarchy.preorder(hierarchy.subtree_sizes(hierarchy.resolve_parents(spark.createDataFrame(chain + wide, SCHEMA))))
    rows = {(r.doc, r.id): r for r in tree.collect()}
    assert rows["d", "n0699"].depth == 699 and rows["d", "n0000"].size == 700 and rows["d", "n0699"].path.count("/") == 699
    assert sorted(rows["w", f"k{i}"].pre for i in range(500)) == list(range(1, 501))
    kids = sorted(f"k{i}" for i in range(500))
    assert [rows["w", k].pre for k in kids] == list(range(1, 501))  # in the order of ids, over all ranges


def test_loops_are_named(spark):
    rows = [("d", "a", "b", None), ("d", "b", "a", None), ("d", "c", "a", None), ("d", "s", "s", None), ("d", "t", "c", None), ("d", "ok", None, None)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = {(r.id, r.on_loop, r.loop) for r in hierarchy.loops(hierarchy.unending(hierarchy.resolve_parents(df))).collect()}
    assert got == {("a", True, "a"), ("b", True, "a"), ("c", False, "a"), ("t", False, "a"), ("s", True, "s")}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    sized = hierarchy.subtree_sizes(hierarchy.resolve_parents(empty))
    lost = hierarchy.unending(hierarchy.resolve_parents(empty))
    assert lost.count() == 0 and hierarchy.loops(lost).count() == 0
    assert sized.count() == 0 and hierarchy.preorder(sized).count() == 0 and hierarchy.descendants(hierarchy.preorder(sized)).count() == 0
    odd = spark.createDataFrame([("d", None, "x", None, 0, ""), ("d", "x", None, None, 0, "")], SCHEMA)
    got = {r.id: r.depth for r in hierarchy.preorder(hierarchy.subtree_sizes(hierarchy.resolve_parents(odd))).collect()}
    assert got == {"x": 0, None: 1}


def test_found_are_left_by_both_phases(spark, tmp_path, monkeypatch):
    from papyra.plans import core_problems

    ran = []
    for name in ("subtree_sizes", "preorder"):
        phase = getattr(hierarchy, name)
        monkeypatch.setattr(hierarchy, name, lambda *a, name=name, phase=phase: ran.append(name) or phase(*a))
    rows = forest(random.Random(8), 60) + [("d", "s", "s", None), ("d", "t", "s", None), (None, None, "s", None), ("d", None, "t", None)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/elements.parquet")
    lost = {k for k, v in brute(rows)[1].items() if v is None}
    assert {("d", "s"), ("d", "t"), ("d", None)} <= lost
    assert sorted(map(tuple, core_problems.p5_found(spark, str(tmp_path)).collect()), key=str) == sorted(lost, key=str)
    assert ran == ["subtree_sizes", "preorder"]
    assert {(r.document_id, r.id) for r in core_problems.p5_loops(spark, str(tmp_path)).collect()} == lost
