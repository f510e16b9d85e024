"""Nested payloads: parser, automaton and flat tables on small cases."""

import json
import random

import pytest

from papyra.operators import nested


def table(rows=None, data=None, id="t"):
    return {"id": id, **({"cells": rows} if rows is not None else {}), **({"data": data} if data is not None else {})}


def test_parsers_agree():
    rng = random.Random(1)

    def value(d):
        k = rng.random()
        if d and k < 0.3:
            return {rng.choice("abc") + str(i): value(d - 1) for i in range(rng.randrange(4))}
        if d and k < 0.6:
            return [value(d - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, True, False, 1, -2.5, 1e9, "x\"\n", "é", ""])

    for _ in range(300):
        text = json.dumps(value(4), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert nested._parse_deep(text) == nested.parse(text)
    for bad in ["", "{", "[1,]", "{\"a\" 1}", "{a:1}", "1 2", "[1", "{\"a\":}", "\"x", "NaN", "nul", "{\"a\":1,}", "]"]:
        with pytest.raises(ValueError):
            nested.parse(bad)
        with pytest.raises(ValueError):
            nested._parse_deep(bad)


def test_very_deep_payload():
    deep = '{"tables": [{"id": "t", "cells": [{"row": 0, "col": 0, "text": "x", "table": ' * 1_500 + "null" + "}]}]}" * 1_500
    variant, tables, cells = nested.flatten(nested.parse(deep.replace('"tables": [', '"tables": [', 1)))
    assert len(cells) == 1_500 and len(tables) >= 1_500


def test_variants_and_links():
    inner = table([{"row": 0, "col": 1, "text": "in"}], id="t2")
    outer = table([{"row": "0", "col": "0", "text": 5, "tables": [inner]}, {"row": 0, "col": 0, "text": " "}, "junk"], id="t1")
    v, tables, cells = nested.flatten(nested.parse(json.dumps({"pages": [{"page_number": 1, "tables": outer}]})))
    assert v == "pages_list" and {t[0]: (t[2], t[3], t[7:]) for t in tables} == {"t1": ("cells", 1, (None, None, None)), "t2": ("cells", 1, ("t1", 0, 0))}
    assert [c[4] for c in cells] == ["5", " ", "in"]
    v, tables, cells = nested.flatten(nested.parse(json.dumps({"result": {"pages": {"2": {"tables": [table(data=[["a", None], [], ["b", 3, {"text": "z", "table": inner}], "lone"])]}}}})))
    assert v == "pages_by_number" and tables[0][2:4] == ("grid", 2)
    assert [(c[2], c[3], c[4]) for c in cells if c[0] == "t"] == [(0, 0, "a"), (0, 1, None), (2, 0, "b"), (2, 1, "3"), (2, 2, "z"), (3, 0, "lone")]
    assert nested.flatten(nested.parse('{"parsed_data": {"tables": []}}'))[0] == "parsed_data"
    assert nested.flatten(nested.parse("[1, 2]")) == ("other", [], [])


def test_flat_tables(spark):
    twice = {"parsed_data": {"tables": [table([{"row": 0, "col": 0, "text": "old"}, {"row": 0, "col": 0, "text": ""}, {"row": 1, "col": 0, "text": "k"}, {"text": "nowhere"}])]}}
    rows = [(1, json.dumps(twice), "x"), (1, json.dumps(twice), "x"), (2, None, "x"), (3, " ", "x"), (4, "{broken", "x"), (None, "{}", "x")]
    df = spark.createDataFrame(rows, "record_id long, payload string, variant string")
    c = nested.classify(df)
    assert {(r.record_id, r.variant) for r in nested.records(c).collect()} == {(1, "parsed_data"), (2, "missing"), (3, "missing"), (4, "broken"), (None, "other")}
    got = {(r.row_num, r.col_num): r.text for r in nested.cells(c).collect()}
    assert got == {(0, 0): "", (1, 0): "k", (None, None): "nowhere"}
    assert nested.typed_cells(c, "grid").count() == 0 and nested.typed_cells(c, "cells").count() == 3 and nested.tables(c).count() == 1
    assert nested.cells(nested.classify(df.limit(0))).count() == 0


def test_huge_numbers_and_half_surrogates(spark):
    text = '{"tables": [{"id": "t", "cells": [{"row": %s, "col": 0, "text": "far"}, {"row": "-007", "col": 1, "text": "\\ud800 x"}, {"row": 2, "col": 3, "text": "in"}]}]}' % ("9" * 5000)
    c = nested.classify(spark.createDataFrame([(1, text)], "record_id long, payload string"))
    assert sorted((r.row_num is None, r.row_num or 0, r.col_num, r.text) for r in nested.cells(c).collect()) == [(False, -7, 1, "\ufffd x"), (False, 2, 3, "in"), (True, 0, 0, "far")]


def test_states_decide():
    root = nested.parse('{"pages": [{"page_number": 1, "tables": [{"id": "a", "cells": [{"row": 0, "col": 0, "text": "x", "table": {"id": "b", "data": [["y"]]}}, {"row": 0, "col": 1}]}]}], "notes": [{"cells": [1]}]}')
    a = nested.Automaton(root)
    outer = root["pages"][0]["tables"][0]
    assert a[root] == nested.RECORD_LIST and a[root["pages"]] == nested.PAGES_LIST and a[root["pages"][0]] == nested.PAGE and a[outer] == nested.TABLE_CELLS
    assert [a[c] for c in outer["cells"]] == [nested.CELL_NESTING, nested.CELL] and a[outer["cells"][0]["table"]] == nested.TABLE_GRID
    assert id(root["notes"]) not in a.holds and id(root["pages"]) in a.holds
    # the state alone makes the table: with another one it is none
    a.state[id(outer)] = nested.OTHER
    assert a[outer] not in nested.TABLE_STATES
