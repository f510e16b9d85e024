"""Nested extraction payloads as flat, linked tables, by a tree automaton over object shapes.

A payload is a tree of objects, lists and values whose edges carry the keys. A bottom-up automaton gives each object and list
a state from the key above it and the states of its children: cells, cells with tables inside, rows, grids, the four variants
of a table (cells listed as objects, a grid of rows, both, or empty), pages as a list or by number, records of each kind. All
that follows reads the states only: the root's is the record's variant; a node in a table state is a table; what it has in a
cell state or in a grid goes to the rows of that variant, with the common keys (record, table, position), a path and a link to
its parent; a subtree without a table state is not walked again. Tables are found wherever an object stands under ``tables``
or ``table``, or in a list there.

Variants keep their own typed tables (``cells`` of object cells with confidence and header mark, ``cells`` of grids without);
``tables`` and ``cells`` are the common supertypes. The parse of one payload is the only step in Python, as its depth is
unknown; payloads are independent, so it needs no shuffle, and positions given twice are settled where they are parsed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of the automaton.
EMPTY, LIST, ROW, GRID, CELL, CELL_NESTING, CELLS, TABLE_CELLS, TABLE_GRID, TABLE_BOTH, TABLE_EMPTY, TABLES, PAGE, PAGES_LIST, PAGES_NUMBER, PAGES_OTHER, PARSED, RECORD_LIST, RECORD_NUMBER, RECORD_PARSED, OTHER = range(21)
TABLE_STATES = {TABLE_CELLS: "cells", TABLE_GRID: "grid", TABLE_BOTH: "both", TABLE_EMPTY: "empty"}
VARIANTS = {RECORD_LIST: "pages_list", RECORD_NUMBER: "pages_by_number", RECORD_PARSED: "parsed_data"}

_NUMBER = re.compile(r"\s*[+-]?\d+(?:\.0+)?\s*\Z")


def _refuse(x: str) -> Any:
    raise ValueError(f"{x} is not JSON")


def parse(payload: str) -> Any:
    """A valid JSON text as Python values, numbers kept as written; raises ValueError for anything else."""
    try:
        return json.loads(payload, parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
    except RecursionError:
        return _parse_deep(payload)


class _Number(str):
    """A number, kept as its digits so that a text given as a number keeps its form."""


_TOKEN = re.compile(r"""[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))""", re.DOTALL)


def _parse_deep(text: str) -> Any:
    """The same for payloads nested deeper than the interpreter's stack allows: an explicit stack."""
    top: list[Any] = []
    stack: list[Any] = [top]
    keys: list[Any] = [None]
    at, end, expect = 0, len(text.rstrip(" \t\n\r")), "value"

    def put(v: Any) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)

    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        sign, string, number, word = m.groups()
        if expect in ("value", "first") and (string or number or word or sign in ("{", "[")):
            if expect == "first" and isinstance(stack[-1], dict):
                if not string:
                    raise ValueError("not JSON")
                keys[-1], expect = json.loads(string), "colon"
                continue
            if sign:
                new: Any = {} if sign == "{" else []
                put(new)
                stack.append(new)
                keys.append(None)
                expect = "first"
            else:
                put(json.loads(string) if string else _Number(number) if number else {"true": True, "false": False, "null": None}[word])
                expect = "next"
        elif expect == "key" and string:
            keys[-1], expect = json.loads(string), "colon"
        elif expect == "colon" and sign == ":":
            expect = "value"
        elif expect in ("next", "first") and sign == ("}" if isinstance(stack[-1], dict) else "]") and len(stack) > 1:
            stack.pop()
            keys.pop()
            expect = "next"
        elif expect == "next" and sign == "," and len(stack) > 1:
            expect = "key" if isinstance(stack[-1], dict) else "value"
        else:
            raise ValueError("not JSON")
    if len(stack) != 1 or len(top) != 1:
        raise ValueError("not JSON")
    return top[0]


class Automaton:
    """States of the objects and lists of one payload, children before parents, without recursion."""

    def __init__(self, root: Any):
        self.state: dict[int, int] = {}
        self.holds: set[int] = set()
        nodes: list[tuple[Any, str]] = [(root, "")] if isinstance(root, (dict, list)) else []
        for node, label in nodes:  # the list grows while it is read
            if isinstance(node, dict):
                nodes.extend([(v, k) for k, v in node.items() if isinstance(v, (dict, list))])
            else:
                nodes.extend([(v, label + "[]") for v in node if isinstance(v, (dict, list))])
        for node, label in reversed(nodes):
            s = self.of_object(node, label) if isinstance(node, dict) else self.of_list(node, label)
            self.state[id(node)] = s
            if s in TABLE_STATES or any(id(v) in self.holds for v in (node.values() if isinstance(node, dict) else node) if isinstance(v, (dict, list))):
                self.holds.add(id(node))

    def __getitem__(self, node: Any) -> int:
        return self.state.get(id(node), EMPTY) if isinstance(node, (dict, list)) else EMPTY

    def of_list(self, node: list, label: str) -> int:
        if label == "pages":
            return PAGES_LIST
        if not node:
            return EMPTY
        if label == "cells":
            return CELLS
        if label == "data":
            return GRID
        if label == "data[]":
            return ROW
        return TABLES if any(self[x] in TABLE_STATES for x in node) else LIST

    def of_object(self, node: dict, label: str) -> int:
        if label in ("tables", "tables[]", "table", "table[]"):
            # an empty list has no state of its own here, a value that is no list is one entry
            cells, data = (node.get(k) is not None and (self[node[k]] != EMPTY or not isinstance(node[k], list)) for k in ("cells", "data"))
            return TABLE_BOTH if cells and data else TABLE_CELLS if cells else TABLE_GRID if data else TABLE_EMPTY
        if label in ("cells", "cells[]", "data", "data[]", "data[][]"):
            return CELL_NESTING if any(id(v) in self.holds for v in node.values()) else CELL
        if label == "pages":
            return PAGES_NUMBER if node and all(isinstance(v, (dict, list)) or v is None for v in node.values()) else PAGES_OTHER
        if label == "pages[]" or "page_number" in node:
            return PAGE
        if label == "parsed_data":
            return PARSED
        if label in ("", "result"):
            inner = self[node.get("result")] if label == "" and isinstance(node.get("result"), dict) else self.of_pages(node)
            return inner if inner in (RECORD_LIST, RECORD_NUMBER) else RECORD_PARSED if label == "" and "parsed_data" in node else OTHER
        return OTHER

    def of_pages(self, node: dict) -> int:
        return {PAGES_LIST: RECORD_LIST, PAGES_NUMBER: RECORD_NUMBER, PAGES_OTHER: RECORD_NUMBER}.get(self[node.get("pages")], OTHER)


def _number(x: Any) -> int | None:
    if isinstance(x, bool) or x is None:
        return None
    s = str(x)
    if _NUMBER.match(s):
        digits = s.strip().split(".")[0]
        # more digits than any place has are not read at all
        if len(digits.lstrip("+-0")) > 10:
            return None
        n = int(digits.lstrip("+-").lstrip("0") or "0") * (-1 if digits[0] == "-" else 1)
        return n if -(2**31) <= n < 2**31 else None
    return None


def _text(x: Any) -> str | None:
    if x is None or isinstance(x, str):
        return None if x is None else str(x)
    return json.dumps(x, ensure_ascii=False)


def _real(x: Any) -> float | None:
    try:
        return None if x is None or isinstance(x, (bool, dict, list)) else float(x)
    except ValueError:
        return None


def flatten(root: Any) -> tuple[str, list[tuple], list[tuple]]:
    """(variant of the record, rows of tables, rows of cells) of one parsed payload; all entries for a position, in order."""
    a = Automaton(root)
    tables: list[tuple] = []
    cells: list[tuple] = []
    # (node, path, page, parent table with row and column)
    todo: list[tuple[Any, str, int | None, Any]] = [(root, "$", None, None)]
    while todo:
        node, path, page, parent = todo.pop()
        if not isinstance(node, (dict, list)) or id(node) not in a.holds:
            continue
        if isinstance(node, list):
            todo.extend((x, f"{path}[{i}]", page, parent) for i, x in reversed(list(enumerate(node))))
            continue
        state = a[node]
        if state in TABLE_STATES:
            own = _text(node.get("id"))
            table = own if own is not None else path
            here = _number(node.get("page"))
            tables.append((table, path, TABLE_STATES[state], page if page is not None else here, _number(node.get("rows")), _number(node.get("cols")), _real(node.get("confidence")), *(parent or (None, None, None))))
            nested: list[tuple[Any, str, int | None, Any]] = []

            def put(kind: str, r: Any, j: Any, c: Any, where: str) -> None:
                fields = c if isinstance(c, dict) else {"text": c}
                r, j = _number(r), _number(j)
                head = fields.get("is_header")
                cells.append((table, kind, r, j, _text(fields.get("text")), _real(fields.get("confidence")), head if isinstance(head, bool) else None, _number(fields.get("row_span")), where))
                if a[c] == CELL_NESTING:
                    nested.extend((v, f"{where}.{k}", page, (table, r, j)) for k, v in c.items())

            listed, grid = node.get("cells"), node.get("data")
            for i, c in enumerate(listed if a[listed] == CELLS else [listed]):
                if a[c] in (CELL, CELL_NESTING):
                    put("cells", c.get("row"), c.get("col"), c, f"{path}.cells[{i}]")
            for r, line in enumerate(grid if isinstance(grid, list) else [] if grid is None else [grid]):
                for j, v in enumerate(line if isinstance(line, list) else [] if line is None else [line]):
                    put("grid", _Number(r), _Number(j), v, f"{path}.data[{r}][{j}]")
            nested += [(v, f"{path}.{k}", page, parent) for k, v in node.items() if k not in ("cells", "data")]
            todo.extend(reversed(nested))
            continue
        here = _number(node["page_number"]) if "page_number" in node else page
        numbered = state == PAGES_NUMBER
        todo.extend((v, f"{path}.{k}", _number(_Number(k)) if numbered else here, parent) for k, v in reversed(list(node.items())))
    return VARIANTS.get(a[root], "other"), tables, cells


def parsed(text: str | None) -> tuple[str, list[tuple], list[tuple]]:
    """``flatten`` of a payload: missing for a null or blank one, broken for one that is no valid JSON; both have no tables."""
    if text is None or not text.strip():
        return "missing", [], []
    try:
        root = parse(text)
    except ValueError:
        return "broken", [], []
    return flatten(root)


def last_entries(cells: list[tuple]) -> list[tuple]:
    """Of the entries for one position of a table the later; entries without a position are all kept."""
    at = {c[:1] + c[2:4]: i for i, c in enumerate(cells) if c[2] is not None and c[3] is not None}
    return cells if len(at) == len(cells) else [c for i, c in enumerate(cells) if c[2] is None or c[3] is None or at[c[:1] + c[2:4]] == i]


_RECORD = "variant string, n_tables int, n_cells int"
_TABLE = "table_id string, path string, variant string, page int, n_rows int, n_cols int, confidence double, parent_table string, parent_row int, parent_col int"
_CELL = "table_id string, variant string, row_num int, col_num int, text string, confidence double, is_header boolean, row_span int, path string"
_GRID = "table_id string, row_num int, col_num int, text string, path string"


def classify(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, payload): the distinct records, a repeated row counted once, from which the tables below are made.

    Records with one key and different payloads are all kept. Other columns are not read.
    """
    return df.select(F.col(key), F.col(payload).alias("payload")).dropDuplicates()


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # an escape for half a surrogate pair is valid JSON, but no text
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], kind)


def _routed(classified: DataFrame, key: str, fields: str, make: Callable[[str, list[tuple], list[tuple]], list[tuple]]) -> DataFrame:
    """One row for each tuple ``make`` gives for a parsed payload, with the key; columns by ``fields``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([classified.schema[key], *_parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                at: list[int] = []
                rows: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    got = make(*parsed(text))
                    at += [i] * len(got)
                    rows += got
                columns = list(zip(*rows)) if rows else [()] * (len(arrow) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(_array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return classified.select(key, "payload").mapInArrow(run, schema)


def records(classified: DataFrame, key: str = "record_id") -> DataFrame:
    """One row for each record with its variant, and how many tables and entries of cells it has."""
    return _routed(classified, key, _RECORD, lambda variant, tables, cells: [(variant, len(tables), len(cells))])


def tables(classified: DataFrame, key: str = "record_id") -> DataFrame:
    """One row for each table with the link to its record and, if nested, to its parent cell."""
    return _routed(classified, key, _TABLE, lambda variant, tables, cells: tables)


def cells(classified: DataFrame, key: str = "record_id") -> DataFrame:
    """One row for each addressed cell: of entries for one position the later holds; cells without a position are kept all."""
    return _routed(classified, key, _CELL, lambda variant, tables, cells: last_entries(cells))


def positions(classified: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, table_id, row_num, col_num, text): the supertype of all cells, without what only some variants have."""
    return _routed(classified, key, "table_id string, row_num int, col_num int, text string", lambda variant, tables, cells: [(c[0], *c[2:5]) for c in last_entries(cells)])


def typed_cells(classified: DataFrame, variant: str, key: str = "record_id") -> DataFrame:
    """The subtype table of one variant: ``cells`` (with confidence, header mark and span) or ``grid`` (position and text)."""
    if variant == "grid":
        return _routed(classified, key, _GRID, lambda _, tables, cells: [(c[0], c[2], c[3], c[4], c[8]) for c in last_entries(cells) if c[1] == "grid"])
    return _routed(classified, key, _CELL.replace("variant string, ", ""), lambda _, tables, cells: [c[:1] + c[2:] for c in last_entries(cells) if c[1] == "cells"])
