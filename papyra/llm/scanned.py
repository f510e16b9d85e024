"""Repair of text extracted from scanned pages: word divisions, misread characters, running heads and page numbers.

* Words are counted over all pages, and grouped by a skeleton in which glyphs that scanners confuse are alike. A rare form is
  taken for a misreading of a frequent form of its group if known confusions turn one into the other, and if the frequent
  form fits between the neighbours at that place (it is seen beside them elsewhere); forms with signs no word has, such as
  a digit between letters, need no neighbours. On a page of high confidence a form without such signs needs more support.
* A word divided at a line end is joined if the joined form is a word of the pages (or its skeleton is); a hyphen that belongs
  to it stays: compounds seen with it in mid-line, first halves that elsewhere stand before a blank.
* Running heads and feet are found by masking digits: a line at the edge of the page whose letters recur at the edge of other
  pages of the document, and not within pages. The page's number is looked for on a line of its own or in such a line.
* Paragraphs are put together from the remaining lines by windows over each page's lines.

Each page is read twice: once for the counts of words and of pairs of neighbours, the divisions and the marks of its lines,
kept as one table in the checkpoint folder; once for the words that are no common ones. Lines and pairs travel as hashes. All counts are over all pages; nothing that grows with the pages is collected or broadcast (the broadcast of the commonest words is
bounded by ``COMMON`` and only spares looking up words that are no rare forms).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.session import stored

COMMON = 5000
#: A frequent form has at least SEEN readings and RATIO times those of the form it corrects.
SEEN, RATIO, RATIO_LETTERS = 3, 2, 8
#: Neighbours that must speak for a form without odd signs, and on pages of a confidence from SURE on.
FITS, FITS_SURE, SURE = 2, 3, 0.97
#: Lines at the edge of a page that may be heads or feet.
EDGE = 3
#: Distinct pairs counted in a task before their counts are passed on.
FLUSH = 400_000

# Signs of division, (read, meant) pairs of glyphs, and their common skeletons.
SOFT, HYPHENS = "­¬", "-‐‑"
CONFUSED = [
    ("c", "e"), ("e", "c"), ("ri", "n"), ("n", "ri"), ("f", "t"), ("t", "f"), ("0", "o"), ("o", "0"), ("1", "i"), ("1", "l"), ("l", "1"), ("@", "a"), ("5", "s"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"),
    ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("9", "g"), ("q", "g"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("b", "h"), ("h", "b"), ("6", "b"), ("8", "b"), ("ﬁ", "fi"), ("ﬁ", "ti"), ("ﬂ", "fl"),
    ("i", "l"), ("l", "i"), ("vv", "w"), ("w", "vv"), ("li", "u"), ("iii", "m"), ("n", "u"), ("u", "n"), ("0", "о"), ("o", "о"), ("3", "з"), ("6", "б"), ("4", "ч"), ("ni", "m"), ("nn", "m"), ("$", "s"), ("2", "z"), ("7", "t"), ("€", "e"), ("a", "а"), ("e", "е"), ("c", "с"), ("p", "р"), ("x", "х"),
]
_ALIKE = {"0": "o", "о": "o", "@": "a", "а": "a", "5": "s", "$": "s", "1": "i", "l": "i", "|": "i", "!": "i", "9": "g", "q": "g", "6": "b", "h": "b", "8": "b", "б": "b", "e": "c", "€": "c", "е": "c", "с": "c", "t": "f", "7": "f", "2": "z", "р": "p", "х": "x", "з": "3", "ч": "4"}
_SINGLE = ("".join(_ALIKE), "".join(_ALIKE.values()))
_MULTI = [("ﬁ", "fi"), ("ﬂ", "fi"), ("d", "ci"), ("m", "iii"), ("w", "vv"), ("n", "ii"), ("u", "ii"), ("r", "i")]
_TRANSLATE = str.maketrans(_ALIKE)

_OUTER = "".join(".,;:?()[]{}\"“”„«»‘…—–*<>=/\\،؟。，、；：（）「」")
_APART = re.compile(r"[’']")
_CJK = re.compile("[぀-鿿]")


def skeleton_of(c: Column) -> Column:
    s = F.translate(F.lower(c), *_SINGLE)
    for a, b in _MULTI:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def skeleton(s: str) -> str:
    s = s.lower().translate(_TRANSLATE)
    for a, b in _MULTI:
        s = s.replace(a, b)
    return s


def digest(text: str) -> int:
    """The same 64-bit hash as ``xxhash64`` of a string in Spark."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def confusable(read: str, meant: str) -> bool:
    """Whether known confusions, and at least one, turn ``meant`` into ``read``."""
    if read == meant:
        return False
    reach: set[tuple[int, int]] = {(0, 0)}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if i == len(read) and j == len(meant):
            return True
        steps = [(i + 1, j + 1)] if i < len(read) and j < len(meant) and read[i] == meant[j] else []
        steps += [(i + len(a), j + len(b)) for a, b in CONFUSED if read.startswith(a, i) and meant.startswith(b, j)]
        for s in steps:
            if s not in reach:
                reach.add(s)
                todo.append(s)
    return False


class Division(NamedTuple):
    line: int
    first: str
    sign: str
    second: str


def words(token: str) -> tuple[str, ...]:
    """The words of a run between blanks, as written: without outer signs, parted at apostrophes; none in scripts without blanks."""
    out = []
    for part in _APART.split(token.strip(_OUTER)):
        part = part.strip(_OUTER)
        if len(part) >= 2 and any(map(str.isalpha, part)) and not _CJK.search(part):
            out.append(part)
    return tuple(out)


class _Forms(dict):
    """Words of each run between blanks that was met, in lower case or as written; emptied when it has grown large."""

    def __init__(self, lower: bool):
        super().__init__()
        self.lower = lower

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        out = words(token)
        self[token] = out = tuple(w.lower() for w in out) if self.lower else out
        return out


class _Letters(dict):
    """Skeleton of the letters of each run between blanks that was met, digits masked; emptied when it has grown large."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[token] = out = skeleton(_SIGNS.sub(" ", _DIGITS.sub(" ", token))).strip()
        return out


def read_page(rows: list[list[str]]) -> tuple[list[str], list[Division], list[int]]:
    """(runs between blanks, divisions, places of the runs made by joining): of a divided word only the joined form is a run.

    ``rows`` are the runs of each line; they are changed.
    """
    divisions: list[Division] = []
    made: list[int] = []
    sequence: list[str] = []
    half: str | None = None
    last = len(rows) - 1
    for k, tokens in enumerate(rows):
        if not tokens:
            half = None
            continue
        if half is not None:
            divisions.append(Division(k - 1, half[:-1].strip(_OUTER).lower(), half[-1], tokens[0].strip(_OUTER).lower()))
            made.append(len(sequence))
            tokens[0] = half[:-1] + tokens[0]
            half = None
        end = tokens[-1]
        if end[-1] in "­¬-‐‑" and (len(tokens) > 1 or not made or made[-1] != len(sequence)) and len(end) >= 2 and end[-2].isalpha() and k < last and rows[k + 1]:
            follow = rows[k + 1][0][0]
            if follow.isalpha() or follow in "@|01569":
                half = tokens.pop()
        sequence += tokens
    return sequence, divisions, made


_DIGITS = regex.compile(r"(?<![\p{L}@|])[0-9]+(?![\p{L}@|])")
_SIGNS = regex.compile(r"[^\p{L}\p{M}0-9@|!$]+")
_ENDS = re.compile(r"[.!?。！？।؟,;:、，]\s*[)\]\"”’]?\s*$")
# Words for page in use before or after its number.
_PAGE = r"(?:page|seite|página|pagina|p|s|pág|pag|стр|страница|第|صفحة|पृष्ठ)"
_ALONE = re.compile(rf"^\s*(?:{_PAGE}\.?\s*)?[-–—\[(<·•|~]*\s*([0-9]+)\s*[-–—\])>·•|~]*\s*(?:(?:/|of|von|de|di|из|sur)\s*[0-9]+|页|頁|ページ|页。)?\s*[-–—\])>]*\s*$", re.IGNORECASE)
_IN_HEAD = re.compile(r"^\s*([0-9]+)\s{2,}\S|\S\s{2,}([0-9]+)\s*$")
_ROMAN = re.compile(r"^\s*[-–—\[(]*\s*([ivxlc]{1,8})\s*[-–—\])]*\s*$", re.IGNORECASE)
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
#: Marks of a line: may be a head, stands apart or is narrow, is the page's number, has the page's number at an end.
HEAD, LOOSE, NUMBER, NUMBERED = 1, 2, 4, 8


def roman(s: str) -> int:
    """The value of a Roman number below 400: each sign counts negative before a larger one."""
    v = [_VALUES[ch] for ch in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def mark_lines(lines: list[str], rows: list[list[str]], page: int | None, letters: dict[str, str]) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((line, place from the top, from the bottom, hash of its letters, marks) of the edge lines, hashes of the lines within).

    Digits are masked; what scanners confuse with letters within a word is no digit of the line. A line with fewer than three
    letters has no hash (0).
    """
    full = [i for i, row in enumerate(rows) if row]
    n, widest = len(full), max(map(len, lines))
    at_edge, inside = [], []
    for j, i in enumerate(full):
        masked = " ".join(filter(None, map(letters.__getitem__, rows[i])))
        h = digest(masked) if len(masked) >= 3 else 0
        top, bottom = j + 1, n - j
        if top > EDGE and bottom > EDGE:
            if h:
                inside.append(h)
            continue
        line, marks = lines[i], 0
        lone = _ALONE.match(line) if any(map(str.isdigit, line)) else None
        numeral = _ROMAN.match(line) if len(line) < 40 else None
        ends = _IN_HEAD.search(line) if "  " in line or "\t" in line else None
        if h and not lone and not numeral and not _ENDS.search(line):
            marks |= HEAD
        near = i + 1 if top <= EDGE else i - 1
        if ends or not 0 <= near < len(rows) or not rows[near] or len(line) < 0.7 * widest:
            marks |= LOOSE
        if page is not None and (lone and int(lone[1]) == page or numeral and roman(numeral[1]) == page):
            marks |= NUMBER
        if page is not None and ends and any(x and int(x) == page for x in ends.groups()):
            marks |= NUMBERED
        at_edge.append((i, top, bottom, h, marks))
    return at_edge, inside


_FIELDS = "line int, a string, b string, c string, h long, n long, top int, bottom int, marks int"


def _plain_breaks(text: str) -> str:
    return text.replace("\r\n", "\n") if "\r" in text else text


def read_all(pages: DataFrame, key: str, document: str, page: str, text: str) -> DataFrame:
    """One row for each finding of the first reading, by kind:

    * w, s: a word, or a first half before a blank (a), with how often it occurs (n)
    * p: a pair of neighbours by the hash of both (h), with how often (n)
    * v: a division (line, first half a, sign b, second half c)
    * e: a line at the edge of a page (line, top, bottom, hash of its letters h, marks)
    * i: a line within the pages of a document (d) by its hash (h), with how often (n)
    """
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("k", pages.schema[key].dataType), T.StructField("d", pages.schema[document].dataType), T.StructField("pg", T.IntegerType()), *T._parse_datatype_string(_FIELDS).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, letters = _Forms(lower=True), _Letters()
        counts: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        within: Counter[tuple[object, int]] = Counter()

        def rows(size: int, /, **given: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in arrow], schema=arrow)

        def same(value: str, n: int) -> pa.Array:
            return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int32)))

        def flush() -> Iterator[pa.RecordBatch]:
            if counts:
                yield rows(len(counts), kind=same("w", len(counts)), a=pa.array(list(counts), pa.string()), n=pa.array(list(counts.values()), pa.int64()))
                halves = [(w[:-1], n) for w, n in counts.items() if w[-1] in HYPHENS]
                if halves:
                    yield rows(len(halves), kind=same("s", len(halves)), a=pa.array([a for a, _ in halves], pa.string()), n=pa.array([n for _, n in halves], pa.int64()))
            if pairs:
                yield rows(len(pairs), kind=same("p", len(pairs)), h=pa.array([digest(f"{a} {b}") for a, b in pairs], pa.int64()), n=pa.array(list(pairs.values()), pa.int64()))
            if within:
                yield rows(len(within), kind=same("i", len(within)), d=pa.array([d for d, _ in within], arrow.field("d").type), h=pa.array([h for _, h in within], pa.int64()), n=pa.array(list(within.values()), pa.int64()))
            counts.clear(), pairs.clear(), within.clear()

        for batch in batches:
            at_v, at_e, cut, edge = [], [], [], []
            docs, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, value in enumerate(batch.column(3).to_pylist()):
                lines = _plain_breaks(value).split("\n")
                by_line = [line.split() for line in lines]
                at_edge, inside = mark_lines(lines, by_line, numbers[i], letters)
                at_e += [i] * len(at_edge)
                edge += at_edge
                within.update((docs[i], h) for h in inside)
                sequence, divisions, made = read_page(by_line)
                start = 0
                for stop in [*made, len(sequence)]:
                    run_of = list(chain.from_iterable(map(forms.__getitem__, sequence[start:stop])))
                    counts.update(run_of)
                    pairs.update(zip(run_of, run_of[1:]))
                    start = stop + 1
                if divisions:
                    at_v += [i] * len(divisions)
                    cut += divisions
            if cut:
                line, a, b, c = (list(x) for x in zip(*cut))
                yield rows(len(cut), kind=same("v", len(cut)), k=batch.column(0).take(pa.array(at_v, pa.int64())), line=pa.array(line, pa.int32()), a=pa.array(a, pa.string()), b=pa.array(b, pa.string()), c=pa.array(c, pa.string()))
            if edge:
                where = pa.array(at_e, pa.int64())
                line, top, bottom, h, marks = np.array(edge, dtype=np.int64).T
                yield rows(
                    len(edge), kind=same("e", len(edge)), k=batch.column(0).take(where), d=batch.column(1).take(where), pg=batch.column(2).take(where), line=pa.array(line.astype(np.int32)), h=pa.array(h),
                    top=pa.array(np.minimum(top, EDGE + 1).astype(np.int32)), bottom=pa.array(np.minimum(bottom, EDGE + 1).astype(np.int32)), marks=pa.array(marks.astype(np.int32)),
                )
            if len(pairs) + len(within) > FLUSH:
                yield from flush()
        yield from flush()

    return pages.select(F.col(key), F.col(document), F.col(page).cast("int"), F.col(text)).mapInArrow(run, schema)


def misreadings(counted: DataFrame) -> DataFrame:
    """(form, meant, odd, n_form, n_meant): rare forms with the frequent forms they may stand for; odd ones need no neighbours."""
    forms = counted.filter("kind = 'w'").select(F.col("a").alias("form"), F.col("n").alias("n_form"), skeleton_of(F.col("a")).alias("k"))
    # between letters, or at the end of some: a sign that no word has there
    odd = F.col("form").rlike(r"\p{L}[0-9@|!$€ﬁﬂ]|[0-9@|!$€ﬁﬂ]\p{L}") & ~F.col("form").rlike(r"[0-9]{3}|[@].*[.]|^[0-9]+\p{L}{1,2}$")
    often = forms.filter(F.col("n_form") >= 2).select(F.col("form").alias("meant"), F.col("n_form").alias("n_meant"), F.col("k").alias("k2"))
    often = often.filter(F.col("meant").rlike(r"^[\p{L}\p{M}][\p{L}\p{M}\-]*$"))
    ratio = F.when(odd, F.lit(RATIO)).otherwise(F.lit(RATIO_LETTERS))
    pairs = forms.join(often, (F.col("k") == F.col("k2")) & (F.col("form") != F.col("meant")))
    pairs = pairs.filter((F.col("n_meant") >= F.col("n_form") * ratio) & ((F.col("n_meant") >= SEEN) | odd)).select("form", "meant", odd.alias("odd"), "n_form", "n_meant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [confusable(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def scan(pages: DataFrame, key: str, text: str, confidence: str | None, common: Iterable[str]) -> DataFrame:
    """(k, sure, surface, form, before, after): all words that are not common, with their neighbours."""
    shared = pages.sparkSession.sparkContext.broadcast(frozenset(common))
    schema = T.StructType([T.StructField("k", pages.schema[key].dataType), T.StructField("sure", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("surface", "form", "before", "after"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, as_written, forms = shared.value, _Forms(lower=False), _Forms(lower=True)
        for batch in batches:
            at, cols = [], ([], [], [], [])
            for i, value in enumerate(batch.column(2).to_pylist()):
                sequence = read_page([line.split() for line in _plain_breaks(value).split("\n")])[0]
                low = list(chain.from_iterable(map(forms.__getitem__, sequence)))
                places = [j for j, f in enumerate(low) if f not in usual]
                if not places:
                    continue
                surface = list(chain.from_iterable(map(as_written.__getitem__, sequence)))
                low.append(None)
                for j in places:
                    at.append(i)
                    for col, v in zip(cols, (surface[j], low[j], low[j - 1] if j else None, low[j + 1])):
                        col.append(v)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    known = F.when(F.col(confidence) > 1, F.col(confidence) / 100).otherwise(F.col(confidence)) if confidence else F.lit(None).cast("double")
    return pages.select(key, F.coalesce(known >= SURE, F.lit(False)).alias("sure"), text).mapInArrow(run, schema)


def divided(read: DataFrame, counted: DataFrame) -> DataFrame:
    """(k, line, joins, compound): the divisions; joins tells that the sign does not belong to the word.

    What decides are the two halves, so each pair of halves is looked up once, by all its forms in one join.
    """
    v = read.filter("kind = 'v'").select("k", "line", "a", "b", "c")
    halves = v.select("a", "c").distinct()
    second, first = F.split("c", "[’']")[0], F.element_at(F.split("a", "[’']"), -1)
    joined = F.concat(first, second)
    forms = [("j", F.concat(F.lit("w"), joined)), ("h", F.concat(F.lit("w"), first, F.lit("-"), second)), ("s", F.concat(F.lit("s"), first)), ("f", F.concat(F.lit("w"), first)), ("k", F.concat(F.lit("k"), skeleton_of(joined)))]
    asked = halves.select("a", "c", F.explode(F.array(*[F.struct(F.lit(n).alias("role"), c.alias("x")) for n, c in forms])).alias("q")).select("a", "c", "q.role", "q.x")
    known = counted.filter("kind in ('w', 's')").select(F.concat("kind", "a").alias("y"), "n")
    alike = counted.filter("kind = 'w' and n >= 2").groupBy(F.concat(F.lit("k"), skeleton_of(F.col("a"))).alias("y")).agg(F.max("n").alias("n"))
    hits = asked.join(known.unionByName(alike), F.col("x") == F.col("y")).groupBy("a", "c").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r, _ in forms])
    hits = hits.select(F.col("a").alias("a2"), F.col("c").alias("c2"), *[f"n_{r}" for r, _ in forms])
    d = v.join(hits, (F.col("a") == F.col("a2")) & (F.col("c") == F.col("c2")), "left").fillna(0, [f"n_{r}" for r, _ in forms])
    whole = F.greatest("n_j", "n_k")
    unknown = (whole == 0) & (F.col("n_h") == 0) & (F.col("n_s") == 0) & (F.col("n_f") == 0)
    return d.select("k", "line", (F.col("b").isin(list(SOFT)) | (whole > F.col("n_h")) | unknown).alias("joins"), (F.col("n_h") > 0).alias("compound"))


def misread(scanned: DataFrame, rare: DataFrame, counted: DataFrame) -> DataFrame:
    """(k, surface, form, meant): words with misread characters and the form that is meant there.

    The neighbours of all places are looked up at once, by the hash of the pair.
    """
    hits = stored(scanned.join(rare, "form"))
    both = lambda x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.xxhash64(F.concat_ws(" ", x, y)))
    sides = F.array(*[F.struct(h.alias("h"), F.lit(own).alias("own")) for h, own in ((both("before", "meant"), False), (both("meant", "after"), False), (both("before", "form"), True), (both("form", "after"), True))])
    asked = hits.select("before", "form", "after", "meant").distinct().select("before", "form", "after", "meant", F.explode(sides).alias("q")).select("before", "form", "after", "meant", "q.h", "q.own").filter("h is not null")
    seen = asked.join(counted.filter("kind = 'p'").select(F.col("h").alias("ph"), "n"), F.col("h") == F.col("ph"))
    seen = seen.groupBy("before", "form", "after", "meant").agg(F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("fits"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"))
    names = ("before", "form", "after", "meant")
    seen = seen.select(*[F.col(c).alias(f"s_{c}") for c in names], "fits", "own")
    same = F.col("form") == F.col("s_form")
    for c in ("before", "after", "meant"):
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    hits = hits.join(seen, same, "left").fillna(0, ["fits", "own"])
    least = F.when(F.col("sure"), FITS_SURE).otherwise(FITS)
    good = hits.filter(F.col("odd") | ((F.col("fits") >= least) & (F.col("fits") >= 4 * F.col("own"))))
    return good.groupBy("k", "surface", "form").agg(F.max_by("meant", F.struct("fits", "n_meant", "meant")).alias("meant"))


def edges(read: DataFrame) -> DataFrame:
    """(k, line, running_head, page_number): lines above or below the body of a page that do not belong to it.

    A head's letters stand in the outer two lines of at least two pages of its document and hardly within its pages, nor,
    compared with how often they stand at an edge, within any page; or, below two such lines, in the third of five pages.
    """
    e = read.filter("kind = 'e'").select("k", "d", "pg", "line", "h", "top", "bottom", "marks")
    may = F.col("marks").bitwiseAND(HEAD) > 0
    outer = (F.col("top") < EDGE) | (F.col("bottom") < EDGE)
    per = e.filter("h <> 0").groupBy("d", "h", "pg").agg(F.max((outer & may).cast("int")).alias("o"), F.max((~outer & may).cast("int")).alias("m"), F.count_if(~outer).alias("n"))
    per = per.groupBy("d", "h").agg(F.sum("o").alias("n_outer"), F.sum(F.when(F.col("o") == 0, F.col("m")).otherwise(0)).alias("n_third"), F.sum("n").alias("n_readings")).filter("n_outer >= 2 or n_third >= 5")
    asked = per.groupBy("h").agg(F.sum("n_outer").alias("all_outer"), F.sum("n_third").alias("all_third"), F.sum("n_readings").alias("all_readings"))
    inside = read.filter("kind = 'i'").select(F.col("h").alias("ih"), F.col("d").alias("i_d"), "n").join(asked, F.col("ih") == F.col("h"), "left_semi").groupBy("i_d", "ih").agg(F.sum("n").alias("n_inside"))
    anywhere = inside.groupBy(F.col("ih").alias("ah")).agg(F.sum("n_inside").alias("all_inside"))
    heads = per.join(inside, F.col("d").eqNullSafe(F.col("i_d")) & (F.col("h") == F.col("ih")), "left").join(asked.withColumnRenamed("h", "qh"), F.col("h") == F.col("qh")).join(anywhere, F.col("h") == F.col("ah"), "left")
    heads = heads.fillna(0, ["n_inside", "all_inside"])
    # for a head of two lines the third is one within the page; a third line of heads stands there and hardly elsewhere
    two = "n_outer >= 2 and (n_inside + n_readings) * 5 <= n_outer and (all_inside + all_readings) * 20 <= all_outer"
    three = "n_third >= 5 and (n_inside + n_outer) * 5 <= n_third and (all_inside + all_outer) * 20 <= all_third"
    heads = heads.withColumns({"two": F.expr(two), "three": F.expr(three)}).filter("two or three")
    heads = heads.select(F.col("d").alias("hd"), F.col("h").alias("hl"), F.when(F.col("two"), F.col("n_outer")).otherwise(F.col("n_third")).alias("hp"), "three")
    at = e.join(heads, F.col("d").eqNullSafe(F.col("hd")) & (F.col("h") == F.col("hl")) & (outer | F.col("three")), "left")
    # a line as wide as the body that goes on without a blank line is the body, unless it recurs again and again
    head = F.coalesce(may & ((F.col("marks").bitwiseAND(LOOSE) > 0) | (F.col("hp") >= 5)) & F.col("hp").isNotNull(), F.lit(False))
    number = (F.col("marks").bitwiseAND(NUMBER) > 0) | (head & (F.col("marks").bitwiseAND(NUMBERED) > 0))
    found = at.select("k", "line", "top", "bottom", head.alias("running_head"), number.alias("page_number")).filter("running_head or page_number")
    # a line further in counts only where those between it and the edge are such lines themselves
    outer = found.groupBy(F.col("k").alias("ok")).agg(F.collect_set("top").alias("tops"), F.collect_set("bottom").alias("bottoms"))
    found = found.join(outer, F.col("k") == F.col("ok"))
    reach = lambda side, have: (F.col(side) <= EDGE) & (F.size(F.array_except(F.slice(F.array(*[F.lit(i) for i in range(1, EDGE + 1)]), F.lit(1), F.col(side)), F.col(have))) == 0)
    return found.filter(reach("top", "tops") | reach("bottom", "bottoms")).select("k", "line", "running_head", "page_number")


class Scanned:
    """The findings on the pages of one table, each a DataFrame.

    ``pages`` needs a unique key of each page reading, a document, a page number and the text; a confidence (a share or a
    percentage) is used where the column is there. Repeated rows count once; null and empty texts have no findings; other
    columns are not read.
    """

    def __init__(self, pages: DataFrame, key: str = "ocr_id", document: str = "document_id", page: str = "page", text: str = "text", confidence: str = "confidence"):
        self.key, self.text = key, text
        self.confidence = confidence if confidence in pages.columns else None
        self.pages = pages.select(*[F.col(c) for c in (key, document, page, text, *([self.confidence] if self.confidence else []))]).filter(F.col(text).isNotNull() & (F.col(text) != ""))
        self.read = stored(read_all(self.pages.dropDuplicates([key]), key, document, page, text), "kind")
        counts = self.read.filter("kind in ('w', 's')").groupBy("kind", "a").agg(F.sum("n").alias("n")).select("kind", "a", F.lit(None).cast("long").alias("h"), "n")
        pairs = self.read.filter("kind = 'p'").groupBy("h").agg(F.sum("n").alias("n")).select(F.lit("p").alias("kind"), F.lit(None).cast("string").alias("a"), "h", "n")
        self.counted = stored(counts.unionByName(pairs), "kind")
        self.rare = stored(misreadings(self.counted))
        top = self.counted.filter("kind = 'w'").orderBy(F.desc("n"), "a").limit(COMMON).select("a")
        rare = self.rare.select(F.col("form").alias("a")).distinct()
        self.common = [r["a"] for r in top.join(rare, "a", "left_anti").collect()]

    def misread(self) -> DataFrame:
        return misread(scan(self.pages, self.key, self.text, self.confidence, self.common), self.rare, self.counted)

    def defects(self) -> DataFrame:
        """(key, defect) with the defects hyphenation, characters, running_head and page_number."""
        at_edge = edges(self.read).select("k", F.explode(F.array_compact(F.array(F.when(F.col("running_head"), "running_head"), F.when(F.col("page_number"), "page_number")))).alias("defect"))
        out = divided(self.read, self.counted).filter("joins").select("k", F.lit("hyphenation").alias("defect")).unionByName(self.misread().select("k", F.lit("characters").alias("defect"))).unionByName(at_edge)
        return out.distinct().select(F.col("k").alias(self.key), "defect")

    def repaired(self) -> DataFrame:
        """(key, confidence, text): the pages as continuous paragraphs, parted by blank lines; a page without text but heads gives ''."""
        k = self.key
        once = stored(self.pages.dropDuplicates([k]))
        lines = once.select(F.col(k), F.posexplode(F.split(F.regexp_replace(self.text, "\r\n", "\n"), "\n")).alias("line", "t")).withColumn("blank", ~F.col("t").rlike(r"(?U)\S"))
        drop = edges(self.read).select(F.col("k").alias("dk"), F.col("line").alias("dl"))
        kept = lines.join(drop, (F.col(k) == F.col("dk")) & (F.col("line") == F.col("dl")), "left_anti")
        d = divided(self.read, self.counted).select(F.col("k").alias("vk"), F.col("line").alias("vl"), "joins", "compound").dropDuplicates(["vk", "vl"])
        kept = kept.join(d, (F.col(k) == F.col("vk")) & (F.col("line") == F.col("vl")), "left")
        w = Window.partitionBy(k).orderBy("line")
        kept = kept.withColumn("para", F.sum(F.col("blank").cast("int")).over(w)).filter(~F.col("blank"))
        t = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
        # a divided word loses its sign, a compound keeps it; all other lines are joined by a blank
        t = F.when(F.col("joins"), F.regexp_replace(t, rf"[{SOFT}‐‑\-]$", "")).when(F.col("compound"), t).when(t.rlike(r"[　-ヿ一-鿿＀-￯]$"), t).otherwise(F.concat(t, F.lit(" ")))
        paras = kept.groupBy(k, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", t.alias("t")))), lambda x: x["t"]), "").alias("p"))
        whole = paras.groupBy(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", F.regexp_replace("p", r"\s+$", "").alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
        s = F.col("surface")
        shaped = F.when((s == F.upper(s)) & (F.length(s) > 1) & s.rlike(r"\p{Lu}"), F.upper("meant")).when(F.substring(s, 1, 1) == F.upper(F.substring(s, 1, 1)), F.concat(F.upper(F.substring("meant", 1, 1)), F.expr("substring(meant, 2)"))).otherwise(F.col("meant"))
        fixes = self.misread().groupBy(F.col("k").alias("fk")).agg(F.collect_set(F.struct("surface", shaped.alias("meant"))).alias("fixes"))
        sure = F.when(F.col(self.confidence) > 1, F.col(self.confidence) / 100).otherwise(F.col(self.confidence)) if self.confidence else F.lit(None).cast("double")
        out = once.select(k, sure.alias("confidence")).join(whole.withColumnRenamed(k, "wk"), F.col(k) == F.col("wk"), "left").join(fixes, F.col(k) == F.col("fk"), "left")
        edge = r"[\p{L}\p{N}@|]"
        fixed = F.aggregate(
            F.coalesce("fixes", F.array().cast("array<struct<surface:string,meant:string>>")), F.coalesce("body", F.lit("")),
            lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(rf"(?<!{edge})\Q"), x["surface"], F.lit(rf"\E(?!{edge})")), x["meant"]),
        )
        return out.select(k, "confidence", fixed.alias("text"))
