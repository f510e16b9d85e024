"""Text read in the wrong encoding: found and, where possible, restored.

Every line with characters beyond ASCII is taken as the end of a chain of misreadings. A step back writes the line as bytes of
a legacy encoding and reads them as they were meant: as UTF-8 where a run is valid UTF-8 in those bytes, as another single-byte
encoding, or as one of the double-byte encodings of East Asia. Each candidate line is compressed with a zstandard dictionary for each language;
its description length is the least compressed size, plus the cost of its steps, plus a cost for each character and each
pair of neighbours beyond ASCII that the dictionaries do not have (a compressor writes any new byte for the same price,
and undoing a step always saves bytes, so without it a lucky pair like an apostrophe and an accented letter would be taken
for damage). All chains are measured: of any number of steps
back to UTF-8 (each leaves fewer characters) and at most one step of another kind, at any place in the chain, also where a
step by itself does not shorten the description. The chain with the least description length is taken; if that is the line as
it stands, it is left unchanged. A line whose characters and pairs are all known is not asked for steps that keep its length.
Lines are judged one by one, so that damage in one place does not touch the rest of a text.

Dictionaries and the known characters and pairs come from counts over all lines beyond ASCII of all texts for which no step to
UTF-8 is possible, sorted to languages by their n-gram profiles; the fixed seed texts are added. A dictionary has room for
``DICTIONARY`` bytes: the words that save most for their room, by their number and length. What stands in one text only counts for nothing, so
that a damaged line does not vouch for itself.

What cannot be restored is still reported: U+FFFD, and control characters (U+0080 to U+009F, but for the line end U+0085) left
by bytes that were no text in the encoding they were read in.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from heapq import heappop, heappush

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.language import SEEDS, Profiles
from papyra.session import discard, stored

DICTIONARY = 16_384
#: Bytes that a compressor spends on naming a word of the dictionary, about.
MATCH = 3
#: Different words and units a task counts before it hands its counts on, and lines whose kind it remembers.
HELD, REMEMBERED = 200_000, 20_000
#: Costs of a step in bytes: back to UTF-8, and between single-byte encodings, which is nearly always possible.
COST_UTF8, COST_SINGLE = 1, 4
#: Costs in bytes of a character and of a pair that no dictionary has.
NEW_CHARACTER, NEW_PAIR = 4, 2

# Encodings in which UTF-8 is misread, and pairs (read as, meant as) of single-byte encodings.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "cp866", "koi8_r", "iso8859_15", "cp1253", "mac_cyrillic", "cp1254", "iso8859_2", "cp852"]
SINGLE = [
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1253"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
    ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1253", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "iso8859_2"), ("cp1254", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp866", "cp1251"), ("cp1251", "cp866"),
]
# Double-byte encodings, read as a single-byte one, and in which UTF-8 is misread.
DOUBLE = ["gbk", "shift_jis", "euc_jp", "big5", "euc_kr"]

_RUN = re.compile(r"[^\x00-\x7f]+")
_TWO = re.compile(r"[^\x00-\x7f]{2}")
_LETTER = re.compile(r"[^\W\d_\x00-\x7f]")
_MIXED = re.compile("[A-Za-z][\u0370-\u052f]|[\u0370-\u052f][A-Za-z]")
_FOREIGN = {(a, b) for a, b in SINGLE if a in ("cp1251", "koi8_r", "cp866", "cp1253") and b == "cp1252"}
_EAST = re.compile("[぀-ヿ㐀-鿿가-힯]")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def _table(name: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; bytes without a character are those of the control characters, as many readers do."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    used = set(out.values())
    for b in range(0x80, 0x100):
        # readers differ in undefined bytes, and some in all control bytes
        if b not in used or b < 0xA0:
            out.setdefault(chr(b), b)
    return out


def _read(name: str) -> dict[int, str]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = "\x80"
    return out


_TABLES = {name: _table(name) for name in {*READ_AS, *(a for a, _ in SINGLE)}}
_TRANSLATIONS = {(a, b): {ord(ch): _read(b)[byte] for ch, byte in _TABLES[a].items()} for a, b in SINGLE}


def _plausible(text: str) -> bool:
    return all(unicodedata.category(ch) not in ("Cc", "Cn", "Co", "Cs") for ch in text if ch > "\x7f")


def back_to_utf8(line: str, name: str) -> str | None:
    """The line with all runs that are valid UTF-8 in the bytes of ``name`` read as such; None if there is none."""
    table, changed = _TABLES[name], False

    def fix(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        try:
            raw = bytes([table[ch] for ch in run])
        except KeyError:
            return run
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return run
        changed = True
        return text

    out = _RUN.sub(fix, line)
    return out if changed else None


def _double(line: str, name: str) -> str | None:
    """The line's bytes in cp1252 read in a double-byte encoding; None if they are no text in it or give no such sign."""
    table = _TABLES["cp1252"]
    try:
        new = bytes([ord(ch) if ch <= "\x7f" else table[ch] for ch in line]).decode(name)
    except (KeyError, UnicodeDecodeError):
        return None
    return new if _EAST.search(new) else None


def _from_double(line: str, name: str) -> str | None:
    """The line with the runs that are valid UTF-8 in the bytes of a double-byte encoding read as such; None if there is none."""
    changed = False

    def fix(m: re.Match) -> str:
        nonlocal changed
        try:
            text = m.group().encode(name).decode("utf-8")
        except UnicodeError:
            return m.group()
        changed = True
        return text

    out = _RUN.sub(fix, line)
    return out if changed else None


def candidates(line: str, single: bool = True) -> list[tuple[str, str, int]]:
    """(line, step, cost) of all single steps back; without ``single`` only those to UTF-8, which leave fewer characters."""
    out, seen = [], {line}

    def add(new: str | None, step: str, cost: int) -> None:
        if new is not None and new not in seen:
            seen.add(new)
            out.append((new, step, cost))

    # a single byte beyond ASCII is no UTF-8
    if _TWO.search(line):
        for name in READ_AS:
            add(back_to_utf8(line, name), f"{name}>utf-8", COST_UTF8)
    if _EAST.search(line):
        for name in DOUBLE:
            add(_from_double(line, name), f"{name}>utf-8", COST_SINGLE)
    if single and _LETTER.search(line):
        for pair, translation in _TRANSLATIONS.items():
            # Latin text read in an encoding of another script has signs of both within words; a word of that script is no such text
            if pair in _FOREIGN and not _MIXED.search(line):
                continue
            table = _TABLES[pair[0]]
            if all(ch <= "\x7f" or ch in table for ch in line):
                new = line.translate(translation)
                add(new if _plausible(new) else None, f"{pair[0]}>{pair[1]}", COST_SINGLE)
        if _TWO.search(line):
            for name in DOUBLE:
                add(_double(line, name), f"cp1252>{name}", COST_SINGLE)
    return out


def units(text: str) -> set[str]:
    """Characters beyond ASCII and pairs with one."""
    out: set[str] = set()
    for m in _RUN.finditer(text):
        a, b = m.span()
        out.update(m.group())
        # ASCII neighbours count as letter, digit, blank or other sign
        run = _kind(text[a - 1 : a]) + m.group() + _kind(text[b : b + 1])
        out.update(map("".join, zip(run, run[1:])))
    return out


def _kind(ch: str) -> str:
    return ch.lower() if ch.isalpha() else "0" if ch.isdigit() else " " if not ch or ch.isspace() else "."


class Restorer:
    def __init__(self, dictionaries: dict[str, bytes], known: Iterable[str] | None = None):
        self.compress = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=3, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        self.seen: dict[str, tuple[str, str]] = {}
        self.known = set().union(*(units(raw.decode()) for raw in dictionaries.values())) if known is None else set(known)

    def length(self, line: str) -> int:
        raw = line.encode("utf-8", "surrogatepass")
        new = units(line) - self.known
        return min(len(c(raw)) for c in self.compress) + sum(NEW_CHARACTER if len(u) == 1 else NEW_PAIR for u in new)

    def line(self, line: str) -> tuple[str, str]:
        """(restored line, chain of steps); the chain is empty for a line left unchanged."""
        hit = self.seen.get(line)
        if hit is None:
            hit = self._line(line)
            if len(self.seen) > 20_000:
                self.seen.clear()
            if len(line) < 4000:
                self.seen[line] = hit
        return hit

    def _line(self, line: str) -> tuple[str, str]:
        def ask(now: str, used: bool) -> list[tuple[str, str, int]]:
            # what is known throughout gains nothing by a step that keeps its length
            return candidates(now, not used and not units(now) <= self.known)

        options = ask(line, False)
        if not options:
            return line, ""
        best, chosen, chain = self.length(line), line, ""
        reached: set[str] = set()
        # cheapest chains first, so each text is reached by its cheapest
        todo = [(0, 0, "", line, False)]
        while todo:
            paid, n, steps, now, used = heappop(todo)
            if now in reached:
                continue
            reached.add(now)
            if n:
                size = self.length(now) + paid
                if size < best:
                    best, chosen, chain = size, now, steps
                options = ask(now, used)
            for new, step, cost in options:
                if new not in reached:
                    heappush(todo, (paid + cost, n + 1, f"{steps} {step}".strip(), new, used or not step.endswith("utf-8")))
        return chosen, chain

    def text(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, chains used, whether characters are lost for good)."""
        if text.isascii():
            return text, [], False
        chains: dict[str, None] = {}
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if not line.isascii():
                lines[i], chain = self.line(line)
                if chain:
                    chains[chain] = None
        out = "\n".join(lines)
        return out, list(chains), _LOST.search(out) is not None


class Evidence:
    """Words and units of the lines that allow no step back to UTF-8, with the kind of line: a language, or signs in none."""

    def __init__(self):
        self.profiles = Profiles.seeds()
        self.kinds: dict[str, str | None] = {}

    def kind(self, line: str) -> str | None:
        if line in self.kinds:
            return self.kinds[line]
        letters = sum(ch.isalpha() for ch in line)
        if _LOST.search(line) or candidates(line, False):
            kind = None
        elif letters < 24:
            kind = "signs"
        else:
            code, sure = self.profiles.detect(line)
            kind = code if code and sure >= 0.1 else None
        if len(self.kinds) > REMEMBERED:
            self.kinds.clear()
        if len(line) < 4000:
            self.kinds[line] = kind
        return kind

    def count(self, text: str) -> Counter[tuple[str, str]]:
        """How often each (kind, word) occurs in the text, and each ("", unit) in how many of its lines."""
        out: Counter[tuple[str, str]] = Counter()
        for line in text.split("\n"):
            line = line.strip()
            if line.isascii():
                continue
            kind = self.kind(line)
            if kind:
                out.update(("", u) for u in units(line))
                out.update((kind, w) for w in _words(line))
        return out


def _words(line: str) -> Iterator[str]:
    """Words between blanks; of Chinese and Japanese ones all parts of four signs."""
    for word in line.split():
        if len(word) > 4 and _EAST.search(word):
            yield from (word[i : i + 4] for i in range(len(word) - 3))
        else:
            yield word


def _dictionaries(ranked: Iterable[tuple[str, str]]) -> dict[str, bytes]:
    """A dictionary for each kind from its seed and (kind, word), the words that save most first; these come to stand last."""
    found: dict[str, list[bytes]] = {code: [] for code in SEEDS} | {"signs": []}
    left = {kind: DICTIONARY - len(SEEDS.get(kind, "").encode()) - 1 for kind in found}
    for kind, word in ranked:
        raw = word.encode("utf-8", "ignore") + b" "
        if len(raw) <= left[kind]:
            found[kind].append(raw)
            left[kind] -= len(raw)
    out = {kind: SEEDS.get(kind, "").encode() + b"\n" + b"".join(reversed(words)) for kind, words in found.items()}
    return {kind: raw for kind, raw in out.items() if raw.strip()}


def fit_dictionaries(texts: Iterable[str]) -> dict[str, bytes]:
    """Dictionaries of texts that are taken as they are, one of them being enough for a word."""
    evidence, counts = Evidence(), Counter()
    for text in texts:
        counts += evidence.count(text)
    sized = ((len(w.encode("utf-8", "ignore")), n, kind, w) for (kind, w), n in counts.items() if kind)
    ranked = sorted((-n * (size - MATCH) / (size + 1), kind, w) for size, n, kind, w in sized)
    return _dictionaries((kind, w) for _, kind, w in ranked)


def fit(texts: DataFrame) -> tuple[dict[str, bytes], set[str]]:
    """(dictionaries, known units) from counts over all rows of the one column of texts; what only one text has is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence()
        held: dict[tuple[str, str], list[int]] = {}

        def batch_of() -> pa.RecordBatch:
            columns = [[k for k, _ in held], [u for _, u in held], *([v[i] for v in held.values()] for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 3))], names=["kind", "unit", "n", "low", "high"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                name = int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), signed=True)
                for key, n in evidence.count(text).items():
                    old = held.get(key)
                    held[key] = [old[0] + n, min(old[1], name), max(old[2], name)] if old else [n, name, name]
                if len(held) > HELD:
                    yield batch_of()
                    held.clear()
        yield batch_of()

    counts = texts.mapInArrow(run, "kind string, unit string, n long, low long, high long").groupBy("kind", "unit")
    # different texts have different names: with two of them the lowest and the highest differ
    counts = counts.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    counts = stored(counts.select("kind", "unit", "n"))
    size = F.octet_length("unit")
    saved = Window.partitionBy("kind").orderBy((F.col("n") * (size - MATCH) / (size + 1)).desc(), "unit")
    # a word takes two bytes at least
    top = counts.filter("kind <> ''").withColumn("rank", F.row_number().over(saved)).filter(F.col("rank") <= DICTIONARY // 2)
    ranked = sorted((r["kind"], r["rank"], r["unit"]) for r in top.select("kind", "rank", "unit").collect())
    known = {r["unit"] for r in counts.filter("kind = ''").select("unit").collect()}
    discard(counts)
    return _dictionaries((kind, word) for kind, _, word in ranked), known.union(*map(units, SEEDS.values()))


def restore(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, chains, lost) of the rows whose text was misread, in one place or throughout.

    restored is the text with all that can be restored, chains the steps back that were taken, lost whether characters remain
    that cannot be. Null, empty and ASCII texts are never affected. Repeated rows are judged alike and kept; other columns are
    not read.
    """
    rows = df.select(F.col(key), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7f]"))
    shared = df.sparkSession.sparkContext.broadcast(fit(rows.select("t")))
    schema = T.StructType([df.schema[key], T.StructField("restored", T.StringType()), T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("lost", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                at, cols = [], ([], [], [])
                for i, value in enumerate(part.column(1).to_pylist()):
                    out, chains, lost = restorer.text(value)
                    if chains or lost:
                        at.append(i)
                        for col, v in zip(cols, (out, chains, lost)):
                            col.append(v)
                arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)
