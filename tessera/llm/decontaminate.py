"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in three readings. In the EXACT one every token is its lower-cased word. In
the others numbers, units (after a number) and names are typed placeholders: INSIDE has as names the
capitalised words inside a sentence, CAPITALS those that begin one as well, and there a name of several
words is one slot. Windows of WINDOW tokens (shorter items: of all their tokens) of the benchmark are
hash-joined with those of the documents, reading by reading; on each alignment the windows that follow
each other make a run, which must hold slot consistency: one benchmark value stands for one document
value and back (a name may be shortened to a part of it). A run of at least LEAST tokens (or of all of a
shorter item) is a leak, so a question with other numbers and names is caught and unrelated texts that
share a frame with clashing slots are not. Exact windows always count, so a copy is found whatever it
consists of; windows with placeholders count with LITERALS literal tokens (those of shorter items: with two).

Plan: both sides' windows are DataFrames, written once. Documents' windows are made where the texts lie
and leave there only if a bitmap of the benchmark's hashes has them (a kilobit a hash, at most 32 MB;
beyond 250,000 hashes it lets more windows through, which the join drops). What is left is
joined on the hash, and the windows of one text and item are checked in order as they stream by.

Defined cases: null and empty texts (either side) match nothing; items without a token match nothing;
null ids and repeated rows are reported row by row; an empty table on either side gives no leaks;
texts are scanned whole, one text at a time; other input columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import ship, written

WINDOW, LEAST, LITERALS, CACHE = 8, 10, 3, 400_000
LEAST_BITS, MOST_BITS, PAGE = 20, 28, 15
UNITS = frozenset(b"% percent km m cm mm mi mile miles ft foot feet inch inches in yd yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years dollar dollars cent cents usd eur euro euros degrees mph kmh kb mb gb tb".split())
NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*%?\Z")
GLUED = re.compile(rb"(\d)(?=(?:%|km|cm|mm|mi|ft|kg|mg|lbs?|oz|ml|hrs?|mph|kmh|kb|mb|gb|tb|m|g|l|s|h)(?![A-Za-z0-9]))", re.I)
EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c not in b"%")
NUM, UNIT, NAME = 1, 2, 3
READINGS = 3
EXACT, INSIDE, CAPITALS = range(READINGS)
_EMPTY, _NUM, _UNIT, _CAP, _END = 1, 2, 4, 8, 16
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """The code of a raw word: 48 bits of hash of its lower-cased core, then flags."""

    def __missing__(self, raw: bytes) -> int:
        core = raw.strip(EDGE)
        flags = _END if raw.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":") else 0
        if not core:
            flags |= _EMPTY
        elif NUMBER.match(core):
            flags |= _NUM
        elif core.lower() in UNITS:
            flags |= _UNIT
        if core and core.decode("utf-8", "replace")[0].isupper():
            flags |= _CAP
        low = core.decode("utf-8", "replace").lower().encode("utf-8", "replace")
        code = int.from_bytes(blake2b(low, digest_size=6).digest(), "big") << 8 | flags
        if len(self) >= CACHE:
            self.clear()
        self[raw] = code
        return code


def readings(text: bytes, codes: _Codes) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """(raw words, EXACT, INSIDE and CAPITALS readings): a reading is its symbols, NUM, UNIT, NAME or a hash above 3,
    and the raw words at which they begin, with the end."""
    raw = (GLUED.sub(rb"\1 ", text) if GLUED.search(text) else text).split()
    c = np.fromiter(map(codes.__getitem__, raw), np.int64, len(raw))
    keep = np.flatnonzero((c & _EMPTY) == 0)
    if len(keep) < len(raw):
        c, raw = c[keep], [raw[i] for i in keep.tolist()]
    if not len(c):
        return [], []
    start = np.ones(len(c), bool)
    start[1:] = (c[:-1] & _END) != 0
    number = (c & _NUM) != 0
    unit = (c & _UNIT) != 0
    unit[0] = False
    unit[1:] &= number[:-1]
    name = ((c & _CAP) != 0) & ~number & ~unit
    exact = (c >> 8).astype(np.uint64) + np.uint64(4)
    typed = exact.copy()
    typed[number], typed[unit] = NUM, UNIT
    inside, capitals = typed.copy(), typed
    inside[name & ~start], capitals[name] = NAME, NAME
    first = np.ones(len(c), bool)  # a name of several words is one slot, which ends with its sentence
    first[1:] = ~(name[1:] & name[:-1]) | start[1:]
    each, begins = np.arange(len(c) + 1), np.flatnonzero(first)
    return raw, [(exact, each), (inside, each), (capitals[begins], np.append(begins, len(c)))]


def window_hashes(sym: np.ndarray, size: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, may be matched) of each window of `size` symbols: exact ones always, others with enough literals."""
    n = len(sym) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    x = sym * MIX
    x ^= x >> np.uint64(29)
    h = np.full(n, size + 256 * reading, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += x[k : k + n]
    h ^= h >> np.uint64(32)
    if reading == EXACT:
        return h, np.ones(n, bool)
    literal = np.concatenate(([0], np.cumsum(sym > 3)))
    return h, literal[size:] - literal[:-size] >= min(LITERALS if size == WINDOW else 2, size)


def _same(a: str, b: str) -> bool:
    """Equal values, or a name and a part of it."""
    if a == b:
        return True
    x, y = set(a.split()), set(b.split())
    return x <= y or y <= x


def windows_of(text: bytes, codes: _Codes, sizes: Iterable[tuple[int, int]] | None = None, known=None) -> Iterator[tuple]:
    """(reading, size, position, hash, symbols in the reading, raw word at which each symbol and the end begin, slots).

    sizes: readings and window sizes (all readings in windows of up to WINDOW when None); known: which of an
    array of hashes are wanted. A slot is the placeholder and its value, None where a literal stands.
    """
    raw, read = readings(text, codes)
    for kind, size in [(k, min(WINDOW, len(x[0]))) for k, x in enumerate(read)] if sizes is None else sizes if raw else ():
        sym, begins = read[kind]
        h, ok = window_hashes(sym, size, kind)
        if known is not None and len(h):
            ok = ok & known(h)
        for p in np.flatnonzero(ok).tolist():
            slots = [f"{int(x)} {_value(raw, begins, p + k)}" if x <= NAME else None for k, x in enumerate(sym[p : p + size].tolist())]
            yield kind, size, p, int(h[p].astype(np.int64)), len(sym), begins[p : p + size + 1].tolist(), slots


def _value(raw: list[bytes], begins: np.ndarray, p: int) -> str:
    return b" ".join(x.strip(EDGE) for x in raw[begins[p] : begins[p + 1]]).decode("utf-8", "replace").lower()


def runs_of(matches: Iterable[tuple]) -> list[tuple[int, int, int]]:
    """(first word, end word, changed slots) of the runs of one text and one item.

    matches: (reading, size, p, q, symbols of the item, begins, slots at p, slots at q) of their equal windows.
    Of runs in several readings those that lie within another reading's are left out.
    """
    by: dict[tuple, list[tuple]] = {}
    for m in matches:
        by.setdefault((m[0], m[2] - m[3]), []).append(m)
    found = [(kind, x) for (kind, _), ms in by.items() for x in _consistent(sorted(ms, key=lambda m: m[2]))]
    kept: list[tuple] = []
    for kind, x in sorted(found, key=lambda f: (f[1][0] - f[1][1], f[1][2], f[0])):
        if not any(k != kind and y[0] <= x[0] and x[1] <= y[1] for k, y in kept):
            kept.append((kind, x))
    return [x for _, x in kept]


def _consistent(ms: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Runs of one alignment, whose windows stand in order."""
    size, symbols = ms[0][1], ms[0][4]
    starts = [m[2] for m in ms]
    begins = {m[2] + k: x for m in ms for k, x in enumerate(m[5])}
    slots = {m[2] + k: (a, b) for m in ms for k, (b, a) in enumerate(zip(m[6], m[7])) if b is not None}
    need, k = min(LEAST, symbols), 0
    while k < len(starts):
        first = end = starts[k]
        to: dict[str, str] = {}
        back: dict[str, str] = {}
        changed, clash = 0, None
        while k < len(starts) and starts[k] <= end and clash is None:
            for p in range(end, starts[k] + size):
                if p in slots:
                    a, b = slots[p]
                    if not _same(to.setdefault(a, b), b) or not _same(back.setdefault(b, a), a):
                        clash = p
                        break
                    changed += a != b
                end = p + 1
            else:
                k += 1
        if end - first >= need:
            yield begins[first], begins[end], changed
        if clash is not None:  # begin anew with the windows after the run's first that reach the clash
            k = bisect_right(starts, max(first, clash - size))


_COLUMNS = "row bigint, {id}, kind int, size int, p int, h bigint, symbols int, begins array<int>, slots array<string>"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]


def _windows(texts: DataFrame, ids: str, name: str, sizes: list[tuple[int, int]] | None = None, bits=None) -> DataFrame:
    """Window rows of (id columns ..., text), written: `row` numbers the texts. ids: the schema of the id columns."""
    id_types = [to_arrow_type(f.dataType) for f in texts.schema.fields[:-1]]
    schema = _COLUMNS.replace("{id}", ids)
    names = ["row", *texts.columns[:-1], "kind", "size", "p", "h", "symbols", "begins", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, row, known = _Codes(), TaskContext.get().partitionId() << 33, None
        if bits is not None:
            page = np.frombuffer(bits.value[1], np.uint8)
            shift = np.uint64(64 - bits.value[0])
            coarse = np.unpackbits(page, bitorder="little").reshape(1 << LEAST_BITS, -1).any(axis=1)  # fits a core's cache

            def known(h: np.ndarray) -> np.ndarray:
                out = coarse[(h >> np.uint64(64 - LEAST_BITS)).astype(np.int64)]
                maybe = np.flatnonzero(out)
                if len(maybe):
                    at = h[maybe] >> shift
                    out[maybe] = (page[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                return out

        def out(rows: list[tuple], of: list[int], b: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
            take = pa.array(at, pa.int64())
            ids = [b.column(k).take(take).cast(t) for k, t in enumerate(id_types)]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *ids, *[pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]], names)

        for b in batches:
            rows, of, at = [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).cast(pa.binary())):
                for x in windows_of(t.as_py() or b"", codes, sizes, known):
                    rows.append(x), of.append(row), at.append(i)
                row += 1
                if len(rows) >= 20_000:
                    yield out(rows, of, b, at)
                    rows, of, at = [], [], []
            if rows:
                yield out(rows, of, b, at)

    return written(texts.mapInArrow(run, schema), name)


def _bitmap(windows: DataFrame):
    """(bits of a bucket number, bitmap of the buckets that hold a hash) of the windows' hashes: 32 MB at most."""
    n = windows.count()
    width = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 10))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for x in b.column(1):
                flags = np.zeros(1 << PAGE, bool)
                flags[x.values.to_numpy()] = True
                pages.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.binary())], ["page", "bits"])

    bucket = windows.select(F.shiftrightunsigned("h", 64 - width).alias("b")).distinct()
    pages = bucket.groupBy(F.shiftright("b", PAGE).cast("int").alias("page")).agg(F.collect_set((F.col("b") % (1 << PAGE)).cast("int")).alias("in"))
    out = bytearray(1 << width - 3)
    for page, part in pages.mapInArrow(pack, "page int, bits binary").toLocalIterator():
        out[page << PAGE - 3 : page + 1 << PAGE - 3] = part
    return width, bytes(out)


def _matches(docs: DataFrame, keys: dict[str, Column], text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The columns `keys` of each text, _item, and first, end and changed of each run."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{item_text}`").alias("_text"))
    kind = items.schema["_item"].dataType.simpleString()
    theirs = _windows(items, f"_item {kind}", "benchmark-windows")
    sizes = sorted(map(tuple, theirs.select("kind", "size").distinct().collect()))  # at most READINGS * WINDOW
    own = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text}`").alias("_text"))
    ids = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    ours = _windows(own, ids, "document-windows", sizes, spark.sparkContext.broadcast(_bitmap(theirs)))
    join = theirs.select("h", "kind", "size", F.col("row").alias("item"), "_item", F.col("p").alias("q"), F.col("symbols").alias("of"), F.col("slots").alias("there"))
    both = ours.drop("symbols").join(join, ["h", "kind", "size"]).select("row", "item", *keys, "_item", "kind", "size", "p", "q", "of", "begins", "slots", "there")
    both = both.repartition("row", "item").sortWithinPartitions("row", "item")
    names = [*keys, "_item", "first", "end", "changed"]
    types = [to_arrow_type(both.schema[k].dataType) for k in names[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 1000) for r in zip(*(c.to_pylist() for c in b.slice(k, 1000).columns)))
        out = []
        for _, group in groupby(rows, key=lambda r: r[:2]):
            group = list(group)
            out += [(*group[0][2 : 2 + len(types)], *x) for x in runs_of(r[2 + len(types) :] for r in group)]
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*types, *[pa.int64()] * 3))], names)

    return both.mapInArrow(run, f"{ids}, _item {kind}, first bigint, end bigint, changed bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per run: id, item, first_token, n_tokens, n_changed (slots with another value)."""
    found = _matches(docs, {"_id": F.col(f"`{id_col}`")}, text, benchmark, item_id, item_text)
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id), F.col("first").alias("first_token"), (F.col("end") - F.col("first")).alias("n_tokens"), F.col("changed").alias("n_changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The input's rows and columns without texts that hold a leak.

    Whether a text leaks depends on the text alone, so the rows are found again by 128 bits of its hash.
    """
    t = F.col(f"`{text}`")
    keys = {"_a": F.xxhash64(t), "_b": F.xxhash64(F.lit(7), t)}
    gone = written(_matches(docs, keys, text, benchmark, item_id, item_text).select("_a", "_b").distinct(), "leaks")
    return docs.join(gone, (keys["_a"] == gone["_a"]) & (keys["_b"] == gone["_b"]), "left_anti")
