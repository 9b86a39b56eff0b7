"""Byte-level BPE by a pair occurrence index, with decoding.

All distinct pre-tokens of a chunk of a partition are laid out in one array of symbols. An index maps
each mergeable pair, by its rank, to all its positions; ranks are applied in ascending order, each to
its whole list at once, and the pairs that its merges make beside them are added to their lists. A
pair of one symbol with itself can overlap, so its list is taken from left to right.

The vocabulary file is read on the driver and broadcast (about 1.5 MB, fixed by the file). Memory is
bounded by one Arrow batch and by a chunk: CHUNK characters of words not met before (and what one text
adds to them), or numbers for the words of 16 times as much text. Up to KEEP words with their ids are
kept from chunk to chunk. A very long text costs memory in proportion to its own length.

Defined cases: null and empty texts give no ids; the strings of special tokens in a text become their
ids, as the tokenizers library does by default; null ids and repeated rows are kept row by row; an
empty table gives an empty result; other input columns aren't read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import ship

CHUNK, KEEP = 1_500_000, 600_000
BETWEEN = "\u2029"
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class _Numbers(dict):
    """Numbers texts in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Units(dict):
    """Numbers the words between single spaces, in the list of a _Memory that is shared with other starts.

    No pre-token goes on past a word's end, and none depends on what stands beyond a single space, so
    a word and the space before it are cut alike everywhere. A word that is empty or begins or ends
    with white space has a longer run of it beside it: KeyError, the text is then cut as a whole.
    """

    def __init__(self, start: str | None, memory: "_Memory"):
        super().__init__()
        self.start, self.memory = start, memory

    def __missing__(self, key: str) -> int:
        if self.start is not None and (not key or key[0].isspace() or key[-1].isspace()):
            raise KeyError(key)
        memory = self.memory
        n = self[key] = len(memory.made) + len(memory.new)
        memory.new.append(key if self.start is None else self.start + key)
        memory.cut.append(self.start is None)
        memory.new_size += len(key) + 1
        return n


class _Memory:
    """Numbered units and what `make` made of their ids; kept from chunk to chunk up to KEEP units."""

    def __init__(self, make):
        self.make = make
        self._clear()

    def _clear(self) -> None:
        self.first, self.others, self.whole = _Units("", self), _Units(" ", self), _Units(None, self)
        self.made: list = []
        self.new: list[str] = []
        self.cut: list[bool] = []  # whether it is a pre-token already
        self.new_size = 0

    def begin(self) -> None:
        if len(self.made) > KEEP:
            self._clear()

    def extend(self, codec: "PairIndexBPE") -> None:
        words = codec.of_units([u for u, c in zip(self.new, self.cut) if not c])
        others = iter(codec.of_pre_tokens([u for u, c in zip(self.new, self.cut) if c]))
        self.made.extend(self.make(next(others if c else words)) for c in self.cut)
        self.new, self.cut, self.new_size = [], [], 0


def byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PairIndexBPE:
    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab: dict[str, int] = data["model"]["vocab"]
        names = byte_names()
        back = {c: b for b, c in names.items()}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], np.int32)
        merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        keys = sorted(merges)
        self.keys = np.array([*keys, 1 << 62], np.int64)
        self.rank_of = np.array([*(merges[k][0] for k in keys), -1], np.int64)
        self.made_by = {rank: (k >> 32, k & 0xFFFFFFFF, made) for k, (rank, made) in merges.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.piece: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall

    def _index(self, where: dict[int, list[np.ndarray]], left: np.ndarray, a: np.ndarray, b: np.ndarray, heap: list[int] | None) -> None:
        """Adds the mergeable pairs (a, b) at the positions left to the lists of their ranks."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        hit = np.flatnonzero(self.keys[at] == key)
        if not len(hit):
            return
        ranks, places = self.rank_of[at[hit]], left[hit]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts) if len(cuts) else [places]):
            have = where.get(rank)
            if have is None:
                where[rank] = [part]
                if heap is not None:
                    heapq.heappush(heap, rank)
            else:
                have.append(part)

    def merge(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; all are merged together through one pair index."""
        if not tokens:
            return []
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.array([len(x) + 1 for x in raw])
        ends = np.cumsum(sizes)
        sym = np.full(ends[-1], -1, np.int32)  # a -1 ends each pre-token: no pair crosses it
        inside = np.ones(len(sym), bool)
        inside[ends - 1] = False
        sym[inside] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        after, before = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
        where: dict[int, list[np.ndarray]] = {}
        here = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0)).astype(np.int32)
        self._index(where, here, sym[here], sym[here + 1], None)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            parts = where.pop(rank)
            a, b, made = self.made_by[rank]
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[sym[p] == a]
            q = after[p]
            ok = sym[q] == b
            p, q = p[ok], q[ok]
            if len(p) > 1 and (len(parts) > 1 or a == b):
                p = np.unique(p)
                if a == b:
                    free, last = [], -1
                    for x, y in zip(p.tolist(), after[p].tolist()):
                        if x != last:
                            free.append(x)
                            last = y
                    p = np.array(free, np.int32)
                q = after[p]
            if not len(p):
                continue
            r, l = after[q], before[p]
            sym[p], sym[q] = made, -2
            after[p], before[r] = r, p
            c = sym[r]
            k = np.flatnonzero(c >= 0)
            if len(k):
                self._index(where, p[k], np.full(len(k), made, np.int32), c[k], heap)
            k = np.flatnonzero(l >= 0)
            l = l[k]
            c = sym[l]
            k = np.flatnonzero(c >= 0)
            if len(k):
                self._index(where, l[k], c[k], np.full(len(k), made, np.int32), heap)
        left = sym >= 0
        upto = np.concatenate(([0], np.cumsum(left)[ends - 1])).tolist()
        ids = sym[left].tolist()
        return [ids[x:y] for x, y in zip(upto, upto[1:])]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens, and special tokens as they stand."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        return [x for part in self.split.split(text) if part for x in ([part] if part in self.special else self.find(part))]

    def chunks(self, texts: Iterable[tuple[object, str]], units: "_Memory") -> Iterator[list[tuple[object, array]]]:
        """(key, unit numbers) of each (key, text), whenever CHUNK characters of new units or 16 times as
        many of text have come; the new units are then encoded.

        A unit is a word with the space before it; in texts with longer white space, a pre-token.
        """
        done, size = [], 0
        for key, t in texts:
            if not done:
                units.begin()
            size += len(t)
            try:
                if not t or any(s in t for s in self.special):
                    raise KeyError
                head, *rest = t.split(" ")
                numbers = array("i", [units.first[head]])
                numbers.extend(map(units.others.__getitem__, rest))
            except KeyError:
                numbers = array("i", map(units.whole.__getitem__, self.cut(t)))
            done.append((key, numbers))
            if units.new_size >= CHUNK or size >= 16 * CHUNK:
                units.extend(self)
                yield done
                done, size = [], 0
        units.extend(self)
        yield done

    def of_pre_tokens(self, tokens: list[str]) -> list[list[int]]:
        ids = self.merge(["" if t in self.special else t for t in tokens])
        for k, t in enumerate(tokens):
            if t in self.special:
                ids[k] = [self.special[t]]
        return ids

    def of_units(self, units: list[str]) -> Iterator[list[int]]:
        """Ids of each unit: all their distinct pre-tokens go through one pair index."""
        pre = _Numbers()
        cuts: list[list[int]] = [[]]
        apart = BETWEEN.join(units)
        if apart.count(BETWEEN) == len(units) - 1:  # a space of its own kind is a pre-token between two units
            for x in self.find(apart):
                if x == BETWEEN:
                    cuts.append([])
                else:
                    cuts[-1].append(pre[x])
        if len(cuts) != len(units):
            cuts = [[pre[x] for x in self.find(u)] for u in units]
        ids = self.merge(list(pre))
        for c in cuts:
            yield ids[c[0]] if len(c) == 1 else [i for n in c for i in ids[n]]

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        units = _Memory(list)
        for done in self.chunks(((None, t) for t in texts), units):
            for _, p in done:
                yield [i for t in p for i in units.made[t]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, PairIndexBPE] = {}


def _codec(spec: str) -> PairIndexBPE:
    """One codec for a worker and vocabulary."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PairIndexBPE(spec)
    return _CODECS[key]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """(id, text) row by row."""
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            yield i, t.as_py() or ""


def _setup(df: DataFrame, path: str):
    ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id and ids (array<int>)."""
    shared = _setup(docs, path)
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, units = _codec(shared.value), _Memory(lambda x: array("i", x))
        for done in codec.chunks(_rows(batches), units):
            for k in range(0, len(done), 256):
                some = done[k : k + 256]
                ids = [np.concatenate([units.made[t] for t in p]) if p else [] for _, p in some]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], id_type), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: id and text; a null list gives the empty text."""
    shared = _setup(encoded, path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = pa.array([codec.decode(x or []) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), out], [id_col, "text"])

    return encoded.select(f"`{id_col}`", f"`{ids}`").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id, n_tokens, ids_sha256, decoded_sha256.

    What a pre-token contributes to either digest is made from its ids once and kept with them.
    """
    shared = _setup(docs, path)
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        piece = codec.piece
        digits = {i: str(i).encode() for i in piece}
        units = _Memory(lambda x: (len(x), b",".join([digits[i] for i in x]), b"".join([piece[i] for i in x])))
        for done in codec.chunks(_rows(batches), units):
            n, a, d = [], [], []
            for _, p in done:
                count, said, made = zip(*map(units.made.__getitem__, p)) if p else ((), (), ())
                n.append(sum(count))
                a.append(sha256(b",".join(said)).hexdigest())
                d.append(sha256(b"".join(made).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], id_type), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
