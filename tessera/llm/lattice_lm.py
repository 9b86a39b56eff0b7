"""Language-model scores from a subword lattice.

A text is a sequence of lower-cased words and one end. The lattice of a word has as edges the pieces of
an existing vocabulary, weighted by its scores, and one edge for the whole word if training texts hold
it (its discounted share of their tokens). A forward recursion in log space adds up all paths:

    P(word) = max(c - d, 0) / N + d V / N * sum over segmentations of first(p1) next(p2) ... stop.

Training moves the vocabulary's scores: expected counts over all segmentations of all training words,
each of which counts once (every word, however frequent, leaves the same discount d to the
segmentations), with the present weights as a prior of PRIOR of their number, in each of ROUNDS rounds.
A text's score is the sum over its words and its end, log base 10.

Plan: texts are read once, where they lie. Each block of a partition's text becomes a table of its
distinct words, with their training counts, and its texts as lists of word numbers, so no text is
shuffled. Totals come from one aggregation, each distinct word is scored once, and every block gets
back the scores of its own words. A word is one row a block; words in a great share of the blocks (at
most HOT of them, by construction) are joined by broadcast, so no join key is hot. Besides them only the
piece weights are broadcast: their number is the vocabulary's. A task holds one block, about BLOCK_BYTES
of text or one text that is longer.

Defined cases: null and empty texts consist of the end; repeated rows count and are scored row by row;
a null id is in fold 0, held out; with no training rows N = 0, base_score is 0 times its tokens' log10
of 0.1 / 0.1 and the lattice keeps the vocabulary's own weights; very long words go through the lattice
in parts (_ENDS places at a time), with 16 bytes a character; an empty table gives an empty result;
other input columns aren't read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import fold, ship, whole, written

MARK = "▁"
ROUNDS, DISCOUNT, PRIOR = 2, 0.5, 0.05
BLOCK_BYTES, HOT = 32_000_000, 2000
_CELLS, _ENDS = 60_000, 4096
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def _sum_of(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials along axis 1; -inf where there is nothing to add."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))


class Lattice:
    """Piece weights: `first` for pieces that begin with the mark, `next` for others and the stop.

    Edges are found by rolling 64-bit hashes of all substrings up to the longest piece; the pieces' own
    hashes are checked to differ, so only a substring that is no piece could be taken for one, by chance
    (below 1e-14 a substring).
    """

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self._index: tuple | None = None

    def __getstate__(self):
        return self.pieces, self.log_p

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> "Lattice":
        """Pieces of a sentencepiece model with its scores as log weights; scores that are ranks (0, -1, -2 ...,
        as in BPE models) stand for weights 1 / (rank + 10)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        found = [(p, s) for p, s in found if p.count(MARK) == 0 or p[0] == MARK and MARK not in p[1:]]  # others span words
        pieces = [p for p, _ in found]
        ranks = all(s <= 0 and s == int(s) for _, s in found)
        weight = np.array([1 / (10 - s) if ranks else math.exp(s) for _, s in found])
        rest = [1 / 20, 1 / 20, 1 / 5, 0.0] if ranks else [weight.min(), weight.min(), weight.sum() / 5, 0.0]
        return cls(pieces, cls.normalised(pieces, np.concatenate((weight, rest))))

    @staticmethod
    def normalised(pieces: list[str], weight: np.ndarray) -> np.ndarray:
        """After the pieces: an unknown character (first, next), the stop, and an edge that isn't there."""
        n = len(pieces)
        first = np.array([p[0] == MARK for p in pieces] + [True, False, False, False])
        rest = ~first
        rest[n + 3] = False
        out = np.full(n + 4, -np.inf)
        with np.errstate(divide="ignore"):
            out[first] = np.log(weight[first] / weight[first].sum())
            out[rest] = np.log(weight[rest] / weight[rest].sum())
        return out

    def fitted(self, counts: np.ndarray, prior: float = PRIOR) -> "Lattice":
        """Weights by expected counts, to which the present weights add `prior` of their number."""
        n = len(self.pieces)
        own = np.exp(self.log_p)
        first = np.array([p[0] == MARK for p in self.pieces] + [True, False, False, False])
        weight = np.where(first, own * counts[first].sum(), own * counts[~first].sum()) * prior + counts
        weight[n : n + 3] += 0.01
        weight[n + 3] = 0.0
        return Lattice(self.pieces, self.normalised(self.pieces, weight))

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of each prefix of each row."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
        return out

    def _lookup(self) -> tuple:
        if self._index is None:
            longest = max(map(len, self.pieces), default=1)
            power = np.cumprod(np.array([1] + [int(_BASE)] * longest, np.uint64))
            h = np.zeros(len(self.pieces), np.uint64)
            by: dict[int, list[int]] = {}
            for i, p in enumerate(self.pieces):
                by.setdefault(len(p), []).append(i)
            for size, members in by.items():
                h[members] = self._hashes(_codes([self.pieces[i] for i in members], size))[:, size] * _MIX
            order = np.argsort(h)
            h = h[order]
            if (h[1:] == h[:-1]).any():
                raise ValueError("two pieces are the same or have the same hash")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            marked = np.array([p[0] == MARK for p in self.pieces] + [True, False, False, False])
            self._index = longest, power, h, order.astype(np.int32), bits, marked
        return self._index

    def _edges(self, codes: np.ndarray, prefix: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end at a + 1 .. b: ids[word, end, size - 1], and their log weights."""
        longest, power, hashes, order, bits, marked = self._lookup()
        n, none = len(self.pieces), len(self.pieces) + 3
        ids = np.full((len(codes), b - a, longest), none, np.int32)
        for size in range(1, min(longest, b) + 1):
            low = max(a + 1, size)  # the first end that has room
            h = (prefix[:, low : b + 1] - prefix[:, low - size : b + 1 - size] * power[size]) * _MIX
            at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)].ravel())
            got = h.ravel()[at]
            k = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            good = hashes[k] == got
            place, piece = at[good], order[k[good]]
            row, col = np.divmod(place, h.shape[1])
            start = col + low - size
            right = marked[piece] == (start == 0)
            ids[row[right], col[right] + low - a - 1, size - 1] = piece[right]
        lp = self.log_p[ids]
        if a == 0:  # the mark by itself
            gone = ids[:, 0, 0] == none
            ids[gone, 0, 0], lp[gone, 0, 0] = n, self.log_p[n]
        ends = np.arange(a + 1, b + 1)
        row, col = np.nonzero((ids[:, :, 0] == none) & (ends >= 2))
        if len(row):
            c = codes[row, ends[col] - 1]
            size = 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
            ids[row, col, 0], lp[row, col, 0] = n + 1, self.log_p[n + 1] - size * math.log(256)
        return ids, lp

    def forward(self, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
        """Natural-log marginal of each word; adds expected piece counts (each word once) to `counts`."""
        out = np.zeros(len(words))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for size, members in by.items():
            step = max(1, _CELLS // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                out[part] = self._forward(_codes([MARK + words[i] for i in part], size), counts)
        return out

    def _forward(self, codes: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """Of words of one length; the edges of a long word are found for _ENDS of its places at a time."""
        w, size = codes.shape
        longest, stop = self._lookup()[0], self.log_p[len(self.pieces) + 2]
        prefix = self._hashes(codes)
        alpha = np.full((w, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        blocks = [(a, min(size, a + _ENDS)) for a in range(0, size, _ENDS)]
        for a, b in blocks:
            ids, lp = self._edges(codes, prefix, a, b)
            for e in range(a + 1, b + 1):
                m = min(e, longest)
                alpha[:, e] = _sum_of(alpha[:, e - m : e][:, ::-1] + lp[:, e - a - 1, :m])
        z = alpha[:, size] + stop
        if counts is None:
            return z
        beta = np.full((w, size + 1), -np.inf)
        beta[:, size] = stop
        for a, b in reversed(blocks):
            if len(blocks) > 1:
                ids, lp = self._edges(codes, prefix, a, b)
            post = np.zeros(ids.shape)
            for e in range(b, a, -1):
                m = min(e, longest)
                on = lp[:, e - a - 1, :m] + beta[:, e, None]
                post[:, e - a - 1, :m] = np.exp(alpha[:, e - m : e][:, ::-1] + on - z[:, None])
                beta[:, e - m : e] = np.logaddexp(beta[:, e - m : e], on[:, ::-1])
            counts += np.bincount(ids.ravel(), post.ravel(), len(counts))
        counts[len(self.pieces) + 2] += w
        counts[-1] = 0.0
        return z


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(np.uint64)


_TABLE = "block bigint, k int, word string, n bigint, id string, held boolean, words binary"


def _numbered(docs: DataFrame) -> DataFrame:
    """Two kinds of rows a block of about BLOCK_BYTES of a partition's text: its distinct words with their number k
    and training count n, and its documents as lists of word numbers (int32). docs: id, held, text."""

    def flush(block: int, number: dict, held: list, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([np.frombuffer(t, np.int32) for t, h in zip(texts, held) if not h] or [np.zeros(0, np.int32)])
        n = np.bincount(flat, minlength=len(number))
        words = pa.array(list(number), pa.binary()).cast(pa.string())
        for k in range(0, len(words), 50_000):
            w = words[k : k + 50_000]
            size = len(w)
            none = [pa.nulls(size, t) for t in (pa.string(), pa.bool_(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(np.arange(k, k + size, dtype=np.int32)), w, pa.array(n[k : k + size]), *none], names)
        for k in range(0, len(ids), 1000):
            size = len(ids[k : k + 1000])
            none = [pa.nulls(size, t) for t in (pa.int32(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *none, pa.array(ids[k : k + 1000], pa.string()), pa.array(held[k : k + 1000]), pa.array(texts[k : k + 1000], pa.binary())], names)

    names = [x.split()[0] for x in _TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        held, ids, texts, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                t = t.as_py()
                ids.append(i), held.append(h)
                texts.append(array("i", [number.setdefault(w, len(number)) for w in t.lower().split()]).tobytes())
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from flush(block, number, held, ids, texts)
                    block += 1
                    number, held, ids, texts, size = {}, [], [], [], 0
        if ids:
            yield from flush(block, number, held, ids, texts)

    return docs.mapInArrow(run, _TABLE)


def _fit(lattice: Lattice, words: DataFrame, rounds: int) -> Lattice:
    """Piece weights by expected counts over all segmentations of all training words, each once."""
    for _ in range(rounds):  # as many numbers a task as the vocabulary has

        def expected(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(lattice.log_p))
            for b in batches:
                words = b.column(0).to_pylist()
                for k in range(0, len(words), 20_000):
                    lattice.forward(words[k : k + 20_000], counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["piece", "n"])

        counts = np.zeros(len(lattice.log_p))
        for i, n in words.mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[i] = n
        lattice = lattice.fitted(counts)
    return lattice


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", folds: int = 10, rounds: int = ROUNDS, discount: float = DISCOUNT) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    lattice = Lattice.load(path)
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), (fold(id_col, folds) == 0).alias("held"), whole(F.col(f"`{text}`")).alias("text"))
    table = written(_numbered(own), "lm-blocks")
    texts, pairs = table.filter("words IS NOT NULL").select(F.col("block").alias("of"), "id", "held", "words"), table.filter("word IS NOT NULL").select("block", "k", "word", "n")
    totals = written(pairs.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "lm-words")
    known, tokens, n_pairs = totals.agg(F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    n_train = texts.filter("NOT held").count()
    if known:
        lattice = _fit(lattice, totals.filter("c > 0").select("word"), rounds)
    if n_train:
        known, tokens = known + 1, tokens + n_train  # the end is a token
    share = discount * known / tokens if tokens else 1.0
    denominator = tokens + 0.1 * (known + 1)

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                part = b.slice(k, 20_000)
                c = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                z = lattice.forward(part.column(0).to_pylist()) + math.log(share)
                with np.errstate(divide="ignore"):
                    edge = np.log(np.maximum(c - discount, 0) / max(tokens, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.logaddexp(edge, z) / math.log(10))], ["word", "c", "blocks", "lp"])

    scored = written(totals.mapInArrow(word_scores, "word string, c bigint, blocks bigint, lp double"), "lm-scores")
    hot = F.col("blocks") > max(64, n_pairs // HOT)  # at most HOT words, whatever the corpus
    often = F.broadcast(scored.filter(hot).drop("blocks"))
    given = pairs.join(often, "word").unionByName(pairs.join(often.select("word"), "word", "left_anti").join(scored.filter(~hot).drop("blocks"), "word")).select("block", "k", "c", "lp")
    end_known = n_train > 0
    end_base = math.log10((n_train + 0.1) / denominator)
    end_lp = math.log10(max(n_train - discount, 0.1) / tokens) if tokens else math.log10(0.5)

    def run(key: tuple, d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        c, lp = np.zeros(len(w)), np.zeros(len(w))
        c[w["k"]], lp[w["k"]] = w["c"], w["lp"]
        parts = [np.frombuffer(x, np.int32) for x in d["words"]]
        n = np.array([len(x) for x in parts])
        flat, of = np.concatenate(parts), np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(of, x[flat], len(n))
        return pd.DataFrame({"id": d["id"], "held_out": d["held"], "n_tokens": n + 1, "n_known": add(c > 0).astype(int) + end_known, "train_tokens": tokens, "base_score": add(np.log10((c + 0.1) / denominator)) + end_base, "score": add(lp) + end_lp})

    schema = "id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out = texts.groupBy("of").cogroup(given.groupBy("block")).applyInPandas(run, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])
