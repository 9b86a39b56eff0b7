"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the same plus what recurs in toxic
text and hardly in ordinary text. A window that compresses shorter with the toxic dictionary holds such
matter; a text's differences (highest, sum, counts over thresholds) become a probability by a logistic
calibration on labelled texts that trained neither dictionary.

What recurs: words of toxic texts with at least max(3, RECUR x toxic texts) different words before
them (so copies and shared passages don't count) that the ordinary sample lacks or holds in a share
of its texts at most 1/RATIO of that of toxic texts (each share a standard deviation off), so mislabelled and quoting rows don't remove a word. The
toxic part is a raw-content dictionary of all of them, rarest first; the ordinary one is zstandard's own training.

The fit uses a bounded sample of labelled rows (documented parameters: `most_toxic` and
`most_ordinary` rows, chosen by a hash of the id; texts of any length up to a tenth of MOST_BYTES, and
together up to MOST_BYTES) in one task, which sends the fitted model to the driver, about 40 kB.
Every whole text is scored, in windows of about WINDOW bytes that end between words.

Defined cases: null and empty texts have no window and get the calibration's score for no differences;
without both labels in the sample every score is the share of toxic rows (0 with no rows); ids may be
null or repeated, each row is scored; a doc_id with several labels counts as toxic if one says so;
other input columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import fold, ship

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 3000, 5000, 160_000_000
RECUR, RATIO, WINDOW, LEVEL, ORDINARY_DICT = 0.008, 8, 96, 12, 32_768


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The lower-cased words of a text in pieces of about `size` bytes that end between words."""
    joined, out, i = b" ".join(text.lower().split()), [], 0
    while i < len(joined):
        j = joined.find(b" ", i + size) if i + size < len(joined) else -1
        j = len(joined) if j < 0 else j
        out.append(b" " + joined[i:j] + b" ")
        i = j + 1
    return out


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress


class CompressionDistance:
    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._pair = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: bytes) -> list[float]:
        if not self.toxic:
            return [1.0, *[0.0] * 7]
        if self._pair is None:  # the ordinary part stands last in both: equal matches cost equal
            self._pair = _compressor(self.toxic + self.ordinary), _compressor(self.ordinary)
        a, b = self._pair
        d = [len(b(w)) - len(a(w)) for w in windows(text)]
        n = max(1, len(d))
        over = [sum(1 for x in d if x >= t) for t in (3, 5, 7)]
        return [1.0, min(12, max(d, default=0)) / 4, math.log1p(sum(x - 1 for x in d if x > 1)), *[math.log1p(k) for k in over], over[1] / n * 4, math.log(n) / 4]

    def score(self, text: bytes) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Newton's method over rows that count c times; the ridge leaves the first weight alone."""
    w = np.zeros(x.shape[1])
    r = np.full(x.shape[1], ridge)
    r[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (c * (p - y)) + r * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w.tolist()


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    in_ordinary, in_toxic = Counter(), Counter()
    for t in ordinary:
        in_ordinary.update(set(t.lower().split()))
    before: dict[bytes, set[bytes]] = defaultdict(set)
    for t in toxic:
        words = t.lower().split()
        in_toxic.update(set(words))
        for last, w in zip([b"", *words], words):
            before[w].add(last)
    least = max(3, RECUR * len(toxic))

    def marks(w: bytes) -> bool:
        """Whether only toxic texts hold the word, or RATIO times as often as ordinary ones by more than chance."""
        x, n = in_toxic[w], in_ordinary[w]
        return not n or (x - math.sqrt(x)) * (len(ordinary) + 1) >= RATIO * (n + math.sqrt(n) + 0.5) * (len(toxic) + 1)

    found = sorted((w for w, b in before.items() if len(b) >= least and marks(w)), key=lambda w: (len(before[w]), w))
    gone = frozenset(w for w in found if in_ordinary[w])  # else the ordinary dictionary would shorten them as well
    samples = [x for t in ordinary for x in windows(b" ".join(w for w in t.split() if w.lower() not in gone) if gone else t, 200)[::2]]
    try:
        base = zstandard.train_dictionary(ORDINARY_DICT, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for training: its end is the dictionary
        base = b"".join(samples)[-ORDINARY_DICT:]
    return b"".join(b" " + w + b" " for w in found), base


def fit(rows: list[tuple[bytes, int, int]], counts: tuple[int, int] | None = None) -> CompressionDistance:
    """From (text, toxic 0/1, part 0..9) rows: parts 0 to 6 train the dictionaries, 7 to 9 the calibration.

    counts: the labelled ordinary and toxic rows of which `rows` is a sample; the calibration weighs them back.
    """
    y_all = [y for _, y, _ in rows]
    counts = counts or (len(y_all) - sum(y_all), sum(y_all))
    share = counts[1] / max(1, sum(counts))
    prior = math.log(max(share, 1e-9) / max(1 - share, 1e-9)) if rows else -60.0
    plain = CompressionDistance(b"", b"", [prior, *[0.0] * 7])
    toxic, ordinary = [[t for t, y, k in rows if y == v and k < 7] for v in (1, 0)]
    rest = [(t, y) for t, y, k in rows if k >= 7]
    if not toxic or not ordinary or len({y for _, y in rest}) < 2:
        return plain
    model = CompressionDistance(*_dictionaries(toxic, ordinary), plain.weights)
    if not model.toxic:
        return plain
    x = np.array([model.features(t) for t, _ in rest])
    y = np.array([y for _, y in rest], float)
    n = [max(1, len(y_all) - sum(y_all)), max(1, sum(y_all))]
    back = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    model.weights = _logistic(x, y, back * len(y) / back.sum())
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, folds: int, most_toxic: int, most_ordinary: int) -> tuple[DataFrame, tuple[int, int]]:
    """(rows of text, label and part, counts): at most most_toxic toxic and most_ordinary other rows, of at most MOST_BYTES together, in the
    folds that may train, and how many labelled rows of either kind there are."""
    one = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_i")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("_y")).filter(fold("_i", folds) != 0)
    drawn = one.select("_i", "_y", F.xxhash64("_i").alias("_k"))
    counts = {r[0]: r[1] for r in one.groupBy("_y").count().collect()}
    picked = drawn.filter("_y = 1").orderBy("_k").limit(most_toxic).unionAll(drawn.filter("_y = 0").orderBy("_k").limit(most_ordinary))
    texts = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text}`").alias("_t")).filter(F.octet_length("_t").between(1, MOST_BYTES // 10))
    found = texts.join(F.broadcast(picked), "_i").select("_t", "_y", F.pmod(F.xxhash64(F.lit(7), "_k"), F.lit(10)).cast("int").alias("_p"), "_k").orderBy("_k", "_t").limit(2 * (most_toxic + most_ordinary))
    found = found.withColumn("_sum", F.sum(F.octet_length("_t")).over(Window.orderBy("_k", "_t").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= MOST_BYTES)
    return found.select("_t", "_y", "_p"), (counts.get(0, 0), counts.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> CompressionDistance:
    """Fits the model on the sample, in one task of an executor."""
    ship(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, id_col, text, label, folds, most_toxic, most_ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t.as_py(), y, p) for b in batches for t, y, p in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist())]
        model = fit(rows, counts)
        yield pa.RecordBatch.from_arrays([pa.array([model.toxic], pa.binary()), pa.array([model.ordinary], pa.binary()), pa.array([model.weights], pa.list_(pa.float64()))], ["toxic", "ordinary", "weights"])

    found = sample.coalesce(1).mapInArrow(run, "toxic binary, ordinary binary, weights array<double>").collect()
    return CompressionDistance(bytes(found[0][0]), bytes(found[0][1]), list(found[0][2])) if found else fit([], counts)


def score_toxicity(docs: DataFrame, model: CompressionDistance, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1) and predicted (1 from 0.5)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [id_col, "score", "predicted"])

    return docs.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: CompressionDistance, text: str = "text", least: float = 0.5) -> DataFrame:
    """The input's rows and columns without texts that score `least` or more."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(t.as_py() or b"") < least for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
