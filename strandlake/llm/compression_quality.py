"""Compression classifier of quality (operator 2).

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A whole text is compressed with
both, in pieces of `PIECE` bytes (in small pieces a dictionary counts for more than what the text repeats of itself). Runs of one
repeated word, which any compressor writes in a few bytes whatever its dictionary, are first written as the word and a numbered
code for each repeat, in the dictionaries' texts as in those scored: only a dictionary that knows such runs makes them short.
The difference of the two sizes over their sum is all the evidence there is; it becomes a calibrated probability by rising steps
(isotonic regression) fitted to labelled texts that went into neither dictionary, each label weighted to its share of all labels;
between steps the score is interpolated, and a twentieth of it is a logistic curve, which keeps the order of texts within a step.

Bounded sample: at most `per_class` labelled rows of each label, those whose hashed ids are smallest, and of these only
texts up to `longest` characters; dictionaries take every other one, the curve the rest. Scoring reads every whole text,
however long.

Defined results: a null or empty text has difference nought and its score; rows without an id are scored and
not held out; labels other than 0 and 1 are not used; without texts of both labels the score is the share of label 1
(one half without any). Repeated rows and texts score alike; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow

LEVEL = 3
PIECE = 128
CURVE = 0.05  # the logistic curve's part of a score

REPEATS = re.compile(rb"(?<!\S)(\S{1,64})(\s{1,4})(?:\1\2)+")
CODES = b"".join(hashlib.md5(b"%d" % k).hexdigest()[:4].upper().encode() for k in range(64))


def coded(raw: bytes) -> bytes:
    """The text with runs of one word (equal separators) as the word and four bytes for each repeat, which differ from repeat to repeat."""

    def codes(m: re.Match) -> bytes:
        one = len(m[1]) + len(m[2])
        n = 4 * ((m.end() - m.start()) // one - 1)
        return m[1] + m[2] + (CODES * (n // len(CODES) + 1))[:n]

    return REPEATS.sub(codes, raw)


def held_out(id_col: str, folds: int = 5) -> F.Column:
    """Whether a row's id falls into the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, longest: int) -> list[tuple[str, int]]:
    """(text, label) of the bounded sample, in the order of hashed ids. Only ids are ranked; texts come in by a broadcast
    of at most 2 * per_class ids."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = None
    for k in (0, 1):
        some = known.filter(F.col("_label") == k).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text").between(1, longest))
    rows = short.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label", F.xxhash64("_id").alias("_h")).collect()
    return [(r._text, r._label) for r in sorted(rows, key=lambda r: (r._h, r._id, r._label, r._text))]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b"\0" * 8


class Model:
    """Two dictionaries, the rising steps (differences and their shares of label 1), and slope and offset of the curve; without a
    slope the offset is the score."""

    def __init__(self, good: bytes, bad: bytes, slope: float | None = None, offset: float = 0.5, steps: tuple[np.ndarray, np.ndarray] | None = None):
        self.good, self.bad, self.slope, self.offset, self.steps = good, bad, slope, offset, steps
        self._by = None

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.offset, self.steps

    def __setstate__(self, x):
        self.__init__(*x)

    def difference(self, text: str | None) -> float:
        """Normalised size difference of a whole text; above nought: more like the good texts."""
        if not text:
            return 0.0
        if self._by is None:
            self._by = []
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(LEVEL)
                self._by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        raw = coded(text.encode("utf-8"))
        n = -(-len(raw) // PIECE)
        cuts = [len(raw) * i // n for i in range(n + 1)]
        good, bad = (sum(len(c(raw[a:b])) for a, b in zip(cuts, cuts[1:])) for c in self._by)
        return (bad - good) / (bad + good)

    def score(self, x) -> np.ndarray:
        """Probability of label 1 for differences."""
        x = np.asarray(x, float)
        if self.slope is None:
            return np.full(len(x), self.offset)
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))
        return smooth if self.steps is None else (1 - CURVE) * np.interp(x, *self.steps) + CURVE * smooth


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: ends of the steps, and their weighted means. Equal values are one step."""
    at, where = np.unique(x, return_inverse=True)
    steps: list[list[float]] = []
    for v, hit, n in zip(at, np.bincount(where, y * weight), np.bincount(where, weight)):
        steps.append([hit, n, v, v])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            hit_, n_, _, end = steps.pop()
            steps[-1] = [steps[-1][0] + hit_, steps[-1][1] + n_, steps[-1][2], end]
    ends = [(v, hit / n) for hit, n, first, last in steps for v in ((first,) if first == last else (first, last))]
    return np.array([v for v, _ in ends]), np.array([p for _, p in ends])


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method on standardised values with a slight ridge on the slope. Labels
    are drawn in a little (to one over the number of rows of each), so a clean cut has a finite slope too."""
    mean, scale = x.mean(), x.std() or 1.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, w = np.stack([(x - mean) / scale, np.ones(len(x))], 1), np.zeros(2)
    keep = np.array([ridge, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-9), a.T @ (t - p) - keep * w)
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() or 1.0))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, longest: int = 40_000, dictionary_bytes: int = 64 * 1024) -> Model:
    sample = training_sample(docs, labels, id_col, text_col, label_col, per_class, longest)
    of = {k: [t.encode("utf-8") for t, y in sample if y == k] for k in (0, 1)}
    if not of[0] or not of[1]:
        return Model(b"\0" * 8, b"\0" * 8, None, len(of[1]) / len(sample) if sample else 0.5)
    built = {k: [coded(t) for t in of[k][::2]] for k in of}
    m = Model(dictionary(built[1], dictionary_bytes), dictionary(built[0], dictionary_bytes))
    rest = {k: of[k][1::2] or of[k] for k in of}
    x = np.array([m.difference(t.decode("utf-8")) for k in (0, 1) for t in rest[k]])
    y = np.array([float(k) for k in (0, 1) for _ in rest[k]])
    m.slope, m.offset = curve(x, y)
    # the sample is balanced by design; the curve's offset goes back to the labels' own shares
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(label_col).cast("int").alias("k")).count().filter("k IN (0, 1)").collect()
    share = {r["k"]: r["count"] for r in known}
    m.offset += np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))
    m.steps = rising(x, y, np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum())))
    return m


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, difference, score and predicted per row."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                x = np.array([model.difference(t) for t in part.column(1).to_pylist()], float)
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "difference", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, difference double, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = model.score([model.difference(t) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(np.asarray(s) >= threshold))

    return map_arrow(df, run, df.schema)
