"""Quality rules: boosted trees over document statistics (operator 2).

Statistics of each whole text are computed once, distributed. A classifier is fitted on the driver on at most
`sample` labelled rows (those of the smallest id hashes, so the choice does not depend on partitioning); of these
only numbers reach the driver. Trees are grown on histograms, with monotonic constraints: on a constrained feature
the right child's value may not lie above (or below) the left one's, and both stay within bounds handed down.
The fitted trees are flattened into numpy node arrays, which score whole Arrow batches without a loop over rows.

Defined results: a null text has no words; such a document, as any of fewer than 50 words, fails the base rule; a
null id is scored like any other but is never a training row; repeated rows are scored alike; labels that are
null, or tables without labels of both classes, leave the base rule alone to decide; with labels of both, however few,
a forest is fitted (of few rows it has hardly a split and gives their share of good ones); an empty table gives an
empty one; only the named columns are read; a key named like a column of the result is refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import bound_batches, check_keys, map_arrow, slices, utf8
from tramline.store import stage

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 20_000
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_stops", "n_distinct", "max_word"]
FEATURES = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "line_words", "upper_rate", "digit_rate", "stop_rate", "distinct_rate", "log_max_word"]
#: -1: a higher value may never raise the score; 0: free.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "digit_rate": -1}

_SPACES = b" \t\n\v\f\r"
_INNER = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".!?"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which occurs twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key, bound = codes[:n], len(ids)
    for k in range(1, width):
        if bound > (1 << 62) // len(ids):  # renumbered, so that the next product does not overflow
            key, bound = np.unique(key, return_inverse=True)[1], n
        key, bound = key * len(ids) + codes[k : n + k], bound * len(ids)
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[at + k] = True
    return int(covered.sum())


def statistics(text: bytes) -> list[int]:
    """The COUNTS of one text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = text.translate(None, _INNER)  # one byte for each code point

    def count(chars: bytes) -> int:
        return len(plain) - len(plain.translate(None, chars))

    return [
        len(words), len(plain) - count(_SPACES), count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(plain),
        count(_UPPER), count(_DIGITS), count(_STOPS), len(set(words)), max(map(len, words), default=0),
    ]


def document_statistics(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the COUNTS, a row for each row."""
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([statistics(t) for t in utf8(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [key, *COUNTS])

    return map_arrow(df.select(key, text), run, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from columns of COUNTS."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        np.log1p(words / lines), c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words, c["n_distinct"] / words, np.log1p(c["max_word"]),
    ])


def base_failed(n_words, n_repeat):
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


@dataclass
class Forest:
    """Trees as flat node arrays: of node i, rows with feature[i] <= threshold[i] go to left[i], others to right[i].

    A leaf is its own child on both sides, so `depth` steps bring every row to its leaf.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality, by row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boosted trees on the log loss; monotone: +1, -1 or 0 for each feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(len(left)), right.append(len(right)), value.append(v)
        return len(value) - 1

    def leaf_value(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
        return -g / (h + ridge)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, levels: int) -> int:
        sg, sh = g[rows].sum(), h[rows].sum()
        here = node(rate * float(np.clip(leaf_value(sg, sh), low, high)))
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, e in enumerate(edges if levels else ()):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            a, b = np.clip(leaf_value(gl, hl), low, high), np.clip(leaf_value(sg - gl, sh - hl), low, high)
            own = np.clip(leaf_value(sg, sh), low, high)
            gain = -(gl * a + 0.5 * (hl + ridge) * a**2) - ((sg - gl) * b + 0.5 * (sh - hl + ridge) * b**2) + (sg * own + 0.5 * (sh + ridge) * own**2)
            gain[(hl < least / 4) | (sh - hl < least / 4) | (monotone[j] * (b - a) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
        _, j, k, a, b = best
        if j < 0:
            margin[rows] += value[here]
            return here
        middle = (a + b) / 2
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[int(monotone[j])]
        goes_left = binned[rows, j] <= k
        one = grow(rows[goes_left], g, h, *bounds[:2], levels - 1)
        two = grow(rows[~goes_left], g, h, *bounds[2:], levels - 1)
        feature[here], threshold[here], left[here], right[here] = j, float(edges[j][k]), one, two
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, depth))
    return Forest(*(np.array(a) for a in (roots, feature, threshold, left, right, value)), depth, bias)


def train(stats: DataFrame, labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> Forest | None:
    """A forest fitted on at most `sample` labelled rows of stats; None without rows of both classes."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    # The bound is put on the labels before the join, so what is joined does not grow with them.
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample)
    rows = stats.join(chosen, key).orderBy(F.xxhash64(key), key, *COUNTS).limit(sample).select("label", *COUNTS).toPandas()
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(features(rows[COUNTS].to_numpy()), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(stats: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """stats with base_failed, score (probability of good quality; null without a forest) and kept."""
    schema = T.StructType([*stats.schema, T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            counts = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            failed = base_failed(counts[:, 0], counts[:, 4])
            score = np.full(len(counts), np.nan) if forest is None else 1 / (1 + np.exp(-forest.score(features(counts))))
            kept = ~failed & ((score >= threshold) | np.isnan(score))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)], names)

    return map_arrow(stats, run, schema)


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """df with an array of the COUNTS of each row's text; all other columns stay in the JVM."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in utf8(texts)], pa.list_(pa.int64()))

    bound_batches(df.sparkSession)
    return df.withColumn(name, counts(F.col(text)))


def verdict(forest: Forest | None, threshold: float = 0.5):
    """A column function of an array of COUNTS: whether the document is kept."""

    @F.arrow_udf("boolean")
    def kept(rows: pa.Array) -> pa.Array:
        counts = np.asarray(rows.flatten()).reshape(-1, len(COUNTS))
        good = ~base_failed(counts[:, 0], counts[:, 4])
        return pa.array(good if forest is None else good & (1 / (1 + np.exp(-forest.score(features(counts)))) >= threshold))

    return kept


def quality(df: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """key, the COUNTS, base_failed, score and kept of every document."""
    check_keys([key], [*COUNTS, "base_failed", "score", "kept"])
    stats = stage(document_statistics(df, key, text), "quality-stats")
    return judge(stats, train(stats, labels, key, label, sample), threshold)
