"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on at most ``SAMPLE`` labelled documents (those with the smallest hash of the identifier; this bound
is the only one) whose crc32(doc_id) mod 5 is not 0.  They are perfect binary trees of one depth, flattened into arrays;
a batch of documents walks down all of them with numpy indexing.  Every whole text of the table is scored.

Defined results: a null text counts as empty and is scored like any other; a null identifier is not held out and has no
label; of several labels of a document the greatest counts; with no usable labels every score is the prior 0.5, with one
class it is nearly that class; texts of any length are taken whole; a score equal to the bar counts as 1; repeated rows give
repeated rows; an empty table gives none.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, map_texts, table

#: Labelled documents for the fit, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 60, 4, 64, 0.15, 1.0, 1.0
FOLDS, LEAST_SCORE = 5, 0.3

UPPER, DIGITS, SYMBOLS, MARKS, SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b" \t\n\r\x0b\x0c"
FEATURES = ("words", "word_length", "longest_word", "upper", "digits", "symbols", "marks", "stops", "non_ascii", "lines", "repeated_lines", "distinct_words", "distinct_windows", "stutter", "commonest_word")


def statistics(text: bytes) -> tuple[float, ...]:
    """FEATURES of a whole text; shares are of its bytes or words."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen, windows = Counter(words), max(1, n - 2)
    return (
        float(np.log1p(n)),
        (len(text) - len(text.translate(None, SPACE)) and len(text.translate(None, SPACE)) / max(1, n)),
        float(np.log1p(max(map(len, words), default=0))),
        share(UPPER),
        share(DIGITS),
        share(SYMBOLS),
        share(MARKS),
        share(b".,;:"),
        1 - len(text.decode("ascii", "ignore")) / size,
        len(lines) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        len(seen) / max(1, n),
        len(set(zip(words, words[1:], words[2:]))) / windows,
        sum(map(eq, words, words[1:])) / max(1, n),
        max(seen.values(), default=0) / max(1, n),
    )


class Trees:
    """feature and threshold of the inner nodes, value of the leaves: arrays of one row for each tree, heap order."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.feature = np.zeros((0, (1 << DEPTH) - 1), np.int32)
        self.threshold = np.zeros((0, (1 << DEPTH) - 1))
        self.value = np.zeros((0, 1 << DEPTH))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - ((1 << DEPTH) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, Newton leaves, splits on quantile histograms; the same rows in any order of equal sums give the same trees."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # x > edges[b] if and only if bin > b
    width = x.shape[1]
    cell = binned + np.arange(width) * BINS
    margin = trees.margin(x)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros((1 << DEPTH) - 1, np.int32), np.full((1 << DEPTH) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            n, first = 1 << level, (1 << level) - 1
            at = (((node - first) * width * BINS)[:, None] + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, width), n * width * BINS).reshape(n, width, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[..., -1:], hl[..., -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = -1
            flat = gain.reshape(n, -1)
            best = flat.argmax(1)
            for k in np.flatnonzero(flat.max(1) > 1e-9):
                f, b = divmod(int(best[k]), BINS)
                if b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - ((1 << DEPTH) - 1)
        value = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + RIDGE)
        margin = margin + value[leaf]
        trees.feature, trees.threshold, trees.value = np.vstack([trees.feature, feature]), np.vstack([trees.threshold, threshold]), np.vstack([trees.value, value])
    return trees


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (FEATURES as an array) of every row."""
    return map_texts(docs, lambda ids, texts: {"doc_id": ids, "x": [statistics(t) for t in texts]}, f"doc_id {kind(docs, 'doc_id')}, x array<double>")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi")
    rows = features(own).join(F.broadcast(usable), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).select("x", "y").collect()
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    trees = trained(docs, labels)

    def run(ids: list, texts: list) -> dict:
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return {"doc_id": ids, "score": trees.score(x)}

    scored = map_texts(docs, run, f"doc_id {kind(docs, 'doc_id')}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
