"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows and flattened into arrays; every document is then scored where it
lies, a batch at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import slices

# Common short words of English, German, French and Spanish.
COMMON_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de et un une du en que qui dans pour pas au sur ne se ce par plus avec son il "
    "el los las una por con para del como más pero sus su al lo si porque esta entre cuando".split()
)
CLASSES = ("upper", "lower", "digit", "space", "stop", "symbol", "high", "other")
FEATURES = (
    "bytes", "words", "word_length", "longest_word", "distinct", "top_word", "repeats", "common", "lines", "line_length", "distinct_lines",
    *(f"share_{c}" for c in CLASSES), "entropy", "upper_upper", "symbol_space", "symbol_symbol", "stop_space", "space_space",
    "worst_upper", "worst_symbol", "worst_digit", "worst_common", "shouting", "symbolic", "capitalised",
)


def _class_table() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    for k, group in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\v\f", b".,;:?'\"-()", b"!#$%&*+/<=>@[\\]^_`{|}~", range(128, 256))):
        out[list(group)] = k
    return out


CLASS_OF = _class_table()


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; zeros if it has no words."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = len(data), len(words)
    counts = np.bincount(data, minlength=256)
    kind = CLASS_OF[data]
    pairs = np.bincount(kind[:-1].astype(np.int64) * 8 + kind[1:], minlength=64) if n > 1 else np.zeros(64)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    seen_common = sum(c for w, c in seen.items() if w.lower().strip(".,;:!?") in COMMON_WORDS)
    p = counts[counts > 0] / n
    head = [np.log1p(n), np.log1p(m), sum(map(len, words)) / m, np.log1p(max(map(len, seen))), len(seen) / m**0.75, max(seen.values()) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, seen_common / m]
    head += [np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines)]
    shares = np.bincount(kind, minlength=8) / n
    worst = np.zeros(4)
    loud = odd = 0
    breaks = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    breaks = breaks[breaks < n]
    sizes = np.diff(np.append(breaks, n))
    for k, c in enumerate((0, 5, 2)):
        by_line = np.add.reduceat(kind == c, breaks, dtype=np.int64) / sizes
        worst[k] = by_line[sizes >= 20].max(initial=0)
        loud, odd = (sizes[by_line > 0.35].sum(), odd) if c == 0 else (loud, sizes[by_line > 0.06].sum()) if c == 5 else (loud, odd)
    worst[3] = min((sum(w.lower().strip(".,;:!?") in COMMON_WORDS for w in ws) / len(ws) for ws in map(str.split, lines) if len(ws) >= 12), default=1)
    tail = [-(p * np.log2(p)).sum(), pairs[0] / n, pairs[5 * 8 + 3] / m, pairs[5 * 8 + 5] / n, pairs[4 * 8 + 3] / m, pairs[3 * 8 + 3] / n]
    capital = sum(c for w, c in seen.items() if w[0].isupper()) / m
    out[:] = [*head, *shares, *tail, *worst, loud / n, odd / n, capital]
    return out


@dataclass
class Forest:
    """Complete trees of one depth, level by level: node i has children 2i+1 and 2i+2; value holds the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.min(initial=inner) < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, bins: int = 64, rate: float = 0.12, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Second-order boosting for the logistic loss over quantile-binned features. y: from 0 to 1."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(x):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total, n, width = np.full(len(x), bias), x.shape[1], bins
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        split_bin = np.full(inner, width)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            gs, hs = (np.stack([np.bincount(local * width + binned[:, k], w, many * width).reshape(many, width) for k in range(n)]) for w in (g, h))
            gl, hl = gs.cumsum(axis=2)[:, :, :-1], hs.cumsum(axis=2)[:, :, :-1]
            gt, ht = gs.sum(axis=2)[:, :, None], hs.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k in range(n):
                gain[k, :, len(cuts[k]) :] = 0
            best = gain.transpose(1, 0, 2).reshape(many, -1)
            pick = best.argmax(axis=1)
            for i in np.flatnonzero(best.max(axis=1) > 1e-6):
                f, b = divmod(int(pick[i]), width - 1)
                feature[first + i], split_bin[first + i], threshold[first + i] = f, b, cuts[f][b]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > split_bin[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        total += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), bias)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3. Null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t).tolist() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Forest:
    """Grow the forest on at most `sample` labelled documents, those with the least hashes of their ids, held-out rows
    apart. Several labels of one document are averaged, null ones ignored; without any the score is 0.5 throughout."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    taught = usable.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select(F.col("doc_id").cast("long"), "y", F.col("text").cast("string"))
    found = rows.mapInArrow(_feature_batches, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("doc_id").select("r.x", "r.y").toPandas()
    return grow(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """row (a struct of the columns of docs), score and predicted for each row. Null and empty texts are scored by their (zero) statistics."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            s = model.value.score(np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """docs: doc_id, text and any others; labels: doc_id, quality (1 good, 0 bad). Trains and scores: row, held_out, score, predicted."""
    return score(docs, train(docs, labels, sample)).withColumn("held_out", held_out(F.col("row.doc_id")))
