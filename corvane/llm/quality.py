"""Quality by Bradley-Terry pairwise ranking.

Every pair of a better and a worse labelled document is a preference; the chance
that the better one wins is the logistic function of the difference of linear
scores, so the loss is the logistic loss on feature differences. The threshold
is a quantile of the training scores, and a logistic curve through it turns a
score into 0 to 1 with the threshold at the given level.

The model is fitted on the driver from at most `most` labelled documents of each
class, taken by hash; scoring covers every row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a fit may use; preference pairs of a fit.
MOST_LABELLED = 8_000
PAIRS = 60_000
#: Score at the threshold.
LEVEL = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "line": b"\n\r",
    "space": b" \t\x0b\x0c",
}
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _k] = 1
_TABLE[128:, -1] = 1  # bytes of letters beyond ASCII
NAMES = [*_CLASSES, "beyond", "words", "word_length", "distinct", "repeated", "commonest", "line_words", "caps_words", "symbol_words"]


def features(text: str | None) -> list[float]:
    """Shares of character classes and word statistics of the whole text; null and empty give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / len(raw)
    w = raw.split()
    n = max(1, len(w))
    counts = Counter(w)
    commonest = max(counts.values(), default=0)
    caps = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    odd = sum(c for x, c in counts.items() if not (x[-1:].isalnum() or x[-1] >= 128 or x[-1:] in b".,;:?'\")-"))
    return [*shares, float(np.log1p(len(w))), len(raw) / n, len(counts) / n, sum(map(eq, w, w[1:])) / n, commonest / n, float(np.log1p(n / (1 + raw.count(b"\n")))), caps / n, odd / n]


def _shaped(x: np.ndarray) -> np.ndarray:
    """The features, and their square roots, which separate small shares."""
    return np.hstack([x, np.sqrt(np.clip(x, 0, None))])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    level: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_shaped(x) - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, level: float = LEVEL, seed: int = 7, ridge: float = 1e-3) -> Model:
    """x: features, y: 1 for the preferred class. Of one class only, every document scores at or below the level."""
    if not len(x):
        width = 2 * len(NAMES)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, level)
    s = _shaped(x)
    mean, scale = s.mean(axis=0), s.std(axis=0) + 1e-6
    z = np.clip((s - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, w, 0.0, 1.0, level)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(25):  # Newton's method on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), diff.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # the score quantile that keeps both classes best apart
    levels = np.quantile(raw, np.linspace(0.001, 0.999, 999))
    kept = (raw[good][:, None] >= levels).mean(axis=0)
    gone = (raw[bad][:, None] < levels).mean(axis=0)
    best = kept + gone
    threshold = float(np.median(levels[best >= best.max() - 1e-9]))
    spread = float(np.median(np.abs(raw - threshold))) or 1.0
    return Model(mean, scale, w, threshold, 2.0 / spread, level)


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % folds == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, seed: int) -> DataFrame:
    """text, label of at most about `most` labelled rows of each class that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))  # of several labels the lowest
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label in (0, 1):
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / max(1, n.get(label, 0))))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1_000_000)) < share * 1_000_000)
    # bounded by 2 * most rows, within the spread of a hash
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "__id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, seed: int = 7, level: float = LEVEL) -> Model:
    """Fits on labelled rows that are not held out. Without labels the model scores every text at the level."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    rows = labelled(docs, labels, id_col, text_col, label_col, most, seed).select(made("text").alias("x"), "label").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0), level=level)
    x, y = np.vstack(rows["x"].map(np.asarray)), rows["label"].to_numpy()
    order = np.lexsort([*x.T, y])  # arrival order must not matter
    return fit(x[order], y[order], level=level, seed=seed)


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(np.round(model.score(np.array([features(t) for t in texts])), 9))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, level: float = LEVEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text enters a score.

    Null and empty texts score like a text without characters; equal texts score
    alike; a null id is never held out. Empty tables give no rows.
    """
    model = train(docs, labels, id_col, text_col, most=most, level=level)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col).cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= level).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, level: float = LEVEL) -> DataFrame:
    """The rows of docs whose score reaches the level, with all their columns."""
    model = train(docs, labels, id_col, text_col, most=most, level=level)
    return docs.where(score(model, F.col(text_col).cast("string")) >= level)
