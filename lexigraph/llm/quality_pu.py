"""Quality classifier by positive-unlabelled learning with the non-negative risk.

A linear model over the shape of a text (shares of pairs of neighbouring character classes, and a few
ratios of words and lines) is trained on trusted positives and on unlabelled text: the risk
prior * R+(g) + max(0, R-(unlabelled) - prior * R-(positives)) with the sigmoid loss is minimised by Adam; when the
second term falls below zero, its gradient is ascended instead. The class prior is estimated from positives and unlabelled text (see
estimate_prior). Scores are calibrated on labelled training rows of both kinds, so that they read as probabilities.

Training uses a bounded sample (`max_rows` of each kind, in order of a hash of the row; equal rows count once); scoring covers all rows and
whole texts. Null and empty texts get the features of an empty text and hence a score. Rows with a null id train nothing. Labels of
rows that don't exist and rows without labels are fine; several labels of one id each count. Without positives, or without any training
rows, every score is the share of positives among labelled rows (0.5 if unknown). Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, words_of

#: Character classes of bytes; letters beyond ASCII count with lower-case letters.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", ";:", "'\"`", "()[]{}", "|", "#", "$%&*@", "<>=+~^", "-_", "/\\"]
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 6


def _classes() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.int64)
    table[128:] = 0
    for i, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = i
    return table


CLASS_OF = _classes()


def features(text: str | None) -> np.ndarray:
    """The shape of one whole text."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kind = CLASS_OF[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kind[:-1] * N_CLASSES + kind[1:], minlength=N_CLASSES * N_CLASSES)
    out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / max(len(kind) - 1, 1))
    words, lines = words_of(text), [x for x in (text or "").split("\n") if x.strip()]
    n = max(len(words), 1)
    distinct = len(set(words))
    out[-6:] = [1.0, np.log1p(len(words)) / 8, sum(map(len, words)) / n / 10, distinct / n, distinct / np.sqrt(n) / 10, len(set(lines)) / max(len(lines), 1)]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Direction of descent of the non-negative risk at w, for rows p of positives and u of unlabelled texts."""
    sp, su = sigmoid(p @ w), sigmoid(u @ w)
    # Sigmoid loss: l(+) = 1 - s, l(-) = s; their slopes are -+ s (1 - s).
    dp, du = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
    negative = su.mean() - prior * sp.mean()
    return -prior * dp + du - prior * dp if negative >= 0 else -(du - prior * dp)


def descend(gradient, size: int, n: int, rounds: int, batch: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Adam over batches of indices below n."""
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(size), 0.0, 0.0, 0
    for _ in range(rounds):
        deal = rng.permutation(n)
        for a in range(0, n, batch):
            grad = gradient(w, deal[a : a + batch], rng) + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1), x.dtype)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 4) -> float:
    """The share of positives among the unlabelled rows, from an upper bound that is tight where a threshold holds hardly any negatives.

    A logistic model tells positives from unlabelled rows on one half of both. On the other half, for each threshold the share of
    unlabelled rows above it over that of positives bounds the prior; the least bound, with a margin for the sizes of the samples, counts.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    pos, unl = with_bias(positive), with_bias(unlabelled)
    halves = []
    for part in (0, 1):
        p, u = pos[part::2], unl[part::2]
        x, y = np.vstack((p, u)), np.concatenate((np.ones(len(p)), np.zeros(len(u))))
        weight = np.where(y == 1, 0.5 / len(p), 0.5 / len(u)) * len(y)

        def gradient(w, at, rng, x=x, y=y, weight=weight):
            return (weight[at] * (sigmoid(x[at] @ w) - y[at])) @ x[at] / len(at)

        w = descend(gradient, x.shape[1], len(x), 20, 512, 0.01, 1e-3, seed)
        a, b = np.sort(pos[1 - part :: 2] @ w), np.sort(unl[1 - part :: 2] @ w)
        at = np.quantile(a, np.linspace(0.02, 0.9, 45))
        of_p, of_u = 1 - np.searchsorted(a, at, "left") / len(a), 1 - np.searchsorted(b, at, "left") / len(b)
        margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(a)) + 1 / np.sqrt(len(b)))
        best = np.argmin((of_u + margin) / np.maximum(of_p, 1e-9))
        halves.append(of_u[best] / max(of_p[best], 1e-9))
    return float(np.clip(np.mean(halves), 0.01, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (the last one a bias) that minimise the non-negative risk."""
    pos, unl = with_bias(positive), with_bias(unlabelled)

    def gradient(w, at, rng):
        return pu_gradient(w, pos[rng.integers(0, len(pos), min(batch, len(pos)))], unl[at], prior)

    return descend(gradient, pos.shape[1], len(unl), rounds, batch, rate, decay, seed)


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to labels (Newton steps with a weak prior)."""
    if len(margin) < 2 or label.min() == label.max():
        return 1.0, 0.0
    x = np.column_stack((margin, np.ones_like(margin)))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        step = np.linalg.solve(hess, x.T @ (label - p) - 1e-2 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


class QualityModel:
    def __init__(self, mean, scale, weights, slope: float, offset: float):
        self.mean, self.scale, self.weights, self.slope, self.offset = mean, scale, weights, slope, offset

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def _with_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("label"), pa.array(x, pa.binary())], ["kind", "label", "x"])

    return rows.select("kind", "label", "text").mapInArrow(tidy(run), "kind int, label int, x binary")


def train(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> QualityModel:
    """Fit on at most max_rows labelled and max_rows unlabelled training rows; is_training is a column over the id."""
    known = labels.where(is_training & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("_id", F.lit(5)), "label").limit(max_rows)
    texts = docs.where(is_training & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("place", F.xxhash64("_id", "text", F.lit(6)))
    # Rows, not ids, are chosen: an id may stand in many rows.
    last = texts.select("place").distinct().orderBy("place").limit(max_rows).agg(F.max("place")).first()[0]
    plain = texts.where(F.col("place") <= F.lit(last)).dropDuplicates(["place"]).select(F.lit(0).alias("kind"), F.lit(0).alias("label"), "text")
    tagged = texts.join(F.broadcast(chosen), "_id").select(F.lit(1).alias("kind"), "label", "text", "place").dropDuplicates(["place", "label"])
    tagged = tagged.orderBy("place", "label").limit(max_rows).select("kind", "label", "text")
    got = sorted((r.kind, r.label, bytes(r.x)) for r in _with_features(plain.unionByName(tagged)).collect())  # 2 * max_rows at most
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    kind, label = (np.array([r[i] for r in got], np.int64) for i in (0, 1))
    pos, unl = (kind == 1) & (label == 1), kind == 0
    if not pos.any() or not unl.any():
        p = min(max(float(label[kind == 1].mean()) if (kind == 1).any() else 0.5, 1e-3), 1 - 1e-3)
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), 0.0), 1.0, float(np.log(p / (1 - p))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-2)
    model = QualityModel(mean, scale, None, 1.0, 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    model.prior = estimate_prior(z[pos], z[unl])
    model.weights = fit_pu(z[pos], z[unl], model.prior)
    model.slope, model.offset = calibrate(model.margin(x[kind == 1]), label[kind == 1].astype(float))
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id, the columns in `keep`, and `score`."""
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_scored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches):
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1), []
            for a in range(0, len(texts), 256):
                out.append(model.score(np.stack([features(t.as_py()) for t in texts[a : a + 256]]).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(tidy(run), f"{schema}, score double")
