"""Language identification with a string kernel, Nystrom landmarks and one-versus-rest kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of n-grams of 1 to 3 letters (runs of other characters
count as one space) present in both, over the geometric mean of their own numbers. Letters are lower-cased and mapped to
the 62 most frequent ones of the landmarks; the n-grams are those of the landmarks. Landmark texts span the
feature space (Nystrom), ridge regression in it gives one score a language, and scoring is two matrix products a batch.

Training uses at most `per_language` labelled texts of each language, in order of a hash of the row, the first `landmarks`
of them as landmarks; with many languages fewer of each (down to 4 and 2), so that about `max_rows` suffice. Prediction covers whole texts.

A text that is null or without letters is `und` with score 0. Empty tables give no rows; with nothing to learn
from, every text is `und`. Ties between languages go to the first in alphabetical order. Extra columns are ignored; null and
repeated ids are kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy

SIZE = 64
CODES = SIZE + SIZE**2 + SIZE**3


def letter_table(texts: list[str]) -> np.ndarray:
    """Class of each code point below 2^16: 0 for no letter, 1 for a rare letter, 2 to 63 for the most frequent ones."""
    table = np.array([int(chr(c).isalpha()) if not 0xD800 <= c < 0xE000 else 0 for c in range(1 << 16)], np.int64)
    count = Counter(c for t in texts for c in t.lower() if c.isalpha() and ord(c) < 1 << 16)
    for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: SIZE - 2]):
        table[ord(c)] = i + 2
    return table


def gram_codes(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(points < 1 << 16, table[np.minimum(points, 0xFFFF)], 1)
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    return np.concatenate((c, SIZE + c[:-1] * SIZE + c[1:], SIZE + SIZE**2 + (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]))


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, column: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.table, self.column, self.landmarks, self.weights = languages, table, column, landmarks, weights
        self.own = np.sqrt(np.maximum(landmarks.sum(1), 1))

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[1] + 1), np.float32)
        for i, t in enumerate(texts):
            out[i, self.column[gram_codes(t, self.table)]] = 1
        return out[:, :-1]  # the last column takes n-grams that no landmark has

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
        return (presence @ self.landmarks.T) / own / self.own

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(self.presence(texts)) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for a, b in slices([1] * len(use), 128):
            got = self.scores([texts[i] for i in use[a:b]])
            best = got.argmax(1)
            for i, k, s in zip(use[a:b], best, got.max(1)):
                names[i] = self.languages[k]
                score[i] = min(1.0, max(0.0, (s + 1) / 2))
        return names, score


def fit(texts: list[str], langs: list[str], landmarks: list[int], ridge: float = 1e-3) -> LanguageModel:
    """Model from texts and their languages; `landmarks` are positions among them."""
    languages = sorted(set(langs))
    table = letter_table([texts[i] for i in landmarks])
    grams = [np.unique(gram_codes(texts[i], table)) for i in landmarks]
    seen = np.unique(np.concatenate(grams))
    column = np.full(CODES, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    marks = np.zeros((len(grams), len(seen)), np.float32)
    for i, g in enumerate(grams):
        marks[i, column[g]] = 1
    model = LanguageModel(languages, table, column, marks, np.zeros((len(grams), len(languages)), np.float32))
    square, axes = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = square > 1e-6 * square.max()
    root = axes[:, good] / np.sqrt(square[good])
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for a in range(0, len(texts), 128):
        phi = model.kernel(model.presence(texts[a : a + 128])).astype(np.float64) @ root
        target = np.array([[1.0 if x == y else -1.0 for y in languages] for x in langs[a : a + 128]])
        gram += phi.T @ phi
        right += phi.T @ target
    model.weights = (root @ np.linalg.solve(gram + ridge * len(texts) * np.eye(len(gram)), right)).astype(np.float32)
    return model


def train(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250, landmarks: int = 40, max_rows: int = 20_000) -> LanguageModel | None:
    """Learn from training rows with a language; None if there are none."""
    text = F.col(text_col).cast("string")
    known = docs.where(is_training & F.col(lang_col).isNotNull() & text.isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text, F.lit(9)).alias("place"))
    names = [r[0] for r in known.groupBy("lang").count().collect()]  # a row for each language
    if not names:
        return None
    per_language = max(4, min(per_language, max_rows // len(names)))
    first = Window.partitionBy("lang").orderBy("place")
    # The places are chosen without the texts; rows that share a place are equal, and the second cut bounds them.
    chosen = known.select("lang", "place").withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("lang", "place").distinct()
    rows = known.join(F.broadcast(chosen), ["lang", "place"]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    rows = [r for r in sorted(rows.select("lang", "place", "text").collect()) if any(map(str.isalpha, r.text))]
    if not rows:
        return None
    seen: Counter = Counter()
    at = []
    for i, r in enumerate(rows):
        seen[r.lang] += 1
        if seen[r.lang] <= max(2, min(landmarks, max_rows // 10 // len(names))):
            at.append(i)
    return fit([r.text for r in rows], [r.lang for r in rows], at)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id, the columns in `keep`, lang_pred and lang_score."""
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_read"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "lang_score"])

    return rows.mapInArrow(tidy(run), f"{schema}, lang_pred string, lang_score double")
