"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded; gated attention weights,
learned from labels of documents alone, say how much each passage counts; the weighted passage
representation is scored. Training reads a bounded sample of labelled documents; scoring reads
everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.rolling import blocks, prefix, runs

PASSAGE = 512  # bytes
#: Class of each byte: letters, capitals, digits, blanks, line breaks, each mark that junk likes, other marks, above ASCII.
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "#", "*", "$", "%", "&", "<>|", "?;:'\"()-")
N_CLASSES = len(_GROUPS) + 2
CLASS = np.full(256, len(_GROUPS), np.int64)
CLASS[128:] = len(_GROUPS) + 1
for _k, _g in enumerate(_GROUPS):
    for _c in _g.encode():
        CLASS[_c] = _k
N_FEATURES = N_CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the number of passages of each text (one at least)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    each = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(each) - each
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    at = first[doc] + np.minimum(inside // PASSAGE, each[doc] - 1)
    total = int(each.sum())
    hist = np.bincount(at * N_CLASSES + CLASS[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(float)
    length = hist.sum(1)
    blank = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)))
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    hashed, where, whose = runs(prefix(data), begin, end), at[begin], doc[begin]
    count = np.bincount(where, minlength=total).astype(float)
    again = []
    for gap in (1, 2):
        same = (hashed[gap:] == hashed[:-gap]) & (whose[gap:] == whose[:-gap])
        again.append(np.bincount(where[gap:][same], minlength=total) / (count + 5))
    return np.column_stack([np.log1p(50 * hist / (length + 20)[:, None]), *(np.log1p(10 * a) for a in again), np.log1p(count / (length + 20) * 20), np.log1p(length) / 5]), each


def _per_batch(batch: pa.RecordBatch, at: int):
    """(features, passages of each text) of parts of a batch, in order."""
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
    for a, b in blocks([len(t) for t in texts]):
        yield passages(texts[a:b])


class Model:
    """Standardised features, a tanh encoder, gated attention and a logistic score."""

    def __init__(self, hidden: int = 16, seed: int = 7) -> None:
        draw = np.random.default_rng(seed).normal
        self.p = {
            "E": draw(0, 0.3, (N_FEATURES, hidden)), "e": np.zeros(hidden),
            "V": draw(0, 0.3, (hidden, hidden)), "U": draw(0, 0.3, (hidden, hidden)), "w": draw(0, 0.3, hidden),
            "c": draw(0, 0.3, hidden), "d": np.zeros(1),
        }
        self.mean, self.dev = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, start = self.p, np.cumsum(each) - each
        x = (x - self.mean) / self.dev
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), each))
        a /= np.repeat(np.add.reduceat(a, start), each)
        z = np.add.reduceat(h * a[:, None], start)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30))), (x, h, t, g, a, z, start)

    def fit(self, x: np.ndarray, each: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Adam over the whole sample."""
        self.mean, self.dev = x.mean(0), x.std(0) + 0.05
        weight = np.full(len(y), 1 / len(y))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            for k, g in self._gradient(x, each, y, weight).items():
                g = g + decay * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, each: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (x, h, t, g, a, z, start) = self.forward(x, each)
        do = (score - y) * weight
        dz = np.repeat(do[:, None] * p["c"], each, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, start), each))
        dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ do, "d": do.sum(keepdims=True)}


def held_out(key: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the key as text leaves 2 when divided by 4. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 4000) -> Model:
    """A model from at most ``most`` labelled documents that are not held out, chosen by the hash of their key.

    Only the features of those documents come to the driver. Rows without key or label are not used;
    without any labelled document the model is untrained and its scores say nothing.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    chosen = usable.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [part.astype(np.float32).tobytes() for x, each in _per_batch(batch, 1) for part in np.split(x, np.cumsum(each)[:-1])]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0).cast(pa.string()), "y": batch.column(2), "x": pa.array(rows, pa.binary())})

    picked = docs.select(key, text).join(F.broadcast(chosen), key).select(key, text, "_y").mapInArrow(run, "key string, y double, x binary")
    got = sorted((r["key"], r["y"], bytes(r["x"])) for r in picked.collect())
    if not got:
        return Model()
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(float) for _, _, x in got]
    return Model().fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns of docs with score and predicted; one row for each row of docs.

    Every passage of the whole text counts; a null or empty text is one empty passage and gets the
    score of such. Equal texts have equal scores. No rows give none. Columns named score or
    predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.forward(x, each)[0] for x, each in _per_batch(batch, at)]
            scores = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
