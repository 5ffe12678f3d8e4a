"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of which only the whole has a label. Every passage is encoded (statistics of its
words and a histogram of their shapes, then a learned layer); learned gates weigh the passages, and the weighted
sum of their encodings is scored. All passages of a text take part, at any length.

Training reads a bounded sample of labelled documents: at most ``docs_per_label`` of each label, the smallest by a
hash of the id, and at most ``passages`` passages in all. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow

SHAPES = 64
STATS = 7  # per word: letters, capitals, digits, other signs, first is capital, length, length squared
REMEMBERED = 300_000


def shape_of(word: str) -> str:
    """Kinds of its characters without repeats: ``Aa`` for a capitalised word, ``a!`` for ``so!!``."""
    out = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:8])


class Passages:
    """Turns texts into passage features; remembers what it computed for words."""

    def __init__(self, words: int):
        self.size = words
        self.index: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.matrix = np.zeros((0, STATS + 1))

    def _word(self, w: str) -> tuple:
        upper = sum(map(str.isupper, w))
        alpha = sum(map(str.isalpha, w))
        digit = sum(map(str.isdigit, w))
        return (alpha, upper, digit, len(w) - alpha - digit, w[0].isupper(), len(w), min(len(w), 50) ** 2, xxhash.xxh32_intdigest(shape_of(w)) % SHAPES)

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all passages, and each text's number of passages (one without words if it is empty)."""
        size, index = self.size, self.index
        if len(index) > REMEMBERED:
            index.clear()
            self.rows.clear()
            self.matrix = np.zeros((0, STATS + 1))
        counts, lengths, distinct, most, all_words = [], [], [], [], []
        for text in texts:
            words = (text or "").split()
            all_words += words
            parts = max(1, -(-len(words) // size))
            counts.append(parts)
            for k in range(parts):
                part = words[k * size : (k + 1) * size]
                kinds = {*part}
                lengths.append(len(part))
                distinct.append(len(kinds))
                most.append(max(map(part.count, kinds)) if 0 < len(kinds) < 12 else 0)
        for w in {*all_words}:
            if w not in index:
                index[w] = len(self.rows)
                self.rows.append(self._word(w))
        if len(self.matrix) < len(self.rows):
            self.matrix = np.concatenate([self.matrix, np.array(self.rows[len(self.matrix) :], dtype=np.float64)])
        ids = np.fromiter(map(index.__getitem__, all_words), np.int64, len(all_words))
        n = np.array(lengths, dtype=np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        values = self.matrix[ids]
        sums = np.stack([np.bincount(owner, values[:, j], len(n)) for j in range(STATS)], axis=1)
        shapes = np.bincount(owner * SHAPES + values[:, STATS].astype(np.int64), minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
        per_word, per_char = np.maximum(n, 1)[:, None], np.maximum(sums[:, 5:6], 1)
        out = np.concatenate(
            [sums[:, :4] / per_char, sums[:, 4:7] / per_word, np.log1p(n)[:, None], np.array(distinct)[:, None] / per_word,
             np.array(most)[:, None] / per_word, np.bincount(owner, same, len(n))[:, None] / per_word, shapes / per_word], axis=1,
        )
        return out.astype(np.float32), np.array(counts, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    words: int
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        owner = np.repeat(np.arange(len(counts)), counts)
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, owner, starts, z @ p["c"] + p["c0"]

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return _sigmoid(self.forward((features - self.mean) / self.scale, counts)[-1])


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, words: int, *, hidden: int = 24, gates: int = 12, epochs: int = 40, bags: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam over bags on the balanced cross-entropy."""
    rng = np.random.default_rng(seed)
    d = features.shape[1]
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    p = {"W": init(d, hidden), "b": np.zeros(hidden), "V": init(hidden, gates), "U": init(hidden, gates), "w": rng.normal(0, 0.1, gates), "c": rng.normal(0, 0.1, hidden), "c0": np.zeros(1)}
    model = AttentionModel(words, mean, scale, p)
    x_all = (features - mean) / scale
    starts_all = np.concatenate([[0], np.cumsum(counts)])
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)])
    weight = len(labels) / (2 * share[labels])
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), bags):
            pick = order[at : at + bags]
            x = np.concatenate([x_all[starts_all[i] : starts_all[i + 1]] for i in pick])
            h, t, g, a, z, owner, starts, logit = model.forward(x, counts[pick])
            dlogit = weight[pick] * (_sigmoid(logit) - labels[pick]) / len(pick)
            dz = np.outer(dlogit, p["c"])[owner]
            dh = a[:, None] * dz
            da = (dz * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, starts)[owner])
            dtg = np.outer(de, p["w"])
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["U"].T
            dpre = dh * (1 - h * h)
            grads = {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dlogit, "c0": np.array([dlogit.sum()])}
            step += 1
            for k, v in grads.items():
                v = v + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *,
    docs_per_label: int = 1500, passages: int = 40_000, words: int = 80, **options,
) -> AttentionModel | None:
    """Learn the 0/1 label; ``None`` if there is nothing to learn from.

    A document with several labels counts with the smallest, one without a label or an id is not used.
    """
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    order = F.xxhash64("i", F.lit(29))
    picked = [marked.where(F.col("y") == y).orderBy(order, "i").limit(docs_per_label) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).groupBy("i").agg(F.min("y").alias("y"))
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(picked), "i")
    encoder = Passages(words)

    def encode(cols):
        x, n = encoder.features(cols["text"])
        ends = np.cumsum(n)
        return {"i": cols["i"], "y": cols["y"], "x": [x[e - k : e].ravel().tolist() for e, k in zip(ends, n)]}

    kind = docs.schema[id_col].dataType.simpleString()
    bags = map_arrow(sample, encode, f"i {kind}, y int, x array<float>").orderBy(order, "i")
    width, held, xs, ns, ys = STATS + 4 + SHAPES, 0, [], [], []
    for row in bags.toLocalIterator():
        x = np.asarray(row["x"], np.float32).reshape(-1, width)
        if held + len(x) <= passages:
            held += len(x)
            xs.append(x)
            ns.append(len(x))
            ys.append(row["y"])
    if not xs:
        return None
    return fit(np.concatenate(xs), np.array(ns), np.array(ys), words, **options)


def score(docs: DataFrame, model: AttentionModel | None, *, keep: list[str | Column] | None = None, text_col: str = "text", into: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` (all by default, ``into`` replaced) with the score ``into`` from 0 to 1.

    One row per input row. A null or empty text is one passage without words and is scored like any other;
    without a model every score is 0.5.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    encoder = Passages(model.words if model else 1)

    def run(cols):
        texts = cols.pop("__text")
        if shipped.value is None:
            return {**cols, into: [0.5] * len(texts)}
        out = []
        for at in range(0, len(texts), 256):
            out += shipped.value.scores(*encoder.features(texts[at : at + 256])).tolist()
        return {**cols, into: out}

    names = keep if keep is not None else [c for c in docs.columns if c != into]
    kept = docs.select(*names).schema.fields
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_arrow(docs.select(*names, F.col(text_col).alias("__text")), run, f"{fields}, `{into}` double", keep=[f.name for f in kept])
