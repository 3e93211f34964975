"""Language identification with a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths run over them, each filter's largest response in a window is kept (max pooling), and
a softmax over languages follows. Training minimises cross-entropy with Adam on windows of labelled texts. A text is read
as consecutive windows of ``WINDOW`` bytes, all of it; its log-probabilities are the mean over its windows, weighted by their letters' bytes.

The network is fitted on a bounded sample: of all windows of all labelled texts, each distinct text counting once, the ``SAMPLE`` with the smallest hashes
for each label (fewer where there are so many labels that ``TOTAL`` would be passed). Windows are cut and chosen on the executors; the driver
gets the sample alone. Everything else reads every row whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without label are predicted but not learned
from; without any labelled row every prediction is ``und``; with one label it is that label; repeated rows get equal predictions; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import field, map_rows, texts_of

WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4, 5), 16
SAMPLE, TOTAL, EPOCHS, BATCH, RATE, SEED = 1_800, 400_000, 12, 128, 0.004, 7
_LETTER_BYTES = np.array([bytes([b]).isalpha() or b >= 128 for b in range(256)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in rows of ``size`` bytes, the last one padded with spaces."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size), np.uint8).reshape(n, size)


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        e = self.embed[x]
        parts, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            flat = np.concatenate([e[:, i : e.shape[1] - w + 1 + i] for i in range(w)], axis=2)
            r = flat @ f
            at = r.argmax(axis=1)
            top = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + b
            parts.append(np.maximum(top, 0))
            kept.append((at, top))
        return np.concatenate(parts, axis=1), kept

    def log_probs(self, x: np.ndarray, at_once: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float64)
        for i in range(0, len(x), at_once):
            e = self.embed[x[i : i + at_once]]
            parts = []
            for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
                n = e.shape[1] - w + 1
                r = e[:, :n] @ f[:EMBED]
                for j in range(1, w):
                    r += e[:, j : n + j] @ f[j * EMBED : (j + 1) * EMBED]
                parts.append(np.maximum(r.max(axis=1) + b, 0))
            z = np.concatenate(parts, axis=1) @ self.out + self.out_bias
            z = z.astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            out[i : i + len(z)] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def fresh(labels: list[str], seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    filters = [normal(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS]
    return Network(labels, normal(256, EMBED, scale=0.5), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(labels), scale=0.1), np.zeros(len(labels), np.float32))


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, each row weighted by its label's ``weight``: embedding, filters, their biases, output, its bias."""
    h, kept = net.pooled(x)
    z = h @ net.out + net.out_bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight[y] / len(y))[:, None]
    gh, g_embed = p @ net.out.T, np.zeros_like(net.embed)
    g_filters, g_bias = [], []
    for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        at, top = kept[k]
        g = gh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)  # rows x filters, all at their pooled positions
        bytes_at = np.stack([np.take_along_axis(x, at + j, axis=1) for j in range(w)], axis=2)  # rows x filters x w
        seen = net.embed[bytes_at].reshape(len(x), FILTERS, w * EMBED)
        g_filters.append(np.einsum("rf,rfd->df", g, seen))
        g_bias.append(g.sum(axis=0))
        np.add.at(g_embed, bytes_at.reshape(-1), (g[:, :, None] * f.T[None]).reshape(-1, EMBED))
    return [g_embed, *g_filters, *g_bias, h.T @ p, p.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """x: windows of bytes; y: label numbers. Adam on batches; labels weigh alike."""
    net, rng = fresh(labels, seed), np.random.default_rng(seed)
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = len(y) / np.maximum(np.bincount(y, minlength=len(labels)).astype(np.float32), 1) / len(labels)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            ix = order[i : i + BATCH]
            step += 1
            for p, g, (m, v) in zip(params, gradients(net, x[ix], y[ix], weight), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, label_col: str = "lang", text_col: str = "text", most: int = SAMPLE) -> dict[str, list[bytes]]:
    """Windows to learn from, by label."""
    known = docs.select(field(label_col).cast("string").alias("label"), field(text_col).alias("text")).filter("label is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    sizes = known.select("label", F.xxhash64("text"), F.ceil(F.octet_length("text") / WINDOW).alias("n")).distinct().groupBy("label").agg(F.sum("n").alias("n")).collect()  # a row for each label
    if not sizes:
        return {}
    most = max(1, min(most, TOTAL // len(sizes)))
    # windows whose hash falls below a bound: somewhat more than are wanted
    bounds = {r["label"]: min(1 << 64, int((1 << 64) * (1.2 * most + 50) / r["n"])) for r in sizes}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for label, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                bound = bounds[label]
                for w in windows(raw):
                    held = w.tobytes()
                    h = xxhash.xxh64_intdigest(held, SEED)
                    if h < bound and _LETTER_BYTES[w].any():
                        found.append((label, h - (1 << 63), held))
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["label", "h", "bytes"])

    chosen: dict[str, list[tuple[int, bytes]]] = {}
    for r in known.mapInArrow(cut, "label string, h long, bytes binary").distinct().collect():
        chosen.setdefault(r["label"], []).append((r["h"], bytes(r["bytes"])))
    return {label: [w for _, w in sorted(rows)[:most]] for label, rows in sorted(chosen.items())}


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", most: int = SAMPLE) -> Network | None:
    """Learns from rows with a label and a text; None if there are none."""
    chosen = sample(docs, label_col, text_col, most)
    if not chosen:
        return None
    labels = list(chosen)
    x = np.stack([np.frombuffer(w, np.uint8) for label in labels for w in chosen[label]])
    return train(x, np.repeat(np.arange(len(labels)), [len(chosen[label]) for label in labels]), labels)


def predict_texts(net: Network | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    todo = [i for i, t in enumerate(texts) if t and has_letter(t.decode())]
    group: list[int] = []
    size = 0
    for k, i in enumerate(todo):
        group.append(i)
        size += len(texts[i])
        if size > 1 << 20 or k == len(todo) - 1:
            rows = [windows(texts[j]) for j in group]
            x = np.concatenate(rows)
            weight = _LETTER_BYTES[x].sum(axis=1) + 1e-9
            logs = net.log_probs(x) * weight[:, None]
            cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
            z = np.add.reduceat(logs, cuts) / np.add.reduceat(weight, cuts)[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for j, best, top in zip(group, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[j], scores[j] = net.labels[best], top
            group, size = [], 0
    return names, scores


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` of every row. The network (some 20 KB) goes to the executors as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(text: pa.Array) -> list[pa.Array]:
        names, scores = predict_texts(sent.value, texts_of(text))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return map_rows(docs, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType())], run, keep)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id's text is empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2
