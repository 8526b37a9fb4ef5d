"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by a small learned layer over
features of its spelling (letter case, digits, kinds of punctuation, repeats, word lengths); gated
attention, learned from labels of whole documents, weighs the passages; the weighted sum of the
encodings is scored by a logistic layer. A share of the sample is kept from training and places the
score so that 0.5 is the best cut.

Defined cases: a null or empty text is one passage without words; without both classes among the
learning rows (of short enough texts) every score is 0.5; ids with several labels count as 1 if one label says so; repeated rows
and extra columns do no harm. Long texts are more passages; their attention is summed in pieces, so
memory grows with the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, labelled_sample, map_arrow
from .textkernel import Words, blocks, table
from .toxicity import best_cut

PASSAGE = 64
#: Learning rows used of each class, and the most bytes of a text that teaches: both bound the driver's memory.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 3000, 1 << 16
CUT = 0.5
HIDDEN, GATE = 16, 12
EPOCHS = 25

#: Bytes counted for each passage, as shares of its bytes.
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#$%&*+=<>^~\\/_", b"|", b"\n", b" ", b"()[]{}\"'`:;-@"]
_KIND = np.full(256, len(_KINDS), np.int8)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
N_FEATURES = len(_KINDS) + 10


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and how many each row has."""
    words = Words(data, offsets)
    count = np.maximum(1, -(-words.count // PASSAGE))
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = words.range[:-1][row] + nth * PASSAGE
    last = np.minimum(first + PASSAGE, words.range[1:][row])
    size = last - first
    n = len(words.hash)
    # a passage's bytes go from its first word to the first of the next; the first and last also hold the text's edges
    begin = np.where(nth == 0, offsets[:-1][row], words.start[np.minimum(first, max(0, n - 1))] if n else 0)
    finish = np.append(begin[1:], offsets[-1])
    x = np.zeros((len(row), N_FEATURES), np.float32)
    width = np.maximum(1, finish - begin)
    kind = _KIND[data]
    for k in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        x[:, k] = (total[finish] - total[begin]) / width
    j = len(_KINDS)
    at = np.repeat(np.arange(len(row)), size)
    length = (words.end - words.start).astype(np.float32)
    some = np.maximum(1, size)
    x[:, j] = np.bincount(at, length, len(row)) / some / 10
    x[:, j + 1] = np.sqrt(np.maximum(0, np.bincount(at, length**2, len(row)) / some / 100 - x[:, j] ** 2))
    key = (words.hash & np.uint64((1 << 32) - 1)).astype(np.int64) | (at.astype(np.int64) << 32)
    ordered = np.sort(key)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    x[:, j + 2] = np.bincount((ordered[new] >> 32), minlength=len(row)) / some
    same = np.zeros(n, bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (at[1:] == at[:-1])
    x[:, j + 3] = np.bincount(at[same], minlength=len(row)) / some
    upper = (data[words.start] >= 65) & (data[words.start] <= 90) if n else np.zeros(0, bool)
    x[:, j + 4] = np.bincount(at[upper], minlength=len(row)) / some
    x[:, j + 5] = np.bincount(at[length <= 2], minlength=len(row)) / some
    x[:, j + 6] = np.bincount(at[length >= 12], minlength=len(row)) / some
    gap = np.zeros(n, np.float32)
    gap[:-1] = words.start[1:] - words.end[:-1]
    gap[last[size > 0] - 1] = 1
    x[:, j + 7] = np.bincount(at, np.minimum(gap, 20), len(row)) / some / 4
    x[:, j + 8] = size / PASSAGE
    x[:, j + 9] = np.log1p(words.count[row]) / 8
    return x, count


class Attention:
    """encode -> gated attention -> logistic layer; softmax weights within each bag."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = {"e": r.normal(0, 0.3, (N_FEATURES, HIDDEN)), "eb": np.zeros(HIDDEN), "v": r.normal(0, 0.3, (HIDDEN, GATE)), "u": r.normal(0, 0.3, (HIDDEN, GATE)), "a": r.normal(0, 0.3, GATE), "o": r.normal(0, 0.3, HIDDEN), "ob": np.zeros(1)}
        self.scale, self.shift = 1.0, 0.0

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
        p, begin = self.p, np.cumsum(count) - count
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["e"] + p["eb"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        s = (v * u) @ p["a"]
        w = np.exp(s - np.repeat(np.maximum.reduceat(s, begin), count))
        w /= np.repeat(np.add.reduceat(w, begin), count)
        z = np.add.reduceat(w[:, None] * h, begin, 0)
        return z @ p["o"] + p["ob"][0], {"x": x, "h": h, "v": v, "u": u, "w": w, "z": z, "begin": begin}

    def gradient(self, d: np.ndarray, count: np.ndarray, c: dict) -> dict:
        p, g = self.p, {}
        g["o"], g["ob"] = c["z"].T @ d, np.array([d.sum()])
        dz = np.repeat(d[:, None] * p["o"], count, 0)
        dw = (dz * c["h"]).sum(1)
        ds = c["w"] * (dw - np.repeat(np.add.reduceat(c["w"] * dw, c["begin"]), count))
        g["a"] = (c["v"] * c["u"]).T @ ds
        dv = ds[:, None] * p["a"] * c["u"] * (1 - c["v"] ** 2)
        du = ds[:, None] * p["a"] * c["v"] * c["u"] * (1 - c["u"])
        g["v"], g["u"] = c["h"].T @ dv, c["h"].T @ du
        dh = (c["w"][:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - c["h"] ** 2)
        g["e"], g["eb"] = c["x"].T @ dh, dh.sum(0)
        return g

    def train(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 9, batch: int = 64) -> None:
        r = np.random.default_rng(seed)
        one, two = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        t = 0
        for epoch in range(EPOCHS):
            for some in np.array_split(r.permutation(len(bags)), max(1, len(bags) // batch)):
                count = np.array([len(bags[i]) for i in some])
                logit, c = self.forward(np.concatenate([bags[i] for i in some]), count)
                g = self.gradient((1 / (1 + np.exp(-logit)) - y[some]) * weight[some] / len(some), count, c)
                t += 1
                for k in self.p:
                    full = g[k] + 1e-4 * self.p[k]
                    one[k] = 0.9 * one[k] + 0.1 * full
                    two[k] = 0.999 * two[k] + 0.001 * full**2
                    self.p[k] -= 0.01 / (1 + epoch / 8) * one[k] / (1 - 0.9**t) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logit - self.shift), -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Attention | None:
    """A model of the learning fold's sample, or None where it lacks a class."""
    sample = F.broadcast(labelled_sample(labels, "quality", per_class))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("bag", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                x, count = passages(data, offsets)
                edge = np.concatenate([[0], np.cumsum(count)])
                yield table(schema, doc_id=batch.column("doc_id")[first:end], y=batch.column("y")[first:end], bag=[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])

    short = F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES
    drawn = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(short).join(sample, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    rows = sorted(drawn.transform(map_arrow, run, "doc_id long, y int, bag binary").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["bag"]))
    y = np.array([r["y"] for r in rows], int)
    if len(np.unique(y)) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    kept = np.zeros(len(y), bool)
    for v in (0, 1):
        kept[np.flatnonzero(y == v)[::5]] = True
    if len(np.unique(y[~kept])) < 2:
        kept[:] = False
    learning = [b for b, k in zip(bags, kept, strict=True) if not k]
    every = np.concatenate(learning)
    model = Attention(every.mean(0), every.std(0) + 1e-3)
    model.train(learning, y[~kept])
    use = kept if len(np.unique(y[kept])) == 2 else ~kept
    count = np.array([len(b) for b in bags])
    logit = model.forward(np.concatenate(bags), count)[0][use]
    model.shift = best_cut(logit, y[use], float(np.clip((y == 1).mean(), 0.5, 0.9)))
    return model


def rate(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Per document: held_out, score, predicted (score >= 0.5), passages, and the largest attention weight."""
    model = fit(documents, labels, per_class)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64()), ("top_attention", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text"), 1 << 20):
                x, count = passages(data, offsets)
                score, top = np.full(end - first, 0.5), 1 / count
                if model:
                    logit, c = model.forward(x, count)
                    score, top = model.score(logit), np.maximum.reduceat(c["w"], c["begin"])
                yield table(schema, doc_id=batch.column("doc_id")[first:end], held_out=batch.column("held_out")[first:end], score=score, predicted=(score >= CUT).astype(np.int32), n_passages=count, top_attention=top)

    scan = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold("doc_id", 3, 1).alias("held_out"))
    return scan.transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_attention double")
