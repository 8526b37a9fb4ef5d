"""Toxicity by a convolutional text classifier trained in numpy.

A word is embedded as the sum of three learned rows: of its own hash and of the hashes of its first four
and six bytes, so that inflected forms share what their stem has taught. Rows are learned for hashes
whose share of toxic and other texts differs by more than chance; all others stay zero. Filters of widths 1, 2 and 3 run
over the whole text, are rectified and max-pooled, and a logistic layer gives the logit. As each filter
is linear in the words it spans, scoring gathers one precomputed row for each word instead of
multiplying embeddings again. A share of the sample is kept from training: it places the score so that
0.7 is the best cut, and gives each language its own threshold.

Defined cases: a null or empty text has pooled values of zero and so the model's base score; without
both classes among the learning rows (of short enough texts) every score is 0.5; ids with several labels count as toxic if one
label says so; rows with a null language use the threshold 0.7; repeated rows and extra columns do no
harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, labelled_sample, map_arrow
from .textkernel import Words, blocks, span_keys, table

#: Learning rows used of each class, and the most bytes of a text that teaches: both bound the driver's memory.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 1 << 15
CUT = 0.7
DIM = 16
FILTERS = 6
WIDTHS = (1, 2, 3)
EPOCHS = 6
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)
_BITS = 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a block, and for each its hash and those of its prefixes."""
    words = Words(data, offsets)
    parts = [words.hash, *(span_keys(words.folded, words.start, np.minimum(words.end, words.start + n)) ^ np.uint64(n) for n in PREFIXES)]
    return words, np.stack(parts, 1)


class Rows:
    """Known hashes to row numbers from 1; row 0 is for all others. A slot's hash is compared in full."""

    def __init__(self, known: np.ndarray):
        self.known = np.concatenate([[np.uint64(0)], known])
        self.slot = np.zeros(1 << _BITS, np.int32)
        self.next = np.zeros(len(self.known), np.int32)
        self.depth = 0
        for i, h in enumerate(known, 1):
            at, depth = int(h >> np.uint64(64 - _BITS)), 1
            self.next[i], self.slot[at] = self.slot[at], i
            while (i := self.next[i]) > 0:
                depth += 1
            self.depth = max(self.depth, depth)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slot[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
        out = np.zeros(hashes.shape, np.int32)
        for _ in range(self.depth):
            hit = (at > 0) & (self.known[at] == hashes)
            out[hit] = at[hit]
            at = self.next[at]
        return out


def padded(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two pads after each text; where each text begins, and which positions are words."""
    size = count + 2
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = np.zeros((int(size.sum()), PARTS), np.int32)
    where = np.arange(len(ids)) + 2 * np.repeat(np.arange(len(count)), count)
    out[where] = ids
    real = np.zeros(len(out), bool)
    real[where] = True
    return out, begin, real


class Model:
    """The trained network; ``scale`` and ``shift`` place its logit so that the cut lies at 0.7."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.rows = Rows(known)
        self.embed = r.normal(0, 0.1, (len(known) + 1, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out, self.base = r.normal(0, 0.3, len(self.bias)).astype(np.float32), 0.0
        self.scale, self.shift, self.thresholds = 1.0, 0.0, {}

    def responses(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids].sum(1)
        x = np.concatenate([x, np.zeros((2, DIM), np.float32)])
        n = len(ids)
        return np.concatenate([sum(x[k : k + n] @ f[k] for k in range(len(f))) for f in self.filters], 1) + self.bias

    def train(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 11, batch: int = 32) -> None:
        r = np.random.default_rng(seed)
        square = [np.zeros(len(self.embed), np.float32), [np.zeros_like(f) for f in self.filters], np.zeros_like(self.bias), np.zeros_like(self.out), 0.0]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for epoch in range(EPOCHS):
            rate = 0.1 / (1 + epoch)
            order = r.permutation(len(docs))
            for some in np.array_split(order, max(1, len(docs) // batch)):
                ids, begin, real = padded(np.concatenate([docs[i] for i in some]), np.array([len(docs[i]) for i in some]))
                z = self.responses(ids)
                z[~real] = 0
                pooled = np.maximum(np.maximum.reduceat(z, begin), 0)
                logit = pooled @ self.out + self.base
                d = (1 / (1 + np.exp(-logit)) - y[some]) * weight[some] / len(some)
                g_out, g_base = d @ pooled + 1e-4 * self.out, d.sum()
                g_pool = d[:, None] * self.out * (pooled > 0)
                size = np.diff(np.append(begin, len(ids)))
                at = np.full(pooled.shape, -1)
                row, col = np.nonzero(z == np.repeat(np.where(pooled > 0, pooled, np.inf), size, 0))
                at[np.repeat(np.arange(len(some)), size)[row][::-1], col[::-1]] = row[::-1]  # the first of equals
                g_embed: list[tuple[np.ndarray, np.ndarray]] = []
                for j, f in enumerate(self.filters):
                    part = slice(j * FILTERS, (j + 1) * FILTERS)
                    doc, unit = np.nonzero(at[:, part] >= 0)
                    where, g = at[:, part][doc, unit], g_pool[:, part][doc, unit]
                    g_f = np.zeros_like(f)
                    for k in range(len(f)):
                        tokens = ids[np.minimum(where + k, len(ids) - 1)]
                        x = self.embed[tokens].sum(1)
                        np.add.at(g_f[k].T, unit, g[:, None] * x)
                        g_embed.append((tokens, g[:, None] * f[k][:, unit].T))
                    square[1][j] += g_f**2
                    f -= rate * g_f / (np.sqrt(square[1][j]) + 1e-6)
                tokens, g = np.concatenate([t for t, _ in g_embed]), np.concatenate([x for _, x in g_embed])
                rows, back = np.unique(tokens, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, back.reshape(tokens.shape), g[:, None])
                total += 1e-4 * self.embed[rows]
                total[rows == 0] = 0
                square[0][rows] += (total**2).mean(1)
                self.embed[rows] -= rate * total / (np.sqrt(square[0][rows])[:, None] + 1e-6)
                g_bias = g_pool.sum(0)
                for k, (param, g) in enumerate(((self.bias, g_bias), (self.out, g_out)), 2):
                    square[k] += g**2
                    param -= rate * g / (np.sqrt(square[k]) + 1e-6)
                square[4] += g_base**2
                self.base -= rate * g_base / (np.sqrt(square[4]) + 1e-6)

    def table(self) -> np.ndarray:
        """The filters' responses to each row at each place of each width."""
        return self.embed @ np.concatenate([f[k] for f in self.filters for k in range(len(f))], 1)

    def logits(self, ids: np.ndarray, count: np.ndarray, responses: np.ndarray) -> np.ndarray:
        out = np.empty(len(count))
        edge = np.concatenate([[0], np.cumsum(count)])
        first = 0
        while first < len(count):  # some ten thousand words at a time, so that their rows stay in cache
            end = max(first + 1, int(np.searchsorted(edge, edge[first] + 40_000, "right")) - 1)
            tokens, begin, real = padded(ids[edge[first] : edge[end]], count[first:end])
            rows = responses[tokens[:, 0]]
            for k in range(1, PARTS):
                some = np.flatnonzero(tokens[:, k])
                rows[some] += responses[tokens[some, k]]
            rows = np.concatenate([rows, np.zeros((2, rows.shape[1]), np.float32)])
            n, place, parts = len(tokens), 0, []
            for w in WIDTHS:
                parts.append(sum(rows[k : k + n, (place + k) * FILTERS : (place + k + 1) * FILTERS] for k in range(w)))
                place += w
            z = np.concatenate(parts, 1) + self.bias
            z[~real] = 0
            out[first:end] = np.maximum(np.maximum.reduceat(z, begin), 0) @ self.out + self.base
            first = end
        return out

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logit - self.shift) + np.log(CUT / (1 - CUT)), -40, 40)))


def telling(docs: list[np.ndarray], y: np.ndarray, least: float = 4.5, docs_at_least: int = 3) -> np.ndarray:
    """The hashes whose share of toxic and other texts differs by more than chance."""
    found = [np.unique(d) for d in docs]
    keys, back = np.unique(np.concatenate(found), return_inverse=True)
    one, both = np.bincount(back, np.repeat(y, [len(x) for x in found]), len(keys)), np.bincount(back, minlength=len(keys))
    n1, n = max(1, y.sum()), len(y)
    n0, p = max(1, n - n1), both / n
    z = (one / n1 - (both - one) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return keys[(np.abs(z) >= least) & (both >= docs_at_least)]


def unlike(docs: list[np.ndarray], slots: int = 8, most: int = 4) -> np.ndarray:
    """Which texts share at most ``most`` of their ``slots`` minimal word hashes with every text before them.

    Near copies in the sample would teach that the words of one text are toxic.
    """
    r = np.random.default_rng(3)
    mult = r.integers(1, 1 << 62, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sketch = np.zeros((len(docs), slots), np.uint64)
    for i, d in enumerate(docs):
        sketch[i] = (d[:, :1] * mult).min(0) if len(d) else i
    keep: list[int] = []
    for i in range(len(docs)):
        if not keep or ((sketch[keep] == sketch[i]).sum(1) <= most).all():
            keep.append(i)
    return np.isin(np.arange(len(docs)), keep)


def best_cut(logit: np.ndarray, y: np.ndarray, share: float) -> float | None:
    """The middle of the best cuts by F1, the classes weighted to this share of ones; None without both classes."""
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(-logit, kind="stable")
    z, hit = logit[order], y[order]
    true = np.cumsum(hit) / hit.sum() * share
    false = np.cumsum(1 - hit) / (1 - hit).sum() * (1 - share)
    f1 = 2 * true / (true + false + share)
    f1[:-1][z[:-1] == z[1:]] = -1  # equal values can't be cut apart
    k = int(np.argmax(f1))
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """A model of the learning fold's sample, or None where it lacks a class."""
    sample = F.broadcast(labelled_sample(labels, "toxic", per_class))
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("y", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                words, ids = word_hashes(data, offsets)
                yield table(schema, doc_id=batch.column("doc_id")[first:end], lang=batch.column("lang")[first:end], y=batch.column("y")[first:end], ids=[ids[a:b].tobytes() for a, b in zip(words.range[:-1], words.range[1:], strict=True)])

    drawn = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES).join(sample, "doc_id")
    rows = sorted(drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "y", "text").transform(map_arrow, run, "doc_id long, lang string, y int, ids binary").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["ids"]))
    docs = [np.frombuffer(r["ids"], np.uint64).reshape(-1, PARTS) for r in rows]
    chosen = unlike(docs)
    rows, docs = [r for r, k in zip(rows, chosen, strict=True) if k], [d for d, k in zip(docs, chosen, strict=True) if k]
    y = np.array([r["y"] for r in rows], int)
    if len(np.unique(y)) < 2:
        return None
    kept = np.zeros(len(y), bool)
    for v in (0, 1):
        kept[np.flatnonzero(y == v)[::4]] = True
    if len(np.unique(y[~kept])) < 2:
        kept[:] = False
    learning = [d for d, k in zip(docs, kept, strict=True) if not k]
    model = Model(telling(learning, y[~kept]))
    docs = [model.rows(d) for d in docs]
    model.train([d for d, k in zip(docs, kept, strict=True) if not k], y[~kept])
    use = kept if len(np.unique(y[kept])) == 2 else ~kept
    logit = model.logits(np.concatenate(docs), np.array([len(d) for d in docs]), model.table())
    z, t = logit[use], y[use]
    # toxic texts are rarer than in the sample; a tenth is assumed
    model.shift = best_cut(z, t, 0.1)
    low, high = np.median(z[t == 0]), np.median(z[t == 1])
    model.scale = 8 / max(high - low, 1e-3)
    langs = np.array([r["lang"] or "" for r in rows])
    for lang in np.unique(langs[use]):
        cut = best_cut(logit[use & (langs == lang)], y[use & (langs == lang)], 0.1)
        if lang and cut is not None:
            model.thresholds[str(lang)] = float(model.score(np.array([cut]))[0])
    return model


def detect(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Per document: held_out, score, predicted (score >= 0.7), and ``flagged`` by its language's own threshold."""
    model = fit(documents, labels, per_class)
    shared = documents.sparkSession.sparkContext.broadcast((model, model.table() if model else None))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("lang", pa.string())])

    def run(batches):
        model, responses = shared.value
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                score = np.full(end - first, 0.5)
                if model:
                    words, hashes = word_hashes(data, offsets)
                    score = model.score(model.logits(model.rows(hashes), words.count, responses))
                yield table(schema, doc_id=batch.column("doc_id")[first:end], held_out=batch.column("held_out")[first:end], score=score, predicted=(score >= CUT).astype(np.int32), lang=batch.column("lang")[first:end])

    scan = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold("doc_id", 3, 1).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    out = scan.transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int, lang string")
    known = F.lit(CUT)
    for lang, cut in sorted((model.thresholds if model else {}).items()):
        known = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(known)
    return out.withColumn("threshold", known).withColumn("flagged", F.col("score") >= F.col("threshold")).drop("lang")
