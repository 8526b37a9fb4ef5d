"""Language identification by segmentation-marginalised unigrams.

Every language is a distribution over the pieces of a fixed public vocabulary (never trained here).
The probability of a word is the sum over all its segmentations into pieces, computed by a forward
recursion; piece probabilities are learned by expectation maximisation with the matching backward
recursion. A text's likelihood is the product over its words, each word counted as often as it occurs.
Words repeat, so the recursion runs once for each distinct word of a block.

Words are runs of letters (any byte that is not ASCII counts as a letter), lower-cased over ASCII and
Latin-1, with a mark for the word's beginning as in the vocabulary. Segmentations don't cross word
borders; all of the text is scored. A longer run (scripts without spaces) is first cut at the bytes that
no piece of the vocabulary crosses there, which changes no sum; what is long even then is summed by a
rolling recursion that is rescaled as it goes.

Defined cases: ``und`` with score 0.0 for a null or empty text, or one without a letter; equal scores
go to the language that sorts first; rows with a null ``lang`` teach nothing; without any labelled row
every text is ``und``; repeated rows and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .frames import fold, fresh, map_arrow
from .textkernel import FOLD_LETTERS, Words, blocks, hash_bytes, prefix_hashes, span_hashes

#: Documents sampled for each language to learn its pieces: a hash of the id keeps about this many, of so many bytes at most.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 1500, 1 << 18
#: Languages learned: the most frequent ones. Columns of free text would bring any number.
LANGUAGES = 200
#: Longest parts that are summed together with others of their length; longer ones go one by one, and teach nothing.
SPAN = 64
#: Probabilities are scaled by this to the power of a piece's length: within SPAN bytes no sum leaves the range of a double.
SCALE = 1e4
ROUNDS = 4
_MARK = 0x20
_CACHE = 200_000


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece vocabulary as bytes, the begin mark as a space; all single bytes included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
            if piece.find(b" ", 1) < 0:
                pieces.add(piece)
    return sorted(pieces)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lookup:
    """Piece hashes to piece numbers by a two-way table; the number of pieces stands for none."""

    BITS = 20

    def __init__(self, pieces: list[bytes]):
        self.none, self.lengths = len(pieces), sorted({*map(len, pieces)})
        self.longest = self.lengths[-1]
        keys = hash_bytes(pieces)
        self.key = np.zeros(2 << self.BITS, np.uint64)
        self.id = np.full(2 << self.BITS, self.none, np.int32)
        rest = np.arange(len(pieces))
        for side, slot in enumerate(self._slots(keys)):
            _, first = np.unique(slot[rest], return_index=True)
            at = slot[rest[first]]
            self.key[at], self.id[at] = keys[rest[first]], rest[first]
            rest = np.delete(rest, first)
            assert side == 0 or not len(rest), "the vocabulary doesn't fit the table"

    def _slots(self, keys):
        return (keys >> np.uint64(64 - self.BITS)).astype(np.int64), ((keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)) + (1 << self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        one, two = self._slots(keys)
        return np.where(self.key[one] == keys, self.id[one], np.where(self.key[two] == keys, self.id[two], self.none))


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a block and its folded bytes."""
    low = data.copy()
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    words = Words(low, offsets, FOLD_LETTERS)
    return words, words.folded


class Parts:
    """Words as parts that no piece crosses: ``word``, ``first`` and ``size`` of each, over the marked bytes of all words."""

    def __init__(self, folded: np.ndarray, start: np.ndarray, end: np.ndarray, lookup: Lookup):
        length, inner = end - start + 1, end - start
        marked = np.full(int(length.sum()), _MARK, np.uint8)
        self.first, self.size, self.word, self.lookup = np.cumsum(length) - length, length, np.arange(len(start)), lookup
        where = np.arange(int(inner.sum()))
        marked[where + np.repeat(np.arange(len(start)) + 1, inner)] = folded[where + np.repeat(start - (np.cumsum(inner) - inner), inner)]
        self.sums = prefix_hashes(marked)
        if (long := np.flatnonzero(length > SPAN)).size:
            self._cut(long)

    def _cut(self, long: np.ndarray) -> None:
        """Cuts these words wherever no piece of two or more bytes has both sides of a border."""
        length, begin = self.size[long], self.first[long]
        at = np.arange(int(length.sum()))
        place = at + np.repeat(begin - (np.cumsum(length) - length), length)
        left = np.repeat(begin + length, length) - place
        cross = np.zeros(len(at) + self.lookup.longest + 1, np.int64)
        for k in self.lookup.lengths:
            if k > 1:
                here = np.flatnonzero(left >= k)
                here = here[self.lookup(span_hashes(self.sums, place[here], place[here] + k)) != self.lookup.none]
                np.add.at(cross, here + 1, 1)
                np.add.at(cross, here + k, -1)
        edges = np.flatnonzero((np.cumsum(cross[: len(at)]) == 0) | (place == np.repeat(begin, length)))
        size = np.diff(np.append(edges, len(at)))
        keep = np.delete(np.arange(len(self.word)), long)
        self.word = np.concatenate([self.word[keep], np.repeat(long, length)[edges]])
        self.first, self.size = np.concatenate([self.first[keep], place[edges]]), np.concatenate([self.size[keep], size])

    def ids(self, first: np.ndarray, n: int) -> np.ndarray:
        """ids[part, end, length - 1] of the piece that ends there, for parts of one size."""
        width = min(n, self.lookup.longest)
        out = np.full((len(first), n + 1, width), self.lookup.none, np.int32)
        for e in range(1, n + 1):
            for k in self.lookup.lengths:
                if k <= e:
                    out[:, e, k - 1] = self.lookup(span_hashes(self.sums, first + e - k, first + e))
        return out

    def together(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words and ids of the parts within SPAN, of one size after another."""
        for n in np.unique(self.size[self.size <= SPAN]):
            chosen = np.flatnonzero(self.size == n)
            for some in np.array_split(chosen, max(1, len(chosen) * int(n) // 60_000)):
                yield self.word[some], self.ids(self.first[some], int(n))

    def alone(self) -> Iterator[tuple[int, int, int]]:
        """Word, first byte and size of each longer part."""
        yield from ((int(self.word[i]), int(self.first[i]), int(self.size[i])) for i in np.flatnonzero(self.size > SPAN))

    def log_alone(self, first: int, size: int, probability: np.ndarray) -> np.ndarray:
        """The log of the summed probability of a long part, for each language; the last ``longest`` sums are kept, scaled by the latest."""
        width = self.lookup.longest
        last, log = np.zeros((width, probability.shape[1])), np.zeros(probability.shape[1])
        last[-1] = 1
        for slice_ in range(0, size, 4096):
            end = np.arange(slice_ + 1, min(size, slice_ + 4096) + 1)
            ids = np.full((len(end), width), self.lookup.none, np.int32)
            for k in self.lookup.lengths:
                fits = np.flatnonzero(end >= k)
                ids[fits, width - k] = self.lookup(span_hashes(self.sums, first + end[fits] - k, first + end[fits]))
            for row in ids:  # the piece of length k begins after the k-th last sum
                new = (last * probability[row]).sum(0)
                last[:-1] = last[1:]
                last[-1] = new
                if new.max() < 1e-30 or new.min() < 1e-90:
                    log += np.log(new)
                    last /= new
        return log + np.log(last[-1])


def scaled(probability: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Probabilities of pieces times SCALE to the power of their length; the last row, of no piece, stays zero."""
    return probability * np.append(SCALE ** np.array([len(x) for x in pieces], float), 0)[:, None]


def forward(ids: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """alpha[part, end, language]: the summed probability of all segmentations of the first bytes."""
    m, n1, width = ids.shape
    alpha = np.zeros((m, n1, probability.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, n1):
        for k in range(1, min(e, width) + 1):
            known = ids[:, e, k - 1]
            if (some := np.flatnonzero(known != len(probability) - 1)).size == m:
                alpha[:, e] += alpha[:, e - k] * probability[known]
            elif some.size:
                alpha[some, e] += alpha[some, e - k] * probability[known[some]]
    return alpha


def expected_counts(ids: np.ndarray, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece of one language, by forward and backward sums; probability: (pieces + 1, 1)."""
    alpha = forward(ids, probability)[:, :, 0]
    m, n1, width = ids.shape
    p, beta = probability[:, 0], np.zeros((m, n1))
    beta[:, -1] = 1
    out = np.zeros(len(p))
    scale = weight / np.maximum(alpha[:, -1], 1e-300)
    for e in range(n1 - 1, 0, -1):
        for k in range(1, min(e, width) + 1):
            flow = p[ids[:, e, k - 1]] * beta[:, e]
            beta[:, e - k] += flow
            out += np.bincount(ids[:, e, k - 1], alpha[:, e - k] * flow * scale, len(p))
    return out


def learn(counts: dict[str, dict[bytes, int]], pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages and probabilities (pieces + 1, languages), the last row zero."""
    lookup, languages = Lookup(pieces), sorted(counts)
    out = np.zeros((len(pieces) + 1, len(languages)))
    for j, language in enumerate(languages):
        words = list(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        at = np.cumsum([0, *map(len, words)])
        parts = list(Parts(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:], lookup).together()) if words else []
        p = np.append(np.array([0.25 ** len(x) for x in pieces]) + 1e-6, 0)[:, None]
        for _ in range(ROUNDS):
            p /= p.sum()
            used = sum(expected_counts(ids, scaled(p, pieces), weight[word]) for word, ids in parts) if parts else np.zeros(len(p))
            p = (used + 0.02)[:, None]
            p[-1] = 0
        out[:, j] = (p / p.sum())[:, 0]
    return languages, out


def word_counts(documents: DataFrame) -> dict[str, dict[bytes, int]]:
    """Words of the sampled learning rows by language. The sample is bounded, so the counts may go to the driver."""
    usable = documents.select("lang", F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold("doc_id", 5, 0))
    usable = usable.where(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_PER_LANGUAGE / v)))])
    drawn = usable.where(F.col("lang").isin([*sizes])).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                words, folded = letter_words(data, offsets)
                raw, rows = folded.tobytes(), words.rows()
                names = batch.column("lang")[first:end].dictionary_encode()
                lang = names.indices.to_numpy(zero_copy_only=False)[rows]
                key = np.stack([words.hash.view(np.int64), lang.astype(np.int64)], 1)
                _, one, n = np.unique(key, axis=0, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang[one])), pa.array([raw[words.start[i] : words.end[i]] for i in one], pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, dict[bytes, int]] = {k: {} for k in sizes}
    for r in drawn.select("lang", "text").transform(map_arrow, run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts[r["lang"]][r["word"]] = r["n"]
    return counts


class Scorer:
    """Log probabilities of words, remembered between blocks within a bound."""

    def __init__(self, pieces: list[bytes], probability: np.ndarray):
        self.lookup, self.probability, self.scaled = Lookup(pieces), probability, scaled(probability, pieces)
        self.key, self.value = np.zeros(0, np.uint64), np.zeros((0, probability.shape[1]))

    def __call__(self, words: Words, folded: np.ndarray) -> np.ndarray:
        """Log likelihood (rows, languages) of the texts of a block."""
        keys, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, keys), max(0, len(self.key) - 1))
        new = np.flatnonzero(self.key[at] != keys) if len(self.key) else np.arange(len(keys))
        value = np.zeros((len(keys), self.probability.shape[1]))
        if len(self.key):
            value[:] = self.value[at]
        value[new] = 0
        fresh = np.zeros((len(new), value.shape[1]))
        if len(new):
            parts = Parts(folded, words.start[one[new]], words.end[one[new]], self.lookup)
            for word, ids in parts.together():
                np.add.at(fresh, word, np.log(forward(ids, self.scaled)[:, -1]) - (ids.shape[1] - 1) * np.log(SCALE))
            for word, first, size in parts.alone():
                fresh[word] += parts.log_alone(first, size, self.probability)
        value[new] = fresh
        if len(self.key) + len(new) > _CACHE:
            self.key, self.value = keys[:_CACHE], value[:_CACHE]
        elif len(new):
            merged = np.concatenate([self.key, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.key, self.value = merged[order], np.concatenate([self.value, fresh])[order]
        out = np.zeros((len(words.count), value.shape[1]))
        rows = words.rows()
        for j in range(value.shape[1]):
            out[:, j] = np.bincount(rows, value[back, j], len(words.count))
        return out


class Model:
    """Pieces, languages and piece probabilities, learned from the labelled rows outside the held-out fold."""

    def __init__(self, pieces: list[bytes], languages: list[str], probability: np.ndarray):
        self.pieces, self.languages, self.probability = pieces, languages, probability

    @classmethod
    def fit(cls, documents: DataFrame, vocabulary_path: str | None = None) -> Model:
        pieces = vocabulary(vocabulary_path or default_vocabulary())
        languages, probability = learn(word_counts(documents), pieces)
        return cls(pieces, languages, probability.astype(np.float32))

    def scorer(self) -> Scorer | None:
        return Scorer(self.pieces, self.probability.astype(float)) if self.languages else None


def mark(documents: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``documents`` with a last column ``name``: a struct of lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind, has_letters = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]), fresh("letters", documents)

    def run(batches):
        model = shared.value
        scorer, names = model.scorer(), np.array([*model.languages, "und"], object)
        for batch in batches:
            found = []
            for first, end, data, offsets in blocks(batch.column("text")):
                letters = batch.column(has_letters)[first:end].to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.zeros(end - first, int), np.zeros(end - first)
                if scorer:
                    loglik = scorer(*letter_words(data, offsets))
                    best = loglik.argmax(1)
                    score = 1 / np.exp(loglik - loglik.max(1, keepdims=True)).sum(1)
                letters &= scorer is not None
                found.append(pa.StructArray.from_arrays([pa.array(names[np.where(letters, best, len(model.languages))], pa.string()), pa.array(np.where(letters, score, 0.0))], fields=list(kind)))
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != has_letters]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(found) if found else pa.array([], kind)], names=[*(n for n in batch.schema.names if n != has_letters), name])

    out = StructType([*documents.schema.fields, StructField(name, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))])
    return documents.withColumn(has_letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).transform(map_arrow, run, out)


def identify(documents: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Per document: held_out, lang_pred and score, the posterior of the predicted language under equal priors."""
    model = Model.fit(documents, vocabulary_path)
    scan = documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return mark(scan, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
