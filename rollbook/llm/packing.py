"""Packing documents into fixed-length token sequences by first-fit decreasing.

Each document is tokenised and ended by one id, and cut into pieces of at most 4096 ids. Pieces are dealt by
a hash of their contents and their place in the table, so copies spread too, into randomised groups of bounded
size; they are stored before they are dealt, so the deal stays as it is. Each group is packed on its own, largest piece
first, into the first sequence with room, which a tournament tree of free capacities finds in
logarithmic time. One document in 32 is cut into short pieces beforehand; being the smallest, they come
last and fill the gaps that the others leave.

Text is tokenised by white-space and punctuation chunks: the tokenizer never joins ids across them, so
each distinct chunk of a block is encoded once.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; equal
lengths are ordered by id and start; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import map_arrow
from .textkernel import blocks, mix, span_keys, table

LENGTH = 4096
END_ID = 2
#: Documents of a group, about.
GROUP = 2048
#: One document in FILLERS is cut into pieces of FILLER ids.
FILLERS, FILLER = 32, 32
_CACHE = 600_000

# letters and digits; punctuation that never starts a contraction; white space; all else
_LETTER, _PUNCT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.int8)
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _CLASS[_a : _b + 1] = _LETTER
for _a, _b in ((33, 47), (58, 64), (91, 96), (123, 126)):
    _CLASS[_a : _b + 1] = _PUNCT
_CLASS[ord("'")] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts; chunks that were seen before come from a bounded memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self):
        self.key, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(e) for e in found], np.int64)

    def _encode_chunks(self, texts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each chunk. A plain chunk, letters alone, is one word, whose last id is an end of a word:
        such chunks are encoded as sentences and cut at those ids."""
        order = np.flatnonzero(plain)
        sentences = [" ".join([texts[i] for i in order[k : k + 256]]) for k in range(0, len(order), 256)]
        ids, _ = self._encode(sentences)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(order):  # not a vocabulary with word ends
            return self._encode(texts)
        rest = np.flatnonzero(~plain)
        more, more_size = self._encode([texts[i] for i in rest])
        size, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[order], begin[order] = np.diff(ends, prepend=0), np.concatenate([[0], ends])[:-1]
        size[rest], begin[rest] = more_size, len(ids) + np.cumsum(more_size) - more_size
        both, total = np.concatenate([ids, more]), np.cumsum(size)
        return both[np.repeat(begin - total + size, size) + np.arange(size.sum())], size

    @staticmethod
    def _latin(data: np.ndarray) -> np.ndarray:
        """Both bytes of the letters of Latin-1."""
        out = np.zeros(len(data), bool)
        out[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        out[:-1] |= out[1:] & (data[:-1] == 0xC3)
        return out

    def _letters(self, data: np.ndarray) -> np.ndarray:
        """Bytes of letters that are surely kept together."""
        return (_CLASS[data] == _LETTER) & (data >= 65) | self._latin(data)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of what the tokenizer surely splits apart.

        White space always splits. Between ASCII punctuation (but the apostrophe) and a letter or digit of ASCII
        or Latin-1 there is always a border. All else stays in one chunk.
        """
        kind = _CLASS[data]
        kind[self._latin(data)] = _LETTER
        inside = kind != _SPACE
        first, last = inside.copy(), inside.copy()
        border = (kind[1:] != kind[:-1]) & (kind[1:] <= _PUNCT) & (kind[:-1] <= _PUNCT)
        first[1:] &= ~inside[:-1] | border
        last[:-1] &= ~inside[1:] | border
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after another, and how many each text has."""
        low = _LOWER[data]
        start, end = self._chunks(data, offsets)
        keys = span_keys(low, start, end)
        unique, one, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, unique), max(0, len(self.key) - 1))
        new = np.flatnonzero(self.key[at] != unique) if len(self.key) else np.arange(len(unique))
        if len(self.key) + len(new) > _CACHE:
            self._forget()
            new = np.arange(len(unique))
        if len(new):
            raw = low.tobytes()
            letters = np.concatenate([[0], np.cumsum(self._letters(data))])
            plain = (letters[end] - letters[start] == end - start)[one[new]]
            ids, size = self._encode_chunks([raw[start[i] : end[i]].decode("utf-8", "replace") for i in one[new]], plain)
            key = np.concatenate([self.key, unique[new]])
            order = np.argsort(key, kind="stable")
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])[order]
            self.size, self.key, self.ids = np.concatenate([self.size, size])[order], key[order], np.concatenate([self.ids, ids])
        at = np.searchsorted(self.key, unique)[back]
        size, begin = self.size[at], self.begin[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edge = np.searchsorted(start, offsets)
        count = total[edge[1:]] - total[edge[:-1]]
        if any(x in (raw := data.tobytes()) for x in self.special):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if any(x in raw[a:b] for x in self.special):
                    parts[i] = self._encode([raw[a:b].decode("utf-8", "replace")])[0]
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_sum(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of each text's ids."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids, dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(count)])
    return total[edge[1:]] - total[edge[:-1]]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, dealt long"


def pieces(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every document: full ones from its start, then the rest."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "dealt")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        at = np.uint64((task.partitionId() if task else 0) << 40)  # the number of the next piece
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                ids, count = encode(data, offsets)
                total = count + 1
                edge = np.concatenate([[0], np.cumsum(total)])
                whole = np.full(edge[-1], END_ID, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                short = (mix(total.astype(np.uint64) + ids_sum(ids, count)) & np.uint64(FILLERS - 1) == 0) & (total <= length)
                step = np.where(short, FILLER, length)
                parts = -(-total // step)
                row = np.repeat(np.arange(len(total)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[row]
                size = np.minimum(step[row], total[row] - start)
                view = memoryview(whole.view(np.uint8))
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[row] + start, edge[row] + start + size, strict=True)]
                place = at + np.arange(len(row)).astype(np.uint64)
                at += np.uint64(len(row))
                dealt = mix(np.array(crc, np.uint64) ^ mix(mix(place) + total[row].astype(np.uint64) + np.uint64(1))) >> np.uint64(2)
                yield table(schema, doc_id=batch.column("doc_id")[first:end].take(pa.array(row)), start=start, length=size, ids_crc32=crc, doc_tokens=total[row], dealt=dealt.astype(np.int64))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_arrow, run, PIECES)


class Tournament:
    """Free capacities of the sequences of a group; the winner of a match is the larger capacity."""

    def __init__(self, slots: int, capacity: int):
        self.leaf = 1 << max(0, (slots - 1).bit_length())
        self.node = [capacity] * (2 * self.leaf)

    def place(self, size: int) -> int:
        """Puts this many ids into the first sequence with room."""
        node, leaf, i = self.node, self.leaf, 1
        while i < leaf:
            i *= 2
            if node[i] < size:
                i += 1
        node[i] -= size
        slot = i - leaf
        while i > 1:
            i //= 2
            best = max(node[2 * i], node[2 * i + 1])
            if node[i] == best:
                break
            node[i] = best
        return slot


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> list[int]:
    """The sequence of each size; sizes come in decreasing order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece: its document, start and length, the crc32 of its ids, and its sequence and offset there."""
    found = cut(pieces(documents, tokenizer or default_tokenizer(), length))
    groups = max(1, -(-documents.count() // group))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        col = {n: rows.column(n).fill_null(-(1 << 62)).to_numpy() for n in ("length", "doc_id", "start", "ids_crc32")}
        order = np.lexsort((col["ids_crc32"], col["start"], col["doc_id"], -col["length"]))
        size = col["length"][order]
        sequence = np.array(first_fit_decreasing(size.tolist(), length), np.int64)
        by = np.argsort(sequence, kind="stable")
        ends = np.cumsum(size[by])
        opened = np.flatnonzero(np.diff(sequence[by], prepend=-1))
        offset = np.empty(len(by), np.int64)
        offset[by] = ends - size[by] - np.repeat((ends - size[by])[opened], np.diff(np.append(opened, len(by))))
        whole = rows.take(pa.array(order))
        base = whole.column("part")[0].as_py() << 32
        return pa.table([*(whole.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence + base), pa.array(offset)], schema=schema)

    return found.withColumn("part", F.pmod(F.col("dealt"), F.lit(groups))).groupBy("part").applyInArrow(run, OUT)
