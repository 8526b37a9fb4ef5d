"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words. Every run of ten consecutive words of a benchmark item (all words
of a shorter item) is a pattern; the automaton holds all patterns, its letters being the benchmark's words, and
each document is scanned once, word by word. Words outside the benchmark are one letter of no pattern. Match ends
are words, whose byte offsets in the original text are known.

An automaton is held by every Python worker, so its size is bounded. A benchmark of more bytes is dealt into
several automata by a hash of the items; the documents are scanned by one after another, what was found so far
being stored with them in between.

Defined cases: a null or empty text has no words and no hits; an item without words has no pattern; a
null item_id still marks words but is no item; repeated items count once for each distinct id; extra
columns of either table are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import cut, forget
from .frames import fresh, map_arrow
from .textkernel import Words, blocks

WINDOW = 10
#: Bytes of benchmark texts for one automaton, about: some 150 bytes of memory for each.
AUTOMATON_BYTES = 2 << 20

_RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_FOUND = StructType([StructField("n_words", LongType()), StructField("runs", _RUNS), StructField("spans", _RUNS), StructField("items", ArrayType(StringType()))])
_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", _PAIRS), ("spans", _PAIRS), ("items", pa.list_(pa.string()))])

#: The letter of words that no pattern has.
_OTHER = 1


def letters(numbers: np.ndarray) -> np.ndarray:
    """Word numbers as code points that are letters of their own: from 2 on, without surrogates."""
    return np.where(numbers < 0xD7FE, numbers + 2, numbers + 0x802)


def as_string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


class Machine:
    """The automaton of some items (item_id, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        raw = [text.encode() for _, text in items]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.known, numbers = np.unique(words.hash, return_inverse=True)
        if len(self.known) > 1_000_000:
            raise ValueError("an automaton has a million different words at most")
        text = as_string(letters(numbers))
        patterns: dict[str, set[str]] = {}
        for (item_id, _), a, b in zip(items, words.range[:-1].tolist(), words.range[1:].tolist(), strict=True):
            for k in range(a, max(a + 1, b - window + 1) if b > a else a):
                owners = patterns.setdefault(text[k : min(b, k + window)], set())
                if item_id is not None:
                    owners.add(item_id)
        self.shortest = min(map(len, patterns), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for pattern, owners in patterns.items():
            self.machine.add_word(pattern, (len(pattern), frozenset(owners)))
        if patterns:
            self.machine.make_automaton()

    def scan(self, words: Words) -> dict[int, tuple[np.ndarray, set[str]]]:
        """Of the rows with a match: which of their words lie in one, and the items that match."""
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        if not self.shortest or not len(words.hash):
            return out
        at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        hit = self.known[at] == words.hash
        # a match lies in a run of known words of one row: long enough runs are put into one string, a stranger behind each
        row = words.rows()
        inside = np.concatenate([[False], hit, [False]])
        border = np.concatenate([[True], (row[1:] != row[:-1]), [True]])
        first, last = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1])), np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
        some = last - first >= self.shortest
        first, size = first[some], (last - first)[some]
        begin = np.cumsum(size + 1) - size - 1
        owner = np.repeat(first - begin, size + 1) + np.arange(int((size + 1).sum()))
        codes = letters(at[np.minimum(owner, len(at) - 1)])
        codes[begin + size] = _OTHER
        for place, (n, owners) in self.machine.iter(as_string(codes)):
            word = int(owner[place])
            i = int(row[word])
            if i not in out:
                out[i] = np.zeros(int(words.count[i]), bool), set()
            end = word + 1 - int(words.range[i])
            out[i][0][end - n : end] = True
            out[i][1].update(owners)
        return out


_built: dict[bytes, Machine] = {}


def _machine(items, window: int) -> Machine:
    """Built once in each worker process; the latest one is kept."""
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Machine(items, window)
    return _built[key]


def dealt_items(benchmark: DataFrame):
    """The distinct items with a text, one part after another, each of about AUTOMATON_BYTES."""
    used = benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text").where("text is not null").distinct()
    size = used.selectExpr("coalesce(sum(octet_length(text)), 0) n").first().n
    parts = max(1, -(-size // AUTOMATON_BYTES))
    for k in range(parts):
        part = used if parts == 1 else used.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield k == parts - 1, sorted([(r.item_id, r.text) for r in part.collect()], key=str)


def marked(documents: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW) -> DataFrame:
    """``documents`` with a last column ``name``: n_words, runs of words inside windows (word numbers), their spans
    (byte offsets of the text) and the sorted items that occur."""
    schema, held = StructType([*documents.schema.fields, StructField(name, _FOUND)]), None
    for last, items in dealt_items(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared, again=held is not None):
            machine = _machine(shared.value, window)
            for batch in batches:
                before = batch.column(name).to_pylist() if again else None
                out, clean = [], {"runs": [], "spans": [], "items": []}
                for first, end, data, offsets in blocks(batch.column("text")):
                    words = Words(data, offsets)
                    found, rows = machine.scan(words), [{"n_words": n} | clean for n in words.count.tolist()]
                    for i in {*found, *(k for k in range(end - first) if before and before[first + k]["runs"])}:
                        hit, items = found.get(i) or (np.zeros(int(words.count[i]), bool), set())
                        for r in before[first + i]["runs"] if before else ():
                            hit[r["start"] : r["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).tolist()
                        runs, a, at = list(zip(edge[::2], edge[1::2], strict=True)), words.range[i], offsets[i]
                        spans = [{"start": int(words.start[a + s] - at), "end": int(words.end[a + e - 1] - at)} for s, e in runs]
                        rows[i] |= {"runs": [{"start": s, "end": e} for s, e in runs], "spans": spans, "items": sorted(items.union(before[first + i]["items"] if before else ()))}
                    out += rows
                columns = batch.columns[:-1] if again else batch.columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _ARROW)], names=[f.name for f in schema])

        done = (documents if held is None else held).transform(map_arrow, run, schema)
        if last:
            return done
        before, held = held, cut(done)
        if before is not None:
            forget(before)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside benchmark windows, items that occur, and hit spans as byte offsets of the text."""
    found = marked(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), benchmark, "found", window)
    n_hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.runs") > 0).alias("contaminated"), F.col("found.items").alias("items"), F.col("found.spans").alias("spans"),
    )


def mark(documents: DataFrame, benchmark: DataFrame, name: str = "n_hit", window: int = WINDOW) -> DataFrame:
    """``documents`` with a last column ``name``: the words inside benchmark windows."""
    found = fresh("found", documents)
    n_hit = F.aggregate(F.col(found)["runs"], F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return marked(documents, benchmark, found, window).withColumn(found, n_hit).withColumnRenamed(found, name)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
runs AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item, k, n FROM runs JOIN p USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS s, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
