"""Removal of long repeated byte strings by suffix arrays.

Every byte that lies in a 200-byte string which also starts elsewhere is removed. Winnowing first picks
anchors: in each 200-byte string the least hash of its 32-byte grams, so both copies of a repeated string
hold the same anchor at the same place. Anchors that occur once rule their surroundings out. For the
others, the strings whose anchor it is are compared; they overlap, and what they cover is its context. Equal
contexts repeat in full; one copy of each distinct context goes to a shard. A shard's contexts are joined into one string whose suffix array is built by Larsson-Sadakane
refinement; Kasai's common prefixes of neighbours give the classes of equal 200-byte strings. An anchor
with more contexts than a shard should hold is spread over several shards, which exchange their sorted
classes by digest range and find each other's by binary search.

Defined cases: null counts as empty; texts shorter than the string length lose nothing; equal texts of at
least that length lose everything; repeated rows count as equal texts; extra columns are ignored; an empty
table gives no rows. Texts are known by 128-bit digests; contexts by 64 bits of a digest under their anchor's 64;
the strings that shards of one anchor exchange by 64 bits. Anchors may share a hash: their contexts are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget
from .frames import map_arrow, unskewed
from .textkernel import blocks, digests, mix, prefix_hashes, span_hashes, span_keys, table

LENGTH, GRAM = 200, 32
#: A context's bytes left of its anchor and its length in one number: left * WIDE + length.
WIDE = 512
#: Contexts of a shard, about; an anchor with more of them is spread.
SHARD, HOT = 1536, 4096
#: Strings of one digest range in the exchange between shards, about.
RANGE = 1 << 21
_SLICE = 1 << 21
_U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions in the block, and first and last strings (their starts) of all anchors of a block."""
    found = []
    window, mask = LENGTH - GRAM + 1, _U((1 << 22) - 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for first in range(0, max(0, len(data) - LENGTH + 1), _SLICE):
        last = min(len(data) - LENGTH + 1, first + _SLICE)  # starts of strings
        at = np.arange(first, last + window - 1)
        low = (span_hashes(sums, at, at + GRAM) & ~mask) | np.arange(len(at)).astype(np.uint64)
        width = 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: last - first], low[window - width :][: last - first])
        start = np.flatnonzero(np.arange(first, last) + LENGTH <= ends[first:last])
        place = (low[start] & mask).astype(np.int64) + first
        new = np.flatnonzero(np.diff(place, prepend=-1))
        found.append(np.stack([place[new], start[new] + first, start[np.append(new[1:], len(place)) - 1] + first]) if len(place) else np.zeros((3, 0), np.int64))
    place, low, high = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    return np.searchsorted(offsets, place, "right") - 1, place, low, high


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte string in order.

    Larsson-Sadakane: suffixes are grouped by their first 7 bytes; each round sorts the members of groups
    that are still mixed by the groups of the suffixes as many and twice as many bytes further on, which
    triples the depth (in a string too long for three ranks in a key, it doubles it).
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    if n >= 1 << 31:
        raise ValueError("a shard holds two billion bytes at most")
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key |= padded[k : k + n].astype(np.uint64) << _U(8 * (7 - k))
    key |= np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)  # of equal padded keys the shorter suffix is first
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int32)  # a group's rank is the place of its first member
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at, depth = np.flatnonzero(~(new & np.append(new[1:], True))), 7
    times = 3 if n < (1 << 20) - 1 else 2  # how many ranks fit into one key
    bits = 20 if times == 3 else 31
    while len(at):
        some = order[at]
        joint = rank[some].astype(np.int64)
        for k in range(1, times):
            joint = (joint << bits) | (rank[np.minimum(some + k * depth, n)] + 1)
        by = np.argsort(joint)
        some = order[at] = some[by]
        joint = joint[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = joint[1:] != joint[:-1]
        rank[some] = np.maximum.accumulate(np.where(fresh, at, 0))
        at, depth = at[~(fresh & np.append(fresh[1:], True))], times * depth
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the common prefix with the suffix before it (0 at the first).

    Kasai: in text order the prefix of a suffix is one shorter than that of the suffix before it in the text
    if both neighbours are preceded by equal bytes; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    plain = (at > 0) & (before > 0)
    plain[plain] = text[at[plain] - 1] == text[before[plain] - 1]
    plain &= before >= 0
    alone = np.flatnonzero(~plain & (before >= 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word[:n] = (word[:n] << _U(8)) | padded[k : k + n]
    common = np.zeros(n, np.int64)
    go = alone
    while len(go):
        a, b = go + common[go], before[go] + common[go]
        room = n - np.maximum(a, b)
        differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = np.full(len(go), 8)
        some = differ != 0
        same[some] = 7 - (np.frexp(differ[some].astype(float))[1] - 1) // 8
        # the conversion to float may round up to the next power
        wrong = some & (same >= 0) & ((differ >> ((7 - np.minimum(same, 7)).astype(np.uint64) * _U(8))) == 0)
        same[wrong] += 1
        same = np.minimum(same, np.maximum(room, 0))
        common[go] += same
        go = go[same == 8]
    source = np.maximum.accumulate(np.where(plain, -1, at))
    common = np.where(plain, np.maximum(0, common[np.maximum(source, 0)] - (at - source)), common)
    return common[order]


class Shard:
    """The classes of equal strings of a shard's contexts."""

    def __init__(self, contexts: pa.ChunkedArray | pa.Array, tk: np.ndarray, start: np.ndarray, many: np.ndarray):
        parts = [(d, o) for _, _, d, o in blocks(contexts)]
        size = np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for _, o in parts)])
        data = np.concatenate([np.zeros(0, np.uint8), *(d for d, _ in parts)])
        # each context is followed by its number, so that no two suffixes are equal for longer than a context
        self.begin = np.cumsum(size + 8) - size - 8
        text = np.zeros(int((size + 8).sum()), np.uint8)
        text[np.arange(len(data)) + 8 * np.repeat(np.arange(len(size)), size)] = data
        for k in range(8):
            text[self.begin + size + k] = ((np.arange(len(size)) + 1) >> (8 * (7 - k))) & 255
        self.text, self.windows = text, np.maximum(0, size - LENGTH + 1)
        self.tk, self.start, self.many = tk, start, many
        self.owner = np.repeat(np.arange(len(size)), self.windows)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.physical = mix(tk[self.owner].view(np.uint64) ^ mix((start[self.owner] + self.offset).astype(np.uint64) + _U(1)))

    def classes(self) -> np.ndarray:
        """The class of each window; windows are equal if their classes are."""
        order = suffix_array(self.text)
        new = common_prefixes(self.text, order) < LENGTH
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new)
        return number[self.begin[self.owner] + self.offset]

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose string starts at two places or in a context that itself repeats; a window of each class; which classes do."""
        cls = self.classes()
        _, one, back = np.unique(cls, return_index=True, return_inverse=True)
        low, high, many = np.full(len(one), ~_U(0)), np.zeros(len(one), np.uint64), np.zeros(len(one), bool)
        np.minimum.at(low, back, self.physical)
        np.maximum.at(high, back, self.physical)
        np.logical_or.at(many, back, self.many[self.owner])
        good = (low < high) | many
        return good[back], one, good

    def digests(self) -> np.ndarray:
        at = self.begin[self.owner] + self.offset
        return span_keys(self.text, at, at + LENGTH)

    def marks(self, window: np.ndarray) -> list[list[dict]]:
        """Runs of covered bytes of each context, from its windows."""
        out: list[list[dict]] = [[] for _ in self.windows]
        at = np.flatnonzero(window)
        if len(at):
            cut_here = np.flatnonzero((np.diff(at) != 1) | (np.diff(self.owner[at]) != 0)) + 1
            for a, b in zip(at[np.concatenate([[0], cut_here])], at[np.concatenate([cut_here - 1, [len(at) - 1]])], strict=True):
                out[self.owner[a]].append({"lo": int(self.offset[a]), "hi": int(self.offset[b]) + LENGTH})
        return out


def _shard(rows: pa.Table) -> Shard:
    tk = np.frombuffer(b"".join(rows.column("tk").to_pylist()), np.int64)[::2]  # half of it tells places apart
    return Shard(rows.column("bytes"), tk, rows.column("start").to_numpy(), rows.column("many").to_numpy().astype(bool))


_FOUND = pa.struct([("anchor", pa.int64()), ("ctx", pa.int64()), ("pos", pa.int32()), ("ext", pa.int32())])


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, tk, n_bytes, sha, found): the anchors only where a task meets a text for the first time."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("found", pa.list_(_FOUND))])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                sums, tk = prefix_hashes(data), digests(data, offsets)
                fresh = np.zeros(len(tk), bool)
                for i, t in enumerate(tk):
                    if t not in seen:
                        seen.add(t)
                        fresh[i] = True
                row, place, low, high = anchors(data, offsets, sums)
                own = fresh[row]
                row, place, low, high = row[own], place[own], low[own], high[own] + LENGTH
                raw, gram = memoryview(np.ascontiguousarray(data)), span_hashes(sums, place, place + GRAM)
                ctx = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True))
                ctx = np.frombuffer(ctx, np.uint64) ^ mix((place - low).astype(np.uint64) + _U(1))
                edge = np.searchsorted(row, np.arange(len(tk) + 1)).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((place - offsets[row]).astype(np.int32)), pa.array(((place - low) * WIDE + high - low).astype(np.int32))], fields=list(_FOUND))
                yield table(schema, doc_id=batch.column("doc_id")[first:end], tk=tk, n_bytes=np.diff(offsets), sha=[hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], found=pa.ListArray.from_arrays(pa.array(edge), inner))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).transform(map_arrow, run, "doc_id long, tk binary, n_bytes long, sha string, found array<struct<anchor:long,ctx:long,pos:int,ext:int>>")


def texts_once(documents: DataFrame) -> DataFrame:
    """(tk, text): each text once for each task."""
    schema = pa.schema([("tk", pa.binary()), ("text", pa.string())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                tk, fresh = digests(data, offsets), []
                for i, t in enumerate(tk):
                    if t not in seen:
                        seen.add(t)
                        fresh.append(i)
                if fresh:
                    yield table(schema, tk=[tk[i] for i in fresh], text=batch.column("text")[first:end].take(pa.array(fresh)))

    return documents.select(F.col("text").cast("string").alias("text")).where("text is not null").transform(map_arrow, run, "tk binary, text string")


def context_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, ctx, tk, start, many, n, bytes) of the wanted contexts (anchor, ctx, tk, at, len, many, n)."""
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("tk", pa.binary()), ("start", pa.int64()), ("many", pa.bool_()), ("n", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows = []
                for tk, text, wanted in zip(part.column("tk").to_pylist(), part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    raw = text.encode()
                    for w in wanted:
                        rows.append((w["anchor"], w["ctx"], tk, w["at"], w["many"], w["n"], raw[w["at"] : w["at"] + w["len"]]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    by_text = wanted.groupBy("tk").agg(F.collect_list(F.struct("anchor", "ctx", "at", "len", "many", "n")).alias("wanted"))
    return texts.join(by_text, "tk").select("tk", "text", "wanted").transform(map_arrow, run, "anchor long, ctx long, tk binary, start long, many boolean, n long, bytes binary")


_MARKS = "anchor long, ctx long, marks array<struct<lo:long,hi:long>>"
_MARKS_ARROW = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("marks", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])


def _marked(rows: pa.Table, marks: list[list[dict]]) -> pa.Table:
    return pa.table([rows.column("anchor"), rows.column("ctx"), pa.array(marks, _MARKS_ARROW.field("marks").type)], schema=_MARKS_ARROW)


def shard_marks(contexts: DataFrame, n_shards: int) -> DataFrame:
    """Covered runs of each context, from its own shard alone."""

    def run(rows: pa.Table) -> pa.Table:
        shard = _shard(rows)
        return _marked(rows, shard.marks(shard.repeated()[0]))

    return contexts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards))).groupBy("shard").applyInArrow(run, _MARKS)


def spread_marks(contexts: DataFrame, n_shards: int) -> DataFrame:
    """Covered runs of contexts whose anchor is spread over shards, by an exchange of sorted classes."""
    ranges = 1 << max(6, (n_shards * SHARD * (LENGTH - GRAM) // RANGE).bit_length())
    sharded = cut(contexts.withColumn("shard", F.pmod(F.xxhash64("anchor", F.pmod(F.col("ctx"), F.ceil(F.col("n") / SHARD))), F.lit(n_shards))))
    sent = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("digests", pa.binary()), ("places", pa.binary())])

    def send(rows: pa.Table) -> pa.Table:
        shard, k = _shard(rows), rows.column("shard")[0].as_py()
        _, one, good = shard.repeated()
        digest, place = shard.digests()[one], np.where(good, _U(0), shard.physical[one])  # place 0: repeats already
        by = np.argsort(digest)
        digest, place = digest[by], place[by]
        edge = np.searchsorted(digest, np.arange(1, ranges).astype(np.uint64) << _U(64 - ranges.bit_length() + 1))
        return pa.table([pa.array(range(ranges), pa.int64()), pa.array([k] * ranges, pa.int64()), pa.array([x.tobytes() for x in np.split(digest, edge)], pa.binary()), pa.array([x.tobytes() for x in np.split(place, edge)], pa.binary())], schema=sent)

    back = pa.schema([("shard", pa.int64()), ("good", pa.binary())])

    def merge(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in rows.column("digests").to_pylist()]
        digest = np.concatenate(lists)
        place = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("places").to_pylist()])
        known, at = np.unique(digest, return_inverse=True)
        low, high = np.full(len(known), ~_U(0)), np.zeros(len(known), np.uint64)
        np.minimum.at(low, at, place)
        np.maximum.at(high, at, place)
        good = known[(low < high) | (low == 0)]

        def mine(own: np.ndarray) -> bytes:
            found = np.searchsorted(good, own)
            return own[good[np.minimum(found, len(good) - 1)] == own].tobytes() if len(good) else b""

        return pa.table([rows.column("shard"), pa.array([mine(x) for x in lists], pa.binary())], schema=back)

    def mark(rows: pa.Table, good: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _MARKS_ARROW.empty_table()
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in good.column("good").to_pylist())]))
        shard = _shard(rows)
        own = shard.digests()
        hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
        return _marked(rows, shard.marks(hit))

    merged = sharded.groupBy("shard").applyInArrow(send, "range long, shard long, digests binary, places binary").groupBy("range").applyInArrow(merge, "shard long, good binary")
    return sharded.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(mark, _MARKS)


def removal(texts: DataFrame, intervals: DataFrame) -> DataFrame:
    """(tk, n_removed, n_spans, kept_sha256, spans) of texts with covered runs (tk, lo, hi)."""
    schema = pa.schema([("tk", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                out = []
                for tk, text, lo, hi in zip(part.column("tk").to_pylist(), part.column("text").to_pylist(), part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, np.minimum(lo, len(raw)), 1)
                    np.add.at(edge, np.minimum(hi, len(raw)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    out.append((tk, int(gone.sum()), len(turn) // 2, hashlib.sha256(raw[~gone].tobytes()).hexdigest(), [{"lo": int(a), "hi": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    by_text = intervals.groupBy("tk").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return texts.join(by_text, "tk").select("tk", "text", "lo", "hi").transform(map_arrow, run, "tk binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans: the removed runs as byte offsets."""
    rows = cut(scan(documents))
    every = rows.select("tk", F.explode("found").alias("x")).select("tk", "x.anchor", "x.ctx", "x.pos", "x.ext").withColumn("occ", F.xxhash64("tk", "pos"))
    again = every.groupBy("anchor").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi")).where("lo < hi").select("anchor")
    left, size = F.floor(F.col("ext") / WIDE), F.col("ext") % WIDE
    found = cut(unskewed(every, again, ["anchor"]).select("anchor", "ctx", "tk", (F.col("pos") - left).alias("at"), size.alias("len"), "occ"))
    kinds = cut(found.groupBy("anchor", "ctx").agg(F.min(F.struct("tk", "at", "len")).alias("r"), (F.min("occ") < F.max("occ")).alias("many")).select("anchor", "ctx", "r.*", "many"))
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = cut(unskewed(kinds, sizes, ["anchor"]).select("anchor", "ctx", "tk", "at", "len", "many", "n"))
    texts = cut(texts_once(documents).join(found.select("tk").distinct(), "tk").groupBy("tk").agg(F.first("text").alias("text")))
    n = {r.hot: r["count"] for r in wanted.groupBy((F.col("n") > HOT).alias("hot")).count().collect()}
    shards = lambda m: max(64, -(-m // SHARD))
    marks = shard_marks(context_bytes(texts, wanted.where(F.col("n") <= HOT)), shards(n.get(False, 0)))
    if n.get(True):
        marks = marks.unionByName(spread_marks(context_bytes(texts, wanted.where(F.col("n") > HOT)), shards(n[True])))
    whole = kinds.where("many").select("anchor", "ctx", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("len").cast("long").alias("hi"))).alias("marks"))
    marked = cut(marks.where(F.size("marks") > 0).unionByName(whole))
    forget(kinds, wanted)
    intervals = unskewed(found, marked, ["anchor", "ctx"]).select("tk", "at", F.explode("marks").alias("m")).select("tk", (F.col("at") + F.col("m.lo")).alias("lo"), (F.col("at") + F.col("m.hi")).alias("hi")).distinct()
    copies = rows.groupBy("tk").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = removal(texts, intervals).join(copies, "tk", "full")
    joined = unskewed(rows.select("doc_id", "tk", "n_bytes", "sha"), gone, ["tk"], "left")
    all_gone = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    one = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return joined.select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(all_gone, one).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
