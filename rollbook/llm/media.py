"""Content-defined chunking of media payloads, with deduplicated storage and verified reconstruction.

A payload is a text's bytes, filled up with bytes of 255 to a positive multiple of 576; texts are UTF-8, which has
no byte of 255, so payloads are equal where texts are. A gear hash rolls over a payload; where its top bits are
zero, between a least and a greatest length, a chunk ends. So equal stretches of different payloads give equal
chunks whatever stands before them. A payload is known by its SHA-256, a chunk by a 128-bit digest.

Which place keeps a chunk is settled by joins of digests alone: the first payload and position by order. Then the
chunks are cut again and compressed, and meet in the one shuffle of blocks, by payload: the store gets a row for
each payload, with the blocks of the chunks that it keeps. The store is written in passes, each for its share of
the payloads, so that the shuffle files of one pass are all there is beside it. Reading back, most payloads have
all their chunks in their own row; only blocks that other payloads borrow are joined to them by digest.
Every payload that is read back must have the SHA-256 that its rows have.

Blocks are compressed with a dictionary trained on a bounded sample of the distinct texts, which is part of the
store and named by its digest. The stored form of a payload, whose bytes and digest are reported, is its manifest: a
header with the dictionary's digest, and for each chunk its digest, its length and its compressed block.

Defined cases: null counts as empty, and an empty payload is 576 bytes of 255; repeated rows and equal
texts share everything; a payload longer than memory allows for one task can't be read (2 GB is Spark's
own bound for a text); where the sample is too small to train on, the dictionary is empty; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget
from .frames import map_arrow, unskewed
from .textkernel import blocks, digest, table

UNIT, FILL = 576, 255
#: Chunk lengths in bytes: least, about average above it, greatest.
LEAST, BITS, MOST = 1024, 11, 8192
#: Level 19 takes nine times as long for 7 % fewer bytes.
LEVEL = 6
#: Distinct texts, chosen by a hash, that the compression dictionary is trained on; texts of more bytes aren't drawn, so the
#: sample has 64 MB at most; and the dictionary's greatest size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1000, 65536, 262144
#: Passes in which the store is written.
PASSES = 2
_U = np.uint64
_GEAR = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def payload(raw: bytes) -> bytes:
    return raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 64 bytes' values, each shifted by its distance. Built by doubling."""
    h = _GEAR[data]
    for k in range(6):
        if len(h) > 1 << k:
            more = h.copy()
            more[1 << k :] += h[: -(1 << k)] << _U(1 << k)
            h = more
    return h


def cuts(data: np.ndarray) -> list[int]:
    """The ends of a payload's chunks."""
    able = np.flatnonzero(gear(data) >> _U(64 - BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > LEAST:
        k = int(np.searchsorted(able, at + LEAST))
        end = min(int(able[k]) if k < len(able) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def manifest(size: int, dictionary_digest: bytes, chunks: list[tuple[bytes, int, bytes]]) -> bytes:
    """The stored form: length, number of chunks, the dictionary's digest, then digest, length and block of each chunk."""
    return b"".join([b"CDC2", struct.pack("<QI", size, len(chunks)), dictionary_digest, *(x for key, n, block in chunks for x in (key, struct.pack("<II", n, len(block)), block))])


def feature(data: np.ndarray, lengths: list[int]) -> str:
    """Of a payload read back: moments and entropy of its samples, zero crossings about the mean, and chunk statistics."""
    n = len(data)
    counts = np.bincount(data, minlength=256)
    total, square = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    p = counts[counts > 0] / n
    above = data.astype(np.int64) * n > total
    return f"mean={total / n:.4f};var={square / n - (total / n) ** 2:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};crossings={int((above[1:] != above[:-1]).sum())};chunks={len(lengths)};longest={max(lengths)}"


def dictionary(documents: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample; empty where there is too little to learn from."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("text"))
    least = [r.h for r in texts.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    drawn = texts.where(F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text")
    parts = [raw[k : k + 2048] for t in drawn.toArrow().column("text").to_pylist() for raw in [t.encode()] for k in range(0, len(raw), 2048)]
    if sum(map(len, parts)) < 2 * DICTIONARY:
        return b""
    return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()


def _dict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _pieces(whole: bytes):
    """(digest, chunk) in order."""
    at = 0
    for end in cuts(np.frombuffer(whole, np.uint8)):
        yield digest(whole[at:end]), whole[at:end]
        at = end


def _payloads(column):
    """For each row of a text column its payload and that payload's SHA-256, block by block: first row, end, list."""
    for first, end, data, offsets in blocks(column):
        raw = data.tobytes()
        wholes = [payload(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield first, end, np.diff(offsets), [(w, hashlib.sha256(w).digest()) for w in wholes]


def lists(documents: DataFrame) -> DataFrame:
    """(doc_id, sha, n_bytes, digests) of every row; the list only where a task meets a payload for the first time."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary()))])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for first, end, size, rows in _payloads(batch.column("text")):
                found = []
                for whole, sha in rows:
                    found.append(None if sha in seen else [d for d, _ in _pieces(whole)])
                    seen.add(sha)
                yield table(schema, doc_id=batch.column("doc_id")[first:end], sha=[sha for _, sha in rows], n_bytes=size, digests=found)

    return _texts(documents).transform(map_arrow, run, "doc_id long, sha binary, n_bytes long, digests array<binary>")


def chunks(documents: DataFrame, trained: bytes, nth: int, passes: int) -> DataFrame:
    """(sha, pos, digest, size, block) of the chunks of one pass' payloads, each payload once for each task."""
    schema = pa.schema([("sha", pa.binary()), ("pos", pa.int32()), ("digest", pa.binary()), ("size", pa.int32()), ("block", pa.binary())])

    def run(batches):
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(trained), write_content_size=True, write_checksum=False, write_dict_id=False)
        for batch in batches:
            for _, _, _, rows in _payloads(batch.column("text")):
                out = []
                for whole, sha in rows:
                    if sha[0] % passes == nth and sha not in seen:
                        seen.add(sha)
                        out += [(sha, pos, key, len(part), pack.compress(part)) for pos, (key, part) in enumerate(_pieces(whole))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return _texts(documents).transform(map_arrow, run, "sha binary, pos int, digest binary, size int, block binary")


_STORE = "sha binary, n int, borrows int, own array<struct<pos:int,digest:binary,size:int,lent:boolean,block:binary>>"
_OWN = pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("size", pa.int32()), ("lent", pa.bool_()), ("block", pa.binary())])
_STORE_ARROW = pa.schema([("sha", pa.binary()), ("n", pa.int32()), ("borrows", pa.int32()), ("own", pa.list_(_OWN))])


def store(documents: DataFrame, trained: bytes, plan: DataFrame) -> list[DataFrame]:
    """The chunk store in the shared folder, a table for each pass: a row for each payload with the chunks that it keeps.

    ``plan``: (sha, n, borrowed, lent) with the positions of chunks that another place keeps, and of kept ones that others use.
    """

    def run(batches):
        held: list[dict] = []  # the plan and chunks of the payload that is being written

        def finish() -> dict:
            plan, parts = held[0], {r["pos"]: r for r in held[1:]}  # copies from several tasks are one
            borrowed, lent = set(plan["borrowed"] or ()), set(plan["lent"] or ())
            if plan["pos"] >= 0 or sorted(parts) != list(range(plan["size"])):
                raise ValueError(f"payload {plan['sha'].hex()}: chunks {sorted(parts)} of {plan['size']}")
            own = [{"pos": k, "digest": r["digest"], "size": r["size"], "lent": k in lent, "block": r["block"]} for k, r in sorted(parts.items()) if k not in borrowed]
            return {"sha": plan["sha"], "n": plan["size"], "borrows": len(borrowed), "own": own}

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                done = []
                for row in batch.slice(first, 256).to_pylist():
                    if held and held[0]["sha"] != row["sha"]:
                        done.append(finish())
                        held = []
                    held.append(row)
                if done:
                    yield pa.RecordBatch.from_pylist(done, _STORE_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([finish()], _STORE_ARROW)

    out, none = [], F.lit(None)
    for nth in range(PASSES):
        found = chunks(documents, trained, nth, PASSES).select("*", none.cast("array<int>").alias("borrowed"), none.cast("array<int>").alias("lent"))
        mine = plan.where(F.conv(F.hex(F.substring("sha", 1, 1)), 16, 10).cast("int") % PASSES == nth)
        heads = mine.select("sha", F.lit(-1).alias("pos"), none.cast("binary").alias("digest"), F.col("n").alias("size"), none.cast("binary").alias("block"), "borrowed", "lent")
        out.append(cut(found.unionByName(heads).repartition("sha").sortWithinPartitions("sha", "pos").transform(map_arrow, run, _STORE)))
    return out


_OUT = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(payloads: DataFrame, trained: bytes) -> DataFrame:
    """The values of payloads (sha, n, own, more) as read back from their own and borrowed blocks, verified."""
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = pa.schema(list(zip([c.split()[0] for c in _OUT.split(", ")], kinds, strict=True)))

    def run(batches):
        unpack, name = zstandard.ZstdDecompressor(dict_data=_dict(trained)), digest(trained)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(first, 64).to_pylist():
                    held = sorted([*row["own"], *(row["more"] or ())], key=lambda r: r["pos"])
                    parts = [unpack.decompress(r["block"]) for r in held]
                    whole = b"".join(parts)
                    found = hashlib.sha256(whole)
                    if [r["pos"] for r in held] != list(range(row["n"])) or found.digest() != row["sha"]:
                        raise ValueError(f"payload {row['sha'].hex()}: {len(held)} of {row['n']} chunks, sha256 {found.hexdigest()}")
                    media = manifest(len(whole), name, [(r["digest"], len(p), r["block"]) for r, p in zip(held, parts, strict=True)])
                    out.append((row["sha"], len(whole), found.hexdigest(), zlib.crc32(whole[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(whole, np.uint8), [len(p) for p in parts])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return payloads.transform(map_arrow, run, _OUT)


def references_of(listed: DataFrame) -> DataFrame:
    """(sha, pos, digest) of the chunks of every payload, from lists()."""
    return listed.where("digests is not null").dropDuplicates(["sha"]).select("sha", F.posexplode("digests").alias("pos", "digest"))


def settle(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who keeps which chunk, from digests alone: the plan for store(), and (sha, pos, digest) of the chunks that another place keeps."""
    owners = references.groupBy("digest").agg(F.min(F.struct("sha", "pos")).alias("o"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    owners = cut(owners.select("digest", F.col("o.sha").alias("sha0"), F.col("o.pos").alias("pos0")))
    borrowed = cut(unskewed(references, owners, ["digest"]).where((F.col("sha") != F.col("sha0")) | (F.col("pos") != F.col("pos0"))).select("sha", "pos", "digest"))
    marks = borrowed.select("sha", "pos", F.lit(False).alias("lends")).unionByName(owners.select(F.col("sha0").alias("sha"), F.col("pos0").alias("pos"), F.lit(True).alias("lends")))
    marked = marks.groupBy("sha").agg(*(F.collect_list(F.when(F.col("lends") == v, F.col("pos"))).alias(n) for n, v in (("borrowed", False), ("lent", True))))
    plan = cut(references.groupBy("sha").agg(F.count(F.lit(1)).cast("int").alias("n")).join(marked, "sha", "left"))
    forget(owners)
    return plan, borrowed


def media(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, and the values of its payload as read back from the store."""
    spark = documents.sparkSession
    kept_dictionary = cut(spark.createDataFrame([(digest(raw), raw) for raw in [dictionary(documents)]], "digest binary, dictionary binary"))
    trained = bytes(kept_dictionary.first().dictionary)  # part of the store: read back from there
    listed = cut(lists(documents))
    rows = listed.select("doc_id", "sha", "n_bytes")
    references = cut(references_of(listed))
    plan, borrowed = settle(references)
    forget(references)
    stored = store(documents, trained, plan)
    forget(plan)
    every = stored[0]
    for more in stored[1:]:
        every = every.unionByName(more)
    lent = cut(every.select(F.explode("own").alias("c")).where("c.lent").select("c.digest", "c.block"))
    fetched = unskewed(borrowed, lent, ["digest"]).groupBy("sha").agg(F.collect_list(F.struct("pos", "digest", "block")).alias("more"))
    none = F.lit(None).cast("array<struct<pos:int,digest:binary,block:binary>>").alias("more")
    whole = rebuild(every.where("borrows = 0").select("sha", "n", "own", none), trained)
    mended = rebuild(every.where("borrows > 0").join(fetched, "sha").select("sha", "n", "own", "more"), trained)
    rebuilt = cut(whole.unionByName(mended))
    forget(lent, borrowed)
    return unskewed(rows, rebuilt, ["sha"], "left").select("doc_id", "n_bytes", *(c.split()[0] for c in _OUT.split(", ")[1:]))
