"""Near-duplicate documents by ProbMinHash.

A document is the set of its runs of five words (all words of a shorter text). ProbMinHash draws for each
run a Poisson process whose rate is its weight; every arrival falls into one of the registers and the earliest
arrival keeps it; drawing stops once all later arrivals would come too late. Two documents agree in a register
with the probability Jaccard similarity of their runs. All weights are equal, however often a run occurs, so
that is the Jaccard similarity of the sets. Registers are banded, documents that agree in a band are
candidates, and candidates are verified by the same similarity, exactly.

Texts with equal word sequences are one unit, sketched once. In a band's bucket of a few units all pairs
are candidates. In a larger one all sketches are compared with each other, in memory, and the pairs that
may be alike enough are thinned to a spanning forest of the best estimates, which is verified. Estimates may
be wrong, so every bucket whose units are then still in several classes is looked at again, exactly: its tasks
hold the units' sets themselves, compare all units of different classes, and give only the links that join
classes; so no pairs travel. A bucket of more units or elements than a block is dealt into blocks by a hash: for the
forest each by itself, with a few units of the whole bucket; for the exact pass, all blocks with each other.
Links are joined to classes by connected components.

Defined cases: a text without words (null, empty, punctuation) is its own class; a class is named by its
smallest doc_id, nulls last; repeated rows are members of one class; extra columns are ignored; an empty
table gives no rows. A unit is half of a 128-bit digest of the words in order; among n different texts about
n*n / 2**65 pairs share that half, which the other half tells apart: those few units, and only those, are
known to the driver and take another number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut, forget
from .components import components
from .frames import fresh, map_arrow, unskewed
from .textkernel import Words, blocks, digests, mix, shingles, table

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Buckets of so many units at most give all their pairs.
SMALL = 8
#: In larger ones, units may be in the forest if their sketches agree so often that a pair as alike as asked misses it
#: with this chance at most; they are compared in blocks of so many units and elements of their sets, ...
MISS, BLOCK, ELEMENTS = 1e-6, 4096, 1 << 21
#: ... and where there are several blocks, with so many units of the whole bucket.
LEADS = 4
#: A list of so many units at most (8 bytes each) is broadcast to pick their texts.
BROADCAST_UNITS = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_KEYS = np.arange(1, ROWS + 1).astype(np.uint64) * _STEP


def halves(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a digest of each row's words in order; the first is odd, and 0 for rows without words."""
    both = np.frombuffer(b"".join(digests(words.hash.view(np.uint8), words.range * 8)), np.int64).reshape(-1, 2)
    return np.where(words.count > 0, both[:, 0] | 1, 0), both[:, 1]


def units(words: Words, shared: Sequence[int] = ()) -> np.ndarray:
    """The unit of each row; ``shared`` are first halves that different texts have in common."""
    one, two = halves(words)
    return np.where(np.isin(one, np.array(shared, np.int64)), (one ^ two) | 1, one)


def floor(similarity: float) -> int:
    """The most registers that a pair of this similarity agrees in but with a chance of MISS."""
    chance, least = 0.0, 0
    while least < REGISTERS:
        chance += math.comb(REGISTERS, least) * similarity**least * (1 - similarity) ** (REGISTERS - least)
        if chance > MISS:
            break
        least += 1
    return max(1, least)


def runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs: row, hash (48 bits) and weight, which is 1 as verification is by sets."""
    hashes, rows = shingles(words, SIZE)
    key = np.sort((rows.astype(np.uint64) << _U(48)) | (hashes >> _U(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> _U(48)).astype(np.int64), key[at] & _U((1 << 48) - 1), np.ones(len(at))


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that each register of each row keeps: (n_rows, registers)."""
    time = np.full(n_rows * registers, np.inf)
    kept = np.zeros(n_rows * registers, np.uint64)
    limit = np.full(n_rows, np.inf)
    last, drawn, arrivals = np.zeros(len(row)), 0, 1
    while len(row):
        step = (np.arange(drawn, drawn + arrivals) + 1).astype(np.uint64) * _STEP
        draw = mix(element[:, None] + step)
        when = last[:, None] - np.cumsum(np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[:, None], axis=1)
        place = row[:, None] * registers + (mix(draw) % _U(registers)).astype(np.int64)
        good = when < time[place]
        p, t = place[good], when[good]
        np.minimum.at(time, p, t)
        won = time[p] == t
        kept[p[won]] = np.broadcast_to(element[:, None], when.shape)[good][won]
        limit = time.reshape(n_rows, registers).max(1)
        on = when[:, -1] < limit[row]
        row, element, weight, last = row[on], element[on], weight[on], when[on, -1]
        drawn += arrivals
        arrivals = min(64, arrivals * 2 if drawn > 1 else 1)
    return kept.reshape(n_rows, registers)


def bands(kept: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    out = np.tile(mix(np.arange(1, BANDS + 1).astype(np.uint64)), (len(kept), 1))
    part = kept.reshape(len(kept), BANDS, ROWS)
    for k in range(ROWS):
        out = mix(out ^ (part[:, :, k] + _KEYS[k]))
    return out.view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, unit, check, keys, sketch, size): band keys, a byte of each register and the number of runs only where a task meets a unit for the first time."""
    schema = pa.schema([("doc_id", pa.int64()), ("unit", pa.int64()), ("check", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("size", pa.int64())])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                unit, check = halves(words)
                fresh = np.zeros(len(unit), bool)
                for i, u in enumerate(zip(unit.tolist(), check.tolist(), strict=True)):
                    if u[0] and u not in seen:
                        seen.add(u)
                        fresh[i] = True
                row, element, weight = runs(words)
                number = np.cumsum(fresh) - 1
                own = fresh[row]
                kept = prob_min_hash(number[row[own]], element[own], weight[own], int(fresh.sum())) if fresh.any() else np.zeros((0, REGISTERS), np.uint64)
                keys, small = bands(kept), mix(kept).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fresh) * BANDS]).astype(np.int32)), pa.array(keys.ravel()))
                yield table(schema, doc_id=batch.column("doc_id")[first:end], unit=pa.array(unit, pa.int64(), mask=unit == 0), check=check, keys=lists, sketch=[small[k].tobytes() if f else None for f, k in zip(fresh, number, strict=True)], size=np.bincount(row, minlength=len(unit)))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_arrow, run, "doc_id long, unit long, check long, keys array<long>, sketch binary, size long")


def told_apart(sketched: DataFrame) -> tuple[DataFrame, list[int]]:
    """``sketched`` with units that no two texts share, and the first halves that had to be told apart (next to none)."""
    both = sketched.where("unit is not null").groupBy("unit").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi")
    shared = [r.unit for r in both.collect()]
    if shared:
        sketched = sketched.withColumn("unit", F.when(F.col("unit").isin(shared), F.col("unit").bitwiseXOR(F.col("check")).bitwiseOR(1)).otherwise(F.col("unit")))
    return sketched, shared


def with_unit(documents: DataFrame, shared: Sequence[int] = (), name: str = "unit", text: str = "text") -> DataFrame:
    """``documents`` and a last column of units."""
    schema = StructType([*documents.schema.fields, StructField(name, LongType())])

    def run(batches):
        for batch in batches:
            unit = np.concatenate([np.zeros(0, np.int64), *(units(Words(data, offsets), shared) for _, _, data, offsets in blocks(batch.column(text)))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.int64(), mask=unit == 0)], names=[*batch.schema.names, name])

    return documents.transform(map_arrow, run, schema)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of units whose sets of runs are similar enough, with the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def sets(column):
        for _, _, data, offsets in blocks(column):
            hashes, rows = shingles(Words(data, offsets), SIZE)
            edge = np.searchsorted(rows, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                yield np.unique(hashes[edge[i] : edge[i + 1]])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                # a text that repeats from row to row is read once
                col = part.column("text_b").dictionary_encode()
                right = list(sets(col.dictionary))
                score = []
                for left, k in zip(sets(part.column("text_a")), col.indices.to_numpy(), strict=True):
                    both = np.concatenate([left, right[k]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    score.append(common / max(1, len(both) - common))
                score = np.array(score)
                good = score >= similarity
                yield table(schema, a=part.column("a").filter(pa.array(good)), b=part.column("b").filter(pa.array(good)), similarity=score[good])

    left = texts.select(F.col("unit").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("unit").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").transform(map_arrow, run, "a long, b long, similarity double")


def texts_once(documents: DataFrame, shared: Sequence[int] = ()) -> DataFrame:
    """(unit, text): a text of each unit once for each task."""
    schema = pa.schema([("unit", pa.int64()), ("text", pa.string())])

    def run(batches):
        seen: set[int] = {0}
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                unit, fresh = units(Words(data, offsets), shared), []
                for i, u in enumerate(unit.tolist()):
                    if u not in seen:
                        seen.add(u)
                        fresh.append(i)
                if fresh:
                    yield table(schema, unit=unit[fresh], text=batch.column("text")[first:end].take(pa.array(fresh)))

    return documents.select(F.col("text").cast("string").alias("text")).where("text is not null").transform(map_arrow, run, "unit long, text string")


def units_once(sketched: DataFrame) -> DataFrame:
    """(unit, keys, sketch, size) of every unit."""
    return sketched.where(F.size("keys") > 0).groupBy("unit").agg(F.min(F.struct("keys", "sketch", "size")).alias("s")).select("unit", "s.keys", "s.sketch", "s.size")


def bucket_members(one: DataFrame) -> DataFrame:
    """(key, unit, size, n) of buckets of n > 1 units."""
    exploded = one.select("unit", "size", F.explode("keys").alias("key"))
    sizes = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return exploded.join(sizes, "key").select("key", "unit", "size", "n")


def forest(sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of rows that agree in at least so many registers: each row's best, then the best between sets of
    rows that no pair joins yet, until all that can be joined are (Boruvka). Ties go to the first row."""
    n = len(sketch)
    agree = np.zeros((n, n), np.uint8)
    step = max(1, (4 << 20) // max(1, n * sketch.shape[1]))
    for k in range(0, n, step):
        agree[k : k + step] = (sketch[k : k + step, None, :] == sketch[None, :, :]).sum(2, dtype=np.uint8)
    np.fill_diagonal(agree, 0)
    agree[agree < least] = 0
    out, root = set(), np.arange(n)
    best = agree.argmax(1)
    found = [(i, int(b)) for i, b in enumerate(best) if agree[i, b]]
    second = agree.copy()
    second[np.arange(n), best] = 0
    out.update((max(i, int(b)), min(i, int(b))) for i, b in enumerate(second.argmax(1)) if second[i, b])
    while found:
        out.update((max(p), min(p)) for p in found)
        for i, j in found:
            root[root == root[i]] = root[j]
        open_ = np.where(root[:, None] == root[None, :], 0, agree)
        best = open_.argmax(1)
        value = open_[np.arange(n), best]
        leaders: dict[int, int] = {}
        for i in np.flatnonzero(value):
            r = int(root[i])
            if r not in leaders or value[i] > value[leaders[r]]:
                leaders[r] = int(i)
        found = [(i, int(best[i])) for i in leaders.values()]
    return sorted(out)


def exact_links(sets: list[np.ndarray], root: np.ndarray, is_row: np.ndarray, is_column: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a row and a column whose sets are similar enough and that connect all classes which such pairs connect.

    Exact: of a pair, elements that no third or other set here has can't be common, which rules most pairs out;
    the others' common elements are counted. Pairs of one class, given or joined meanwhile, are skipped.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = many[ids] > 1
    ids, owner = ids[held], owner[held]
    edge = np.searchsorted(owner, np.arange(len(sets) + 1))
    common_at_most = np.diff(edge)
    _, root = np.unique(root, return_inverse=True)
    column, mark, out = np.flatnonzero(is_column), np.zeros(len(many), np.int32), []
    for x in np.flatnonzero(is_row):
        bound = np.minimum(common_at_most[x], common_at_most[column])
        able = (bound >= similarity * (size[x] + size[column] - bound)) & (root[column] != root[x]) & ~(is_row[column] & (column < x) & is_column[x])
        some = column[able]
        if not len(some):
            continue
        mark[ids[edge[x] : edge[x + 1]]] = 1
        length = common_at_most[some]
        begin = np.cumsum(length) - length
        where = np.repeat(edge[some] - begin, length) + np.arange(length.sum())
        common = np.add.reduceat(mark[ids[where]], begin)
        mark[ids[edge[x] : edge[x + 1]]] = 0
        for y in some[common >= similarity * (size[x] + size[some] - common)]:
            if root[y] != root[x]:
                out.append((int(x), int(y)))
                root[root == root[y]] = root[x]
    return out


def element_sets(texts: DataFrame) -> DataFrame:
    """(unit, elements) of texts (unit, text): the distinct runs of each as sorted 32-bit hashes."""
    schema = pa.schema([("unit", pa.int64()), ("elements", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                hashes, rows = shingles(Words(data, offsets), SIZE)
                edge = np.searchsorted(rows, np.arange(len(offsets)))
                yield table(schema, unit=batch.column("unit")[first:end], elements=[np.unique((hashes[a:b] >> _U(32)).astype(np.uint32)).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])

    return texts.transform(map_arrow, run, "unit long, elements binary")


def open_buckets(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, unit, root, minor, blocks) of all buckets whose units are in several classes.

    Of two units of different classes at least one is outside the largest class: those are ``minor``.
    """
    rooted = large.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("elements"))
    top = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("n"), F.sum("elements").alias("elements")).where("classes > 1")
    top = top.select("key", F.col("top.root").alias("main"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / ELEMENTS)).alias("blocks"))
    return rooted.join(top, "key").select("key", "unit", "root", (F.col("root") != F.col("main")).alias("minor"), "blocks")


def open_links(opened: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between units of different classes in the buckets of open_buckets(), which connect all that links connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        unit, root, is_row, is_column = (rows.column(n).to_numpy() for n in ("unit", "root", "is_row", "is_column"))
        order = np.argsort(unit)
        elements = rows.column("elements").to_pylist()
        pairs = exact_links([np.frombuffer(elements[k], np.uint32) for k in order], root[order], is_row[order], is_column[order], similarity)
        a, b = unit[order][[p[0] for p in pairs]], unit[order][[p[1] for p in pairs]]
        return pa.table([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], schema=schema)

    # a task is the rows of block i and all units of block j
    dealt = opened.withColumn("own", F.pmod(F.xxhash64("unit"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    at_row = F.when(F.col("minor"), F.transform(every, lambda k: F.struct(F.col("own").alias("i"), k.alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    places = F.array_union(at_row, F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"))))
    spread = dealt.withColumn("at", F.explode(places)).select("key", "unit", "root", "at.i", "at.j", (F.col("minor") & (F.col("own") == F.col("at.i"))).alias("is_row"), (F.col("own") == F.col("at.j")).alias("is_column"))
    held = spread.join(sets, "unit").select("key", "i", "j", "unit", "root", "is_row", "is_column", "elements")
    return held.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def texts_of(documents: DataFrame, wanted: DataFrame, shared: Sequence[int]) -> DataFrame:
    """(unit, text) of the wanted units, stored. A list of units within a checked bound is broadcast, so that only wanted texts are shuffled."""
    wanted = wanted.distinct()
    few = wanted.count() <= BROADCAST_UNITS
    texts = texts_once(documents, shared).join(F.broadcast(wanted) if few else wanted.hint("merge"), "unit")
    return cut(texts.groupBy("unit").agg(F.first("text").alias("text")))


def links(documents: DataFrame, one: DataFrame, shared: Sequence[int] = (), similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of units that connect every class, and (node, root) of its units; ``one`` is a stored result of units_once()."""
    members = cut(bucket_members(one))
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("unit").alias("u"))
    small = few.select(F.explode(F.flatten(F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, SMALL), lambda y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")))))).alias("p")).select("p.a", "p.b")
    large = members.where(F.col("n") > SMALL)
    least = floor(similarity)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        unit = rows.column("unit").to_numpy()
        order = np.argsort(unit)
        unit, sketch = unit[order], np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        pairs = forest(sketch, least)
        a, b = unit[[p[0] for p in pairs]], unit[[p[1] for p in pairs]]
        return pa.table([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], schema=schema)

    blocked = large.withColumn("block", F.pmod(F.xxhash64("unit"), F.ceil(F.col("n") / BLOCK)))
    forests = blocked.join(one.select("unit", "sketch"), "unit").select("key", "block", "unit", "sketch").groupBy("key", "block").applyInArrow(run, "a long, b long")
    huge = large.where(F.col("n") > BLOCK)
    leads = huge.groupBy("key", F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(LEADS))).agg(F.min("unit").alias("lead"))
    stars = huge.join(leads.select("key", "lead"), "key").where("unit != lead").select(F.greatest("unit", "lead").alias("a"), F.least("unit", "lead").alias("b"))

    def checked(pairs: DataFrame) -> DataFrame:
        texts = texts_of(documents, pairs.select(F.explode(F.array("a", "b")).alias("unit")), shared)
        out = cut(verified(pairs, texts, similarity))
        forget(texts)
        return out

    tried = cut(small.unionByName(forests).unionByName(stars).distinct())
    found = checked(tried)
    forget(tried)
    roots = components(found)
    opened = cut(open_buckets(large, roots))
    if opened.limit(1).count():
        texts = texts_of(documents, opened.select("unit"), shared)
        more = cut(open_links(opened, element_sets(texts), similarity))
        if more.limit(1).count():
            found = found.unionByName(cut(verified(more, texts, similarity)))
            roots = components(found)
        forget(texts, more)
    forget(opened, members)
    return found, roots


def members(documents: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, list[int]]:
    """Per row of documents, stored: doc_id, unit and the root of its class (null without words); and what told_apart() found."""
    stored = cut(sketches(documents))
    sketched, shared = told_apart(stored)
    one, ids = cut(units_once(sketched)), cut(sketched.select("doc_id", "unit"))
    forget(stored)
    _, roots = links(documents, one, shared, similarity)
    rows = unskewed(ids, roots.withColumnRenamed("node", "unit"), ["unit"], "left")
    out = cut(rows.select("doc_id", "unit", F.coalesce("root", "unit").alias("root")))
    forget(one, ids)
    return out, shared


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of documents: doc_id, class_id (the smallest doc_id of its class), class_size and unit."""
    rows, _ = members(documents, similarity)
    names = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return unskewed(rows, names, ["root"], "left").select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "unit")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of ``documents``: the first by doc_id, nulls last. Rows without words stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit")).alias("k")
    rows, shared = members(documents, similarity)
    own, the_id, the_unit = (fresh(n, documents) for n in ("kept_unit", "first_id", "first_unit"))
    found = rows.where(F.col("root").isNotNull()).groupBy("root").agg(first).select(F.col("k.doc_id").alias(the_id), F.col("k.unit").alias(the_unit))
    marked = with_unit(documents, shared, own)
    kept = marked.join(found, F.col("doc_id").eqNullSafe(F.col(the_id)) & (F.col(own) == F.col(the_unit))).drop(the_id, the_unit).dropDuplicates(["doc_id", own])
    return kept.unionByName(marked.where(F.col(own).isNull())).drop(own)
