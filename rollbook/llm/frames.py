"""Shared pieces of the operators: scans, labels, held-out folds and bounded samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sample of one row in SAMPLED tells which keys are frequent: at most HOT_KEYS, of which it holds LEAST_DRAWN rows or more.
#: A frequent key is dealt over parts of about so many drawn rows, MOST_PARTS at most.
SAMPLED, HOT_KEYS, LEAST_DRAWN, MOST_PARTS = 50, 1000, 100, 1024
#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 holds tens of MB on both sides.
ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no column of these tables is called so (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unskewed(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` (stored tables; a key has few rows in ``small``) without a hot key in one task.

    A sample only decides how a key is joined: the rows of ``big`` for its most frequent keys, a bounded number of
    them, are dealt over several parts, each of which gets a copy of the key's rows of ``small``. So are rows without a key.
    """
    drawn = big.select(*on).dropna().sample(1 / SAMPLED, 17).groupBy(*on).count().where(F.col("count") >= LEAST_DRAWN)
    found = drawn.orderBy(F.desc("count")).limit(HOT_KEYS).collect()
    if not found and how == "inner":
        return big.join(small, on, how)
    many, part = fresh("parts", big, small), fresh("part", big, small)
    rows = [(*tuple(r)[:-1], min(MOST_PARTS, 1 + r["count"] // LEAST_DRAWN)) for r in found]
    hot = F.broadcast(big.sparkSession.createDataFrame(rows, big.select(*on, F.lit(0).alias(many)).schema))
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    dealt = big.join(hot, on, "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.when(none, MOST_PARTS).otherwise(F.coalesce(many, F.lit(1)))).cast("int")).drop(many)
    copies = small.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(many, F.lit(1)) - 1))).drop(many)
    return dealt.join(copies, [*on, part], how).drop(part)


def fold(doc_id: str, modulus: int, held: int) -> Column:
    """True where crc32 of the id as text, modulo ``modulus``, is ``held``; False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == held, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each class, chosen by a hash of the id: (doc_id, y). Rows of the held-out fold never enter.

    An id with several labels counts once, as 1 if any of them is 1; null ids and labels are left out.
    The result has at most 2 * per_class rows, so it may be broadcast.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~fold("doc_id", 3, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def release() -> None:
    """Gives freed memory back to the system; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of a bounded number of rows, whose memory is given back after each task."""
    conf = df.sparkSession.conf
    if int(conf.get(_ROWS_KEY)) > ROWS:
        conf.set(_ROWS_KEY, str(ROWS))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)
