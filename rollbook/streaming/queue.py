"""The reading queue as a stream: requests are queued once, read with bounded concurrency, and pass through fixed states.

A sheet goes from in_coda to in_lavorazione and on to completato, scartato (no attendance sheet) or errore; a new
request puts it back to in_coda under the next generation, and results of an older one are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.readers import PageReader, read_pages
from .ingest import Snapshots

# Readings at a time by the kind of reader, states, and their messages.
MOST_AT_A_TIME = {"cloud": 8, "local": 1}
QUEUED, READING, DONE, REJECTED, FAILED = "in_coda", "in_lavorazione", "completato", "scartato", "errore"
MESSAGES = {QUEUED: "In coda", READING: "Lettura del foglio in corso…", DONE: "Lettura completata", REJECTED: "Pagina non riconosciuta come foglio firma", FAILED: "Lettura non riuscita"}
ALLOWED = {QUEUED: [READING], READING: [DONE, REJECTED, FAILED, QUEUED], DONE: [QUEUED], REJECTED: [QUEUED], FAILED: [QUEUED]}
# End of fixed values.


def concurrency(kind: str, wanted: int | None = None) -> int:
    """Readings at a time: what is wanted, within the bound of the reader's kind; unknown kinds read one by one."""
    most = MOST_AT_A_TIME.get(kind, 1)
    return max(1, min(most, wanted if wanted is not None else most))


def may_follow(old: Column, new: Column) -> Column:
    """Whether a state may follow another; a new sheet begins in the queue."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ALLOWED.items() for x in kv])
    return F.coalesce(F.array_contains(F.element_at(allowed, old), new), new == QUEUED)


def states(log: DataFrame) -> DataFrame:
    """(doc_id, gen, status, changes, dropped) after a log of changes (doc_id, seq, gen, status).

    A request (in_coda) of a greater generation supersedes everything before it; of the current generation, changes apply in
    order as far as they may follow; changes of older generations are dropped, and requests for what is queued count once.
    """
    current = log.where(F.col("status") == QUEUED).groupBy("doc_id").agg(F.max("gen").alias("now"))
    joined = log.join(current, "doc_id")
    # one sheet's changes within a generation are a handful: they are folded in order
    own = F.array_sort(F.collect_list(F.when(F.col("gen") == F.col("now"), F.struct("seq", "status"))))
    folded = F.aggregate(
        "steps", F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("n")),
        lambda acc, x: F.when(F.when(acc["status"].isNull(), x["status"] == QUEUED).otherwise(may_follow(acc["status"], x["status"]) & (x["status"] != QUEUED)), F.struct(x["status"].alias("status"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    out = joined.groupBy("doc_id").agg(F.max("now").alias("gen"), own.alias("steps"), F.count(F.lit(1)).alias("all")).withColumn("f", folded)
    return out.select("doc_id", "gen", F.col("f.status").alias("status"), F.col("f.n").cast("long").alias("changes"), (F.col("all") - F.col("f.n")).alias("dropped"))


def next_jobs(sheets: DataFrame, limit: int) -> DataFrame:
    """The oldest queued sheets (doc_id, status, queued_at), as many as may be read beside those being read: at most ``limit`` rows."""
    running = sheets.where(F.col("status") == READING).limit(limit).count()
    return sheets.where(F.col("status") == QUEUED).orderBy("queued_at", "doc_id").limit(max(0, limit - running))


def progress(updates: DataFrame) -> DataFrame:
    """(doc_id, gen, progress, message): of progress updates (doc_id, gen, seq, progress, message) the latest message of the latest
    generation, and its greatest progress, which never goes back."""
    by_gen = updates.groupBy("doc_id", "gen").agg(F.max("progress").alias("progress"), F.max_by("message", "seq").alias("message"))
    return by_gen.groupBy("doc_id").agg(F.max_by(F.struct("gen", "progress", "message"), "gen").alias("x")).select("doc_id", "x.*")


def available(checks: DataFrame, now: Column, keep: int = 15, recheck: int = 60) -> DataFrame:
    """(reader, ready, message, fresh, due): the latest availability check (reader, checked_at, ready, message) of each reader: whether it
    still counts (``keep`` seconds), and whether a blocked reader is due to be checked again (``recheck`` seconds)."""
    last = checks.groupBy("reader").agg(F.max_by(F.struct("checked_at", "ready", "message"), "checked_at").alias("x")).select("reader", "x.*")
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    return last.select("reader", "ready", "message", (age < keep).alias("fresh"), (~F.col("ready") & (age > recheck)).alias("due"))


def read_batch(requests: DataFrame, batch_id: int, sheets: Snapshots, factory: Callable[[], PageReader], at_a_time: int) -> None:
    """One batch of requests (doc_id and what the reader needs): queued once each under their next generation, shown as being read,
    read by ``at_a_time`` tasks, and finished. Run again after a failure, a batch gives the same: its two upserts have
    numbers of their own."""
    once = requests.dropDuplicates(["doc_id"])
    old = sheets.read()
    if batch_id * 2 + 1 <= sheets.current()["batch"]:
        return
    known = old.select("doc_id", F.col("gen").alias("_gen"), F.col("status").alias("_status")) if old is not None else None
    joined = once.join(known, "doc_id", "left") if known is not None else once.withColumns({"_gen": F.lit(None).cast("long"), "_status": F.lit(None).cast("string")})
    # a batch that was interrupted after its first upsert goes on with the generation that it began
    again = batch_id * 2 <= sheets.current()["batch"]
    gen = F.coalesce("_gen", F.lit(0)) + (0 if again else 1)
    started = joined.select("doc_id", gen.cast("long").alias("gen"), F.lit(READING).alias("status"), F.lit(MESSAGES[READING]).alias("message"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("error"))
    sheets.upsert(started, batch_id * 2)
    generation = sheets.read().join(once.select("doc_id"), "doc_id", "left_semi").select("doc_id", "gen")
    read = read_pages(once.repartition(at_a_time), factory)
    is_sheet = F.coalesce(F.get_json_object("body", "$.is_foglio_firma") != "false", F.lit(True))
    status = F.when(F.col("error").isNotNull(), FAILED).when(is_sheet, DONE).otherwise(REJECTED)
    message = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("status"))
    sheets.upsert(read.withColumn("status", status).withColumn("message", message).join(generation, "doc_id").select("doc_id", "gen", "status", "message", "body", "error"), batch_id * 2 + 1)


def serve(spark: SparkSession, landing: str, schema, sheets: Snapshots, checkpoint: str, factory: Callable[[], PageReader], kind: str = "local", wanted: int | None = None, files: int = 100):
    """The stream of requests (JSON files in a landing folder) through the reader into the table of sheets; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(landing)
    at_a_time = concurrency(kind, wanted)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: read_batch(df, n, sheets, factory, at_a_time)).trigger(availableNow=True).start()
