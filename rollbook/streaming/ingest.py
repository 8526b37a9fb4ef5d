"""Ingest and edits as streams: idempotent pages, generation fencing, upserts by snapshot, change feed, edit log.

State is a Parquet base with deltas: an upsert writes the changed rows alone, and then a numbered state file that lists
what the table consists of. State files are never replaced, so readers see a whole snapshot, a crash between two
steps leaves the last one valid, and a batch that runs again after a failure gives the same table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def latest(versions: DataFrame, key: str = "doc_id", order: str = "gen") -> DataFrame:
    """The row of the greatest generation of each key; superseded results are dropped."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*").select(versions.columns)


def new_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages (source_sha256, source_page, …) that aren't known yet, each once."""
    return pages.dropDuplicates(["source_sha256", "source_page"]).join(known.select("source_sha256", "source_page"), ["source_sha256", "source_page"], "left_anti")


def retries(attempts: DataFrame) -> DataFrame:
    """(doc_id, attempts, dead): failed pages with the number of tries; dead after three."""
    counted = attempts.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("attempts"), F.max("ok").alias("done"))
    return counted.where("not done").select("doc_id", "attempts", (F.col("attempts") >= MAX_ATTEMPTS).alias("dead"))


def resumed(copies: DataFrame, attempts: DataFrame, done: DataFrame) -> DataFrame:
    """(import_id, path, attempts, azione) of interrupted imports: the kept copies (import_id, path, content, source_sha256) that aren't
    done (import_id) are tried again (riprova) as long as fewer than three attempts (import_id) were made and the copy still has its
    digest; others are given up (abbandona), a changed copy at once (danneggiata)."""
    made = attempts.groupBy("import_id").agg(F.count(F.lit(1)).alias("attempts"))
    left = copies.join(done.select("import_id").distinct(), "import_id", "left_anti").join(made, "import_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    action = F.when(F.coalesce(F.sha2("content", 256) != F.col("source_sha256"), F.lit(True)), "danneggiata").when(F.col("attempts") >= MAX_ATTEMPTS, "abbandona").otherwise("riprova")
    return left.select("import_id", "path", "attempts", action.alias("azione"))


def recovered(sheets: DataFrame) -> DataFrame:
    """After a restart, what was queued or being read is queued again."""
    return sheets.withColumn("status", F.when(F.col("status") == "in_lavorazione", "in_coda").otherwise(F.col("status")))


class Snapshots:
    """A table in a folder that Spark reads. The state file of the highest number is the valid one."""

    #: Deltas that are read together; then they and the base become a new base.
    MAX_DELTAS = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("states")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("states"))]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"revision": 0, "batch": -1, "parts": [], "key": None, "order": None}
        return json.loads(self.spark.read.text(f"{self.root}/states/{numbers[-1]:012d}", wholetext=True).first().value)

    def _commit(self, state: dict) -> None:
        """Writes the next state file under a name of its own, then gives it its number. Of two writers, the second fails."""
        number = (self._numbers() or [0])[-1] + 1
        draft = self._path(f"states/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._path(f"states/{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"state {number} was written by another process")

    def read(self) -> DataFrame | None:
        """The table, with the revision of each row's latest change in ``rev``."""
        state = self.current()
        if not state["parts"]:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{p}") for p in state["parts"]]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        if len(parts) > 1:
            gone = both.where("deleted").groupBy(state["key"]).agg(F.max("rev").alias("gone"))
            alive = both.where("not deleted").join(gone, state["key"], "left").where("gone is null or rev > gone").drop("gone")
            both = latest(alive.withColumn("_o", F.struct(state["order"], "rev")), state["key"], "_o").drop("_o")
        return both.where("not deleted").drop("deleted")

    def _add(self, rows: DataFrame, state: dict, **changes) -> int:
        revision = state["revision"] + 1
        part = f"parts/{revision:012d}-{uuid.uuid4().hex}"
        rows.withColumn("rev", F.lit(revision)).write.parquet(f"{self.root}/{part}")
        self._commit(state | {"revision": revision, "parts": [*state["parts"], part]} | changes)
        if len(state["parts"]) >= self.MAX_DELTAS:
            self.compact()
        return revision

    def compact(self) -> None:
        """Makes one base of base and deltas; the old files stay for those who read them and are deleted by vacuum()."""
        state = self.current()
        if len(state["parts"]) > 1:
            part = f"parts/{state['revision']:012d}-base-{uuid.uuid4().hex}"
            self.read().withColumn("deleted", F.lit(False)).write.parquet(f"{self.root}/{part}")
            self._commit(state | {"parts": [part]})

    def vacuum(self) -> None:
        """Deletes parts that the valid state doesn't list, left by compaction or by a crash; nobody may be reading or writing."""
        used = {p.split("/")[1] for p in self.current()["parts"]}
        for f in self._fs.listStatus(self._path("parts")) if self._fs.exists(self._path("parts")) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)

    def upsert(self, batch: DataFrame, batch_id: int = -1, key: str = "doc_id", order: str = "gen") -> int:
        """Merges a batch by key, the greater generation winning; gives the new revision. A batch that was merged before
        changes nothing. Changed rows carry the revision for the change feed."""
        state = self.current()
        if batch_id >= 0 and batch_id <= state["batch"]:
            return state["revision"]
        fresh, old = latest(batch, key, order), self.read()
        if old is not None:  # a superseded result isn't a change
            newer = old.select(key, F.col(order).alias("_known"))
            fresh = fresh.join(newer, key, "left").where(F.col("_known").isNull() | (F.col(order) >= F.col("_known"))).drop("_known")
        return self._add(fresh.withColumn("deleted", F.lit(False)), state, batch=max(batch_id, state["batch"]), key=key, order=order)

    def delete(self, keys: DataFrame, key: str = "doc_id") -> int:
        """Removes the rows of these keys."""
        state, old = self.current(), self.read()
        if old is None:
            return state["revision"]
        gone = old.join(keys.select(key).distinct(), key, "left_semi").withColumn("deleted", F.lit(True))
        return self._add(gone, state)

    def since(self, revision: int) -> DataFrame | None:
        """Rows changed after a revision; None if nothing changed, without reading the table."""
        return None if self.current()["revision"] <= revision else self.read().where(F.col("rev") > revision)


def ingest(spark: SparkSession, landing: str, schema, snapshots: Snapshots, checkpoint: str, key: str = "doc_id", order: str = "gen", files: int = 100):
    """A stream of JSON results from a landing folder into the snapshots; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: snapshots.upsert(df, n, key, order)).trigger(availableNow=True).start()


def edit_state(log: DataFrame) -> DataFrame:
    """Per (doc_id, campo) of an edit log (doc_id, campo, seq, old, new): the reader's first value, the latest value, and
    whether the field counts as edited: not if the latest is the first again, unless the first was empty."""
    by_field = log.groupBy("doc_id", "campo").agg(F.min_by("old", "seq").alias("originale"), F.max_by("new", "seq").alias("valore"))
    return by_field.withColumn("modificato", F.coalesce(F.col("valore") != F.col("originale"), F.lit(True)))


def next_flag(cells: DataFrame) -> DataFrame:
    """(…, successiva, precedente): the next and the previous flagged cell of a sheet in order, going on at its other end."""
    w, cell = W.partitionBy("doc_id").orderBy("giorno", "campo"), F.struct("giorno", "campo")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cells.where("segnalata").withColumns({"successiva": F.coalesce(F.lead(cell).over(w), F.first(cell).over(whole)), "precedente": F.coalesce(F.lag(cell).over(w), F.last(cell).over(whole))})
