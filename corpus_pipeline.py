"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all that its predecessor kept, which was written as Parquet and read again. All but
the last return the columns of ``documents``, whatever else they are called.

Defined cases: rows without a language (null, empty or letterless texts among them) end in the first stage, so
later stages meet such rows only where they are called on their own: there a null or empty text has no lines, is
near no other text, has no benchmark window, and is packed as its end id. Repeated rows are one class of near
duplicates. An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import decontamination, language, lines, near, packing
from rollbook.llm.frames import fresh, read
from rollbook.session import cut

#: A document is rejected if no language is found, or none with this posterior.
LEAST_POSTERIOR = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, empty, no letter) or with an unclear one."""
    found = fresh("language", docs)
    return language.mark(docs, language.Model.fit(docs), found).where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= LEAST_POSTERIOR)).drop(found)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines of each source; n_chars follows the text. Every document stays."""
    found = fresh("cleaned", docs)
    cleaned = lines.marked(docs, found).withColumn("text", F.col(found)["text"]).drop(found)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def by_nearness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near.keep_one(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    found = fresh("n_hit", docs)
    return decontamination.mark(docs, read(spark, sf_dir, "benchmark"), found).where(F.col(found) == 0).drop(found)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("language", by_language), ("lines", by_lines), ("near", by_nearness), ("benchmark", by_benchmark), ("packing", by_packing)]

#: The stages run learned models, hashing and a tokenizer; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is stored in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
