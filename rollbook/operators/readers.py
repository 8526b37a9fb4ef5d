"""The surface for readers of pages and of cells: anything that turns batches of inputs into readings, run by the executors.

A reader is made by a factory that is sent to the executors, once for each task; it may load a model. What it can't
read is an error row, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE_OUT = "doc_id string, body string, error string"
CELL_OUT = "doc_id string, giorno int, campo string, candidates array<struct<value:string,logprob:double>>, free_text string, free_logprob double, free_tokens int, error string"


class PageReader(Protocol):
    """Reads whole pages. ``is_available`` says whether it can work, and why not."""

    def is_available(self) -> tuple[bool, str]: ...

    def extract(self, page: dict) -> dict:
        """The page's readings as sources.store.extraction() takes them."""


class CellReader(Protocol):
    """Reads batches of cells: a reading (candidates, free_text, free_logprob, free_tokens) for each request."""

    def read(self, requests: list[dict]) -> Iterable[dict]: ...


def read_pages(pages: DataFrame, factory: Callable[[], PageReader]) -> DataFrame:
    """(doc_id, body, error): every page (a row with doc_id and whatever the reader needs) as JSON, or why it could not be read."""
    schema = pa.schema([("doc_id", pa.string()), ("body", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, ready, why = None, False, ""
        for batch in batches:
            if reader is None:
                reader = factory()
                ready, why = reader.is_available()
            out = []
            for page in batch.to_pylist():
                body = error = None
                if not ready:
                    error = why
                else:
                    try:
                        body = json.dumps(reader.extract(page))
                    except Exception as e:  # a page's failure is its own
                        error = str(e) or type(e).__name__
                out.append({"doc_id": page["doc_id"], "body": body, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.mapInArrow(run, PAGE_OUT)


def read_cells(requests: DataFrame, factory: Callable[[], CellReader], size: int = 64) -> DataFrame:
    """Readings of cells (doc_id, giorno, campo and whatever the reader needs), ``size`` requests at a time. If a batch fails, its requests
    are tried one by one, so that only the bad ones are errors."""
    options = pa.list_(pa.struct([("value", pa.string()), ("logprob", pa.float64())]))
    schema = pa.schema([("doc_id", pa.string()), ("giorno", pa.int32()), ("campo", pa.string()), ("candidates", options), ("free_text", pa.string()), ("free_logprob", pa.float64()), ("free_tokens", pa.int32()), ("error", pa.string())])

    def answers(reader: CellReader, some: list[dict]) -> list[dict]:
        try:
            found = list(reader.read(some))
            if len(found) != len(some):
                raise ValueError(f"{len(found)} readings for {len(some)} requests")
        except Exception as e:
            return [{"error": str(e) or type(e).__name__}] if len(some) == 1 else [a for one in some for a in answers(reader, [one])]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or factory()
            for first in range(0, batch.num_rows, size):
                some = batch.slice(first, size).to_pylist()
                rows = [{"doc_id": r["doc_id"], "giorno": r["giorno"], "campo": r["campo"]} | a for r, a in zip(some, answers(reader, some), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return requests.mapInArrow(run, CELL_OUT)
