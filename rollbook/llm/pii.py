"""Personal data: base patterns, and information-theoretic sanitisation of what would reveal it.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. Their distinct
values are the protected entities. Words of a document that mentions one are terms that may reveal the entity
even after the mention itself is gone: with n(t) documents that hold a term and n(t, e) of them that mention
the entity, the term leaves -log2(n(t, e) / n(t)) bits of uncertainty about it. A term at or below the limit
of bits is a disclosing term; all its occurrences in documents that mention that entity become spans too,
generalised to a placeholder if some other document has the term, and removed otherwise. Counts cover all
documents and all their words; a term's documents are counted with partial sums.

A page of many entities and many terms would have the product of both as pairs. Most needn't be made: entities
of one set of documents count as one; a term of so few documents that one of them is enough discloses all
entities beside it; a term that has too few of its documents among those that mention anything discloses nothing;
and an entity of fewer documents than a term needs can't be disclosed by it. Pairs are only made of the rest.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds all stay, and the
sanitised text replaces their union once, by the placeholder of the first; repeated rows count as
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import map_arrow, unskewed
from .language import letter_words
from .textkernel import blocks, digest, keys_of, table

KINDS = ("email", "ip", "card", "phone")
#: Spans added by the method follow the base kinds.
TERM = "term"
#: A term discloses an entity if it leaves at most so many bits of uncertainty about it; one document is enough.
MAX_BITS = 1.0
LEAST_LETTERS = 3
#: So many terms at most (16 bytes each) are broadcast to the documents that may hold them.
BROADCAST_TERMS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, as what fails there fails at its later digits too, and takes whole runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of the whole pattern: each at sign takes all local characters before it that are still free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind, then start, in code points."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct entities that these spans mention."""
    return sorted({f"{kind}:{''.join(c for c in text[a:b].lower() if c not in ' -().') if kind in ('card', 'phone') else text[a:b].lower()}" for kind, a, b in spans})


def terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """(word, start, end, free) for all words of a text that may be terms; free if no base span touches it."""
    # the free part after each span: a word is free if it ends before the next span begins
    bounds = sorted((a, b) for _, a, b in spans)
    out, k, covered = [], 0, 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(bounds) and bounds[k][0] < e:
            covered = max(covered, bounds[k][1])
            k += 1
        if e - s >= LEAST_LETTERS:
            out.append((m[0], s, e, covered <= s))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sanitise(text: str, spans: list[tuple[str, int, int]], removed: set[tuple[int, int]] = frozenset()) -> str:
    """The text with the union of its spans replaced: base data and generalised terms by a placeholder, removed terms by nothing."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "" if (a, b) in removed else f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


_WORD_KEY = "word_key long, n long"
_SCAN = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string())])
_TERM = pa.struct([("term", pa.int64()), ("places", pa.list_(pa.int64()))])
_MENTION = pa.schema([("row_key", pa.binary()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(_TERM))])
_SCAN_DDL = "doc_id long, row_key binary, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, base string"
_MENTION_DDL = "row_key binary, entities array<long>, terms array<struct<term:long,places:array<long>>>"


def _hashes(items: list[str]) -> np.ndarray:
    return keys_of([x.encode() for x in items]).view(np.int64) if items else np.zeros(0, np.int64)


def _term_keys(terms: list[str]) -> np.ndarray:
    """The keys that word_documents gives these words."""
    data = np.frombuffer("\n".join(terms).encode(), np.uint8)
    return letter_words(data, np.array([0, len(data)]))[0].hash.view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _rows(batch):
    """The rows of a batch in blocks of bounded bytes: their numbers, and for each its key (a digest of id and text) and text."""
    ids = batch.column("doc_id").to_pylist()
    for first, end, data, offsets in blocks(batch.column("text")):
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield first, end, [(digest(b"%s:%s" % (str(i).encode(), p)), p.decode()) for i, p in zip(ids[first:end], parts, strict=True)]


def base(documents: DataFrame) -> DataFrame:
    """Base counts, digest and spans of every document."""

    def run(batches):
        for batch in batches:
            for first, end, rows in _rows(batch):
                spans = [base_spans(t) for _, t in rows]
                text = [joined(s) for s in spans]
                counts = {f"n_{k}": [sum(s[0] == k for s in x) for x in spans] for k in KINDS}
                yield table(_SCAN, doc_id=batch.column("doc_id")[first:end], row_key=[k for k, _ in rows], base=text, base_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in text], **counts)

    return _texts(documents).transform(map_arrow, run, _SCAN_DDL)


def mentions(documents: DataFrame) -> DataFrame:
    """A row for each document that mentions an entity: its entities, and its terms with the starts and ends of their occurrences
    outside base spans. Only texts with a digit or an at sign are looked at."""

    def run(batches):
        for batch in batches:
            for _, _, rows in _rows(batch):
                out = []
                for key, text in rows:
                    if not (spans := base_spans(text)) or not (words := terms(text, spans)):
                        continue
                    at: dict[int, list[int]] = {}
                    for term, (_, start, end, free) in zip(_term_keys([w[0] for w in words]).tolist(), words, strict=True):
                        at.setdefault(term, []).extend((start, end) if free else ())
                    out.append({"row_key": key, "entities": _hashes(entities(text, spans)).tolist(), "terms": [{"term": t, "places": p} for t, p in at.items()]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _MENTION)

    return _texts(documents).where(F.col("text").rlike("[0-9@]")).transform(map_arrow, run, _MENTION_DDL)


def word_documents(documents: DataFrame) -> DataFrame:
    """How many documents hold each word: partial counts of each task, summed."""

    def run(batches):
        held_key, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held_key), pa.array(held_n)], names=["word_key", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                words, _ = letter_words(data, offsets)
                order = np.lexsort((words.rows(), words.hash))
                key, row = words.hash[order], words.rows()[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                some, n = np.unique(key[new], return_counts=True)
                every = np.concatenate([held_key, some.view(np.int64)])
                count = np.concatenate([held_n, n])
                held_key, back = np.unique(every, return_inverse=True)
                held_n = np.bincount(back, count, len(held_key)).astype(np.int64)
                if len(held_key) > 1_500_000:
                    yield out()
                    held_key, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held_key):
            yield out()

    return _texts(documents).select("text").transform(map_arrow, run, _WORD_KEY).groupBy("word_key").agg(F.sum("n").alias("n"))


def numbered(mentioned: DataFrame) -> DataFrame:
    """mentions() stored, one row for each id and text, with how often it is there (``times``) and a short number (``rid``)."""
    stored = cut(mentioned.withColumn("rid", F.monotonically_increasing_id()).withColumn("times", F.lit(1).cast("long")))
    if not stored.groupBy("row_key").count().where("count > 1").limit(1).count():
        return stored
    rest = F.struct("rid", "entities", "terms")
    return cut(stored.groupBy("row_key").agg(F.min_by(rest, "rid").alias("r"), F.count(F.lit(1)).alias("times")).select("row_key", "r.entities", "r.terms", "r.rid", "times"))


def disclosing(mentioned: DataFrame, words: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """(rid, term, removed) of the terms that reveal an entity of that document; mentioned: a result of numbered()."""
    share = 2.0**-max_bits  # of a term's documents that have to mention the entity
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    entity = mentioned.select("rid", "times", F.explode("entities").alias("entity"))
    term = mentioned.select("rid", "times", F.explode("terms.term").alias("term"))
    # a term that has too few of its documents among those that mention anything at all discloses nothing: most words
    held = term.groupBy("term").agg(F.sum("times").alias("m"))
    able = cut(held.join(words.withColumnRenamed("word_key", "term"), "term").where(F.col("m") >= least).select("term", "n"))
    few = able.count() <= BROADCAST_TERMS
    known = cut(term.join(F.broadcast(able), "term") if few else unskewed(term, able, ["term"])).select("rid", "term", "n")
    # entities of one set of documents have the same counts with every term: their number and two sums of hashes name the set
    h = [F.xxhash64("rid", F.lit(k)).cast("decimal(20,0)") for k in (1, 2)]
    sets = entity.groupBy("entity").agg(F.sum("times").alias("n_e"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b"))
    group = unskewed(entity, sets, ["entity"]).select("rid", "times", F.xxhash64("n_e", "a", "b").alias("who"), "n_e").distinct()
    pairs = known.where("n > 1").join(group.where("n_e > 1"), "rid").where(F.col("n_e") >= least)
    together = pairs.groupBy("who", "term").agg(F.sum("times").alias("n_both"), F.first("n").alias("n"))
    told = together.where(F.col("n_both") >= least).select("who", "term", (F.col("n") <= F.col("n_both")).alias("whole"))
    some = pairs.select("rid", "who", "term").join(told, ["who", "term"]).groupBy("rid", "term").agg(F.max("whole").alias("whole"))
    alone = known.where(least <= 1).select("rid", "term", (F.col("n") == 1).alias("whole"))
    return some.unionByName(alone).groupBy("rid", "term").agg(F.max("whole").alias("removed"))


_PLACED = pa.schema([("row_key", pa.binary()), ("terms", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())])))])
_PLACED_DDL = "row_key binary, terms array<struct<start:long,end:long,removed:boolean>>"


def placed(batches):
    """From terms with their places and the disclosing ones of each document, the spans in order."""
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(first, 64).to_pylist():
                told = {t["term"]: t["removed"] for t in row["told"]}
                spans = sorted((a, b, told[t["term"]]) for t in row["terms"] if t["term"] in told for a, b in zip(t["places"][::2], t["places"][1::2], strict=True))
                out.append({"row_key": row["row_key"], "terms": [{"start": a, "end": b, "removed": r} for a, b, r in spans]})
            yield pa.RecordBatch.from_pylist(out, _PLACED)


def detect(documents: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """Per document: base counts and digest, all spans, and ``terms``: the added spans as structs (start, end, removed)."""
    mentioned = numbered(mentions(documents))
    told = disclosing(mentioned, word_documents(documents), max_bits)
    # the disclosing terms go to their document, where their places are
    mine = told.groupBy("rid").agg(F.collect_list(F.struct("term", "removed")).alias("told"))
    terms = mentioned.join(mine, "rid").select("row_key", "terms", "told").transform(map_arrow, placed, _PLACED_DDL)
    text = F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t["start"], t["end"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")
    found = base(documents).join(terms, "row_key", "left").withColumn("terms", F.coalesce("terms", none))
    added = F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), text), ",")
    return found.select("doc_id", "row_key", *(f"n_{k}" for k in KINDS), "base_sha256", added.alias("spans"), F.size("terms").cast("long").alias("n_terms"), "terms")


def sanitise_documents(documents: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """Per document: doc_id, the sanitised text and its spans."""
    found = detect(documents, max_bits).dropDuplicates(["row_key"]).where("spans != ''").select("row_key", "spans", "terms")
    keyed = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("row_key", pa.binary())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.string())])

    def key(batches):
        for batch in batches:
            for first, end, rows in _rows(batch):
                yield table(keyed, doc_id=batch.column("doc_id")[first:end], text=batch.column("text")[first:end], row_key=[k for k, _ in rows])

    def run(batches):
        for batch in batches:
            for first, end, _, _ in blocks(batch.column("text")):
                part = batch.slice(first, end - first)
                texts, spans = part.column("text").to_pylist(), [s or "" for s in part.column("spans").to_pylist()]
                removed = [{(t["start"], t["end"]) for t in x or () if t["removed"]} for x in part.column("terms").to_pylist()]
                split = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(","))] if s else [] for s in spans]
                yield table(schema, doc_id=part.column("doc_id"), text=[sanitise(t, s, r) for t, s, r in zip(texts, split, removed, strict=True)], spans=spans)

    rows = _texts(documents).transform(map_arrow, key, "doc_id long, text string, row_key binary")
    return rows.join(found, "row_key", "left").select("doc_id", "text", "spans", "terms").transform(map_arrow, run, "doc_id long, text string, spans string")
