"""Site-relative line deduplication, in DataFrame operations alone.

A line is a piece of text between line feeds, compared without surrounding spaces. For every host, the
pages that contain a line are divided by all pages of the host; a line whose ratio exceeds the limit is
boilerplate there and is dropped from every page of the host.

Lines are counted as a pair of 64-bit hashes, once for each page, with partial sums before the shuffle.
Only boilerplate hashes travel back, gathered by host (their number is bounded by the lines of an average
page over the ratio). Where all of them together are found to be few, they are broadcast and no page is
shuffled. Otherwise pages are joined by host, the pages of a host with more than a thousandth of all
pages being dealt over as many parts as it has thousandths, each with a copy of the host's boilerplate.

Defined cases: a null text stays null with no lines; a page of a null host is left as it is; blank lines
are never boilerplate; a page counts once for a line that it repeats; repeated rows are pages of their
own; a line on fewer than ``least_pages`` pages is kept, however small the host; an empty table gives no
rows; columns of any other name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import fresh

RATIO = 0.05
LEAST_PAGES = 4
#: So many boilerplate hashes at most (16 bytes each, and their hosts) are broadcast.
BROADCAST_KEYS = 500_000
#: A host with more than this share of all pages is dealt over several parts; there are at most 1 / SHARE such hosts.
SHARE = 0.001


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """Stored: (h, keys, first) of the hosts with boilerplate, ``first`` being the keys' first halves, and (h, parts) of hot hosts."""
    split = F.split(F.col(text), "\n", -1)
    used = pages.where(F.col(host).isNotNull())
    sizes = cut(used.groupBy(F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("pages")))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    hot = sizes.where(F.col("pages") > F.lit(total * SHARE)).select("h", "pages", F.ceil(F.col("pages") / F.lit(max(1.0, total * SHARE))).cast("int").alias("parts"))
    lines = used.where(F.col(text).isNotNull()).select(F.col(host).alias("h"), F.explode(F.array_distinct(F.transform(F.filter(split, lambda x: F.trim(x) != ""), _key))).alias("k"))
    counted = lines.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    # a hot host has many lines too: its size goes to them
    few, many = F.broadcast(hot.select("h", F.col("pages").alias("hot"))), sizes.where(F.col("pages") <= F.lit(total * SHARE))
    sized = counted.join(few, "h", "left").join(many, "h", "left").withColumn("pages", F.coalesce("hot", "pages"))
    frequent = sized.where(F.col("n") > F.col("pages") * F.lit(ratio))
    gathered = frequent.groupBy("h").agg(F.collect_list("k").alias("keys")).select("h", "keys", F.array_distinct("keys.a").alias("first"))
    return cut(gathered), hot.select("h", "parts")


def marked(pages: DataFrame, name: str, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with a last column ``name``: a struct of the cleaned text and the numbers of lines, n_lines and n_dropped."""
    bad, hot = boilerplate(pages, host, text, ratio, least_pages)
    h, held, part, nth = (fresh(n, pages) for n in ("boilerplate_host", "boilerplate", "boilerplate_part", "boilerplate_copy"))
    keys = bad.select(F.col("h").alias(h), F.struct("keys", "first").alias(held))
    if (bad.agg(F.sum(F.size("keys"))).first()[0] or 0) <= BROADCAST_KEYS:
        joined = pages.join(F.broadcast(keys), F.col(host) == F.col(h), "left")
    else:
        parts = F.broadcast(hot.select(F.col("h").alias(h), F.col("parts").alias(part)))
        place = F.pmod(F.monotonically_increasing_id(), F.coalesce(part, F.lit(1))).cast("int")
        dealt = pages.join(parts, F.col(host) == F.col(h), "left").drop(h).withColumn(part, place)
        copies = keys.join(parts, h, "left").withColumn(nth, F.explode(F.sequence(F.lit(0), F.coalesce(part, F.lit(1)) - 1))).drop(part)
        joined = dealt.join(copies, (F.col(host) == F.col(h)) & (F.col(part) == F.col(nth)), "left")
    split = F.split(F.col(text), "\n", -1)
    # few lines of a page can be boilerplate: a set of longs finds them once for the page, and only they are compared in full
    maybe = fresh("boilerplate_maybe", pages)
    joined = joined.withColumn(maybe, F.array_intersect(F.transform(split, lambda x: F.xxhash64(F.trim(x))), F.col(held)["first"]))
    keep = F.filter(split, lambda x: ~(F.array_contains(maybe, F.xxhash64(F.trim(x))) & F.array_contains(F.col(held)["keys"], _key(x))))
    touched = F.size(maybe) > 0  # not where there is no text or no boilerplate
    total = F.coalesce(F.when(F.col(text).isNotNull(), F.size(split)), F.lit(0)).cast("long")
    cleaned = F.when(touched, keep).alias("kept")
    out = joined.select(*pages.columns, F.struct(cleaned, total.alias("n_lines")).alias(name))
    kept = F.col(name)["kept"]
    gone = F.when(kept.isNull(), F.lit(0)).otherwise(F.col(name)["n_lines"] - F.size(kept)).cast("long")
    return out.withColumn(name, F.struct(F.when(kept.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("text"), F.col(name)["n_lines"].alias("n_lines"), gone.alias("n_dropped")))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``, and the columns n_lines and n_dropped of before and after,
    which replace columns of these names."""
    name = fresh("cleaned", pages)
    columns = [F.col(name)["text"].alias(text) if c == text else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return marked(pages, name, host, text, ratio, least_pages).select(*columns, F.col(name)["n_lines"].alias("n_lines"), F.col(name)["n_dropped"].alias("n_dropped"))


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
seen AS (SELECT DISTINCT doc_id, source, trim(line, ' ') AS line FROM (SELECT doc_id, source, unnest(lines) AS line FROM split WHERE source IS NOT NULL) WHERE trim(line, ' ') <> ''),
sizes AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
boilerplate AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM seen GROUP BY source, line) JOIN sizes USING (source) WHERE n >= {LEAST_PAGES} AND n > pages * {RATIO}),
bad AS (SELECT source, list(line) AS bad FROM boilerplate GROUP BY source),
kept AS (SELECT doc_id, source, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' '))) END AS kept FROM split LEFT JOIN bad USING (source))
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""
