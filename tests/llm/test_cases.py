"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from rollbook.llm import decontamination, language, lines, media, near, packing, pii, quality, suffix, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, some=True):
    rows = [(k, int(k % 2), int(k % 3 == 0), "clash") for k in range(60)] + [(None, 1, 1, None), (5, None, None, None), (5, 1, 1, "again")]
    return spark.createDataFrame(rows if some else [], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "alone"), (3, "")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, s: toxicity.detect(d, labels(s)),
    "media": lambda d, s: media.media(d),
    "quality": lambda d, s: quality.rate(d, labels(s)),
    "lines": lambda d, s: lines.dedup_lines(d),
    "language": lambda d, s: language.identify(d),
    "decontamination": lambda d, s: decontamination.decontaminate(d, items(s)),
    "packing": lambda d, s: packing.pack(d),
    "near": lambda d, s: near.classes(d),
    "suffix": lambda d, s: suffix.remove_repeats(d),
    "pii": lambda d, s: pii.detect(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, odd_rows, name):
    got = OPERATORS[name](odd, spark).collect()
    if name != "packing":
        assert len(got) == len(odd_rows)
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == list(range(13))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](empty, spark).collect() == []


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, odd, empty, tmp_path, stage):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    for docs in (odd, empty):
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept, given = Counter(map(str, out.drop("text", "n_chars").collect())), Counter(map(str, docs.drop("text", "n_chars").collect()))
        assert kept <= given and (stage or kept < given or not given)


def test_packing_stage(spark, odd, empty, odd_rows):
    f = corpus_pipeline.STAGES[4][1]
    assert f(spark, empty, "").collect() == []
    got = f(spark, odd, "").collect()
    assert sum(r.start == 0 for r in got) == len(odd_rows) and f(spark, odd, "").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_without_labels(spark, odd):
    assert {r.score for r in toxicity.detect(odd, labels(spark, False)).collect()} == {0.5}
    assert {r.score for r in quality.rate(odd, labels(spark, False)).collect()} == {0.5}


def test_words_less_texts(spark, odd):
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert all(lang[k] == ("und", 0.0) for k in range(4)) and lang[5][0] in ("en", "fr")
    pack = {r.doc_id: r for r in packing.pack(odd).where("doc_id < 2").collect()}
    assert [(r.doc_tokens, r.length, r.ids_crc32) for r in pack.values()] == [(1, 1, zlib.crc32(b"\2\0\0\0"))] * 2
    stored = {r.doc_id: r for r in media.media(odd).collect()}
    assert stored[0].payload_sha256 == hashlib.sha256(bytes([255]) * 576).hexdigest() and stored[0].n_bytes == 0
    cls = {r.doc_id: r for r in near.classes(odd).where("doc_id is not null").collect()}
    assert [cls[k].class_id for k in range(4)] == [0, 1, 2, 3] and cls[6].class_id == cls[7].class_id == 5 and cls[9].class_id == 8
    gone = {r.doc_id: r for r in suffix.remove_repeats(odd).where("doc_id is not null").collect()}
    assert gone[5].n_removed == gone[5].n_bytes and gone[0].n_removed == 0 and gone[8].n_removed == gone[8].n_bytes


def test_tiny_benchmark_items(spark, odd):
    got = {r.doc_id: r for r in decontamination.decontaminate(odd, spark.createDataFrame([(7, "ONE!"), (None, "line")], "item_id long, text string")).collect()}
    assert (got[4].n_hit, got[4].items) == (1, ["7"]) and (got[11].n_hit, got[11].n_items) == (3 - 1, 0) and not got[0].contaminated
