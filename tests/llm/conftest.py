import random

import pytest

#: Columns of documents, and others whose names operators use themselves.
CLASHES = ["unit", "tk", "key", "score", "n_lines", "n_dropped", "cleaned", "n_hit", "found", "language", "kept_unit", "first_id", "first_unit", "boilerplate", "boilerplate_host", "boilerplate_part", "boilerplate_maybe", "_rollbook_letters", "h", "held_out", "sha", "runs", "row_key", "part", "dealt", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(seed, n, alphabet="abcdefghij"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows and columns whose names clash with helpers."""
    long = " ".join(words(1, 9000))
    base = " ".join(words(2, 120))
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \n\t ", "!!! ... 123", "one", base, base, " ".join(near), long, long + " tail", "Ünïcode straße 日本語 é́", "line\nshared line here\nother", "shared line here\nmore"]
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", None, "b"][k % 3], None if t is None else len(t), *("clash" if k % 4 else None for _ in CLASHES)) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, base, *[None] * (3 + len(CLASHES))), (None, None, *[None] * (3 + len(CLASHES)))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
