"""The pipeline's stages against plain Python on a small made corpus."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rollbook.llm.queries import queries


def test_stages_against_plain_python(spark, tmp_path):
    r = random.Random(8)
    pools = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdeino"), ("zz", "zyxwvuko"))}
    say = lambda lang, n: [r.choice(pools[lang]) for _ in range(n)]
    item = say("aa", 30)
    rows = []
    for k in range(120):
        lang = ("aa", "zz")[k % 2]
        body = say(lang, 60)
        text = " ".join(body) + "\nshared footer line\n" + " ".join(say(lang, 12)) if k % 3 == 0 else " ".join(body)
        rows.append([k, text, lang, f"s{k % 2}", len(text)])
    rows[10][1] = " ".join(say("aa", 20) + item[5:20] + say("aa", 20))  # a benchmark passage
    rows += [[120, "12345 !!! 678", None, "s0", 13], [121, None, "aa", "s1", None], [122, rows[7][1].upper(), "zz", "s0", 1], [123, rows[7][1] + " tail", "zz", "s1", 1], [7, rows[7][1], "zz", "s1", rows[7][4]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(x) for x in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "elsewhere entirely")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # language: no letter, no language; lines: over 5 % and four pages of the source; near: classes of equal or nearly equal words
    left = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    pages, seen = Counter(x[3] for x in left), Counter((x[3], line.strip()) for x in left for line in {y.strip(): y for y in x[1].split("\n")}.values() if line.strip())
    bad = {k for k, n in seen.items() if n >= 4 and n > 0.05 * pages[k[0]]}
    texts = {}
    for doc_id, text, _, source, _ in left:
        texts.setdefault(doc_id, "\n".join(line for line in text.split("\n") if (source, line.strip()) not in bad))
    del texts[122], texts[123], texts[10]
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: len(exact.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}

    got = queries()["pipeline"](spark, str(tmp_path)).collect()
    tokens = Counter()
    for p in got:
        tokens[p.doc_id] += p.length
    assert bad and dict(tokens) == want and np.unique([p.doc_tokens for p in got]).size > 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "packing"]
