"""Operators against brute force on small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollbook.llm import components, decontamination, language, lines, media, near, packing, pii, quality, suffix, textkernel, toxicity
from rollbook.llm.queries import oracle_sql, queries
from rollbook.session import shared_root

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted((tuple(v for _, v in sorted(zip(want.columns, r, strict=True))) for r in want.fetchall()), key=str)


def test_word_hashes():
    a, b = "Ab, c1 éÀ\x00x", "c1"
    data = (a + b).encode()
    w = textkernel.Words(np.frombuffer(data, np.uint8), np.array([0, len(a.encode()), len(data)]))
    assert [data[s:e].decode() for s, e in zip(w.start, w.end)] == ["Ab", "c1", "éÀ", "x", "c1"]
    assert w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 4 and w.count.tolist() == [4, 1]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for n, letters in ((0, 2), (1, 2), (9, 1), (60, 1), (700, 2), (1500, 200)):
        t = r.integers(0, letters, n).astype(np.uint8)
        b = t.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        got = suffix.suffix_array(t)
        assert got.tolist() == want
        common = [0] + [next((k for k in range(n) if b[x : x + k + 1] != b[y : y + k + 1] or max(x, y) + k >= n), 0) for x, y in zip(want, want[1:])]
        assert suffix.common_prefixes(t, got).tolist() == common[:n]


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_repeats(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)  # a small one spreads most anchors over shards
    seen = Counter(b[k : k + 200] for t in texts.values() for b in [t.encode()] for k in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    for i, t in texts.items():
        b = t.encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                edge[k] += 1
                edge[k + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), gone.sum(), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())


def test_near_classes(spark):
    r, rows = random.Random(3), []
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    for group in range(12):  # groups of edited copies around the threshold, one larger than a small bucket
        base = [r.choice(vocabulary) for _ in range(150)]
        for _ in range(40 if group == 0 else 4):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    got = {x.doc_id: x.class_id for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets}


def test_prob_min_hash_estimates():
    r = np.random.default_rng(5)
    a, b = {int(x): 1.0 + x % 3 for x in range(60)}, {int(x): 1.0 + (x + x // 50) % 3 for x in range(20, 80)}
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})
    row = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    kept = near.prob_min_hash(row, textkernel.mix(np.array([*a, *b], np.uint64)) >> np.uint64(16), np.array([*a.values(), *b.values()]), 2, 4000)
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03 and r is not None


def test_components(spark):
    shared_root(spark)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


TRICKY = ["", "Hello, it's me—we've “quoted” 3.14!!  x=1", "ÀÉÎ straße ß·ö ×÷ a×b", "don't ,'s. 's 'S I'M x'll''re", "日本語 テスト。ok", "é café, ok", "a<|endoftext|>b x", " nb sp\u0085x", "!!,'s-'re", ",—.…x", "ÅB", "１２３½²a", "a'él", "≠x", "ﬁ ﬀ", "İstanbul ΣΑΣ ", "x\x00y \x1c z\x1fq"]


def test_tokens_and_packing(spark, docs, texts):
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*exact.encode(t, add_special_tokens=False).ids, 2], "<u4")
    raw = [t.encode() for t in TRICKY]
    got, size = packing.Encoder(packing.default_tokenizer())(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, part in zip(TRICKY, np.split(got, np.cumsum(size)[:-1]), strict=True):
        assert part.tolist() == ids(t)[:-1].tolist(), t
    fill, parts, tokens = defaultdict(list), defaultdict(list), 0
    for r in packing.pack(docs).collect():
        true = ids(texts[r.doc_id])
        assert r.doc_tokens == len(true) and r.ids_crc32 == zlib.crc32(true[r.start : r.start + r.length].tobytes())
        fill[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
        tokens += r.length
    for pieces in [*fill.values(), *parts.values()]:
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    full = [sum(n for _, n in p) for p in fill.values()]
    assert max(full) <= 4096 and sum(4096 - f for f in full if f & (f - 1)) < 0.05 * tokens


def test_tournament_is_first_fit():
    r = random.Random(1)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    free, want = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(100)
        free[k] -= s
        want.append(k)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_media(spark, docs, texts):
    x = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in x.tolist():
        h = ((h << 1) + int(media._GEAR[b])) & ((1 << 64) - 1)
        want.append(h)
    assert media.gear(x).tolist() == want
    for r in media.media(docs).collect():
        raw = texts[r.doc_id].encode()
        p = media.payload(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) and len(p) % 576 == 0
    # an insertion moves no cut that is far behind it
    long = np.random.default_rng(2).integers(97, 105, 60_000).astype(np.uint8).tobytes()
    tail = lambda raw: {raw[a:b] for c in [[0, *media.cuts(np.frombuffer(raw, np.uint8))]] for a, b in zip(c, c[1:])}
    assert len(tail(long) & tail(b"new" + long)) > 0.7 * len(tail(long))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans(texts):
    r = random.Random(2)
    made = ["".join(r.choice("ab.@-_ 1") for _ in range(60)) for _ in range(400)]
    for t in [*made, *texts.values(), "a@b.c@d.e", "foo@bar.com,baz@qux.org;%+a@b.co"]:
        assert [m.span() for m in EMAIL.finditer(t)] == pii.emails(t)
    spans = pii.base_spans("ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111, 4111111111111112 tel +39 081-555 1234")
    assert spans == [("ip", 3, 10), ("card", 26, 45), ("phone", 68, 84)]
    assert pii.joined(spans[:1]) == "ip:3:10"


def test_disclosing_terms(spark):
    rows = [(k, f"please call zanzibar at +39 081 555 1234 now, number {k}") for k in range(4)] + [(k, f"please call now at noon {k}") for k in range(4, 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(d).collect()}
    told = {rows[0][1][t["start"] : t["end"]] for t in got[0]["terms"]}
    assert "zanzibar" in told and "please" not in told and got[5].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise_documents(d).collect()}
    assert "zanzibar" not in clean[0] and "555" not in clean[0] and clean[5] == rows[5][1]


def test_forward_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ab", b" ", b"abb"]
    pieces += [bytes([x]) for x in range(256) if bytes([x]) not in pieces]
    p = np.append(np.linspace(0.1, 0.4, len(pieces)), 0)[:, None]
    parts = language.Parts(np.frombuffer(b"abb", np.uint8), np.array([0]), np.array([3]), language.Lookup(pieces))
    (word, ids), = parts.together()

    def total(s):
        sums = [1.0] + [0.0] * len(s)
        for e in range(1, len(s) + 1):
            sums[e] = sum(sums[e - k] * p[pieces.index(s[e - k : e]), 0] for k in range(1, e + 1) if s[e - k : e] in pieces)
        return sums[-1]

    assert np.isclose(language.forward(ids, p)[0, -1, 0], total(b" abb"))


def test_long_runs_are_summed_whole():
    r = random.Random(6)
    pieces = language.vocabulary(language.default_vocabulary())
    chosen = [x.decode() for x in pieces if len(x) > 5 and x[0] > 127 and x.decode(errors="ignore").encode() == x]
    runs = ["".join(r.choice(chosen) for _ in range(40)), "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(70)), "a" * 300, "ab", "й" * 5000]
    probability = np.append(np.random.default_rng(1).uniform(1e-8, 1e-2, (len(pieces), 2)), [[0, 0]], 0)
    data = " ".join(runs).encode()
    words, folded = language.letter_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    scorer = language.Scorer(pieces, probability)
    scorer(words, folded)
    known = {x: i for i, x in enumerate(pieces)}
    for word, run in enumerate(runs):
        raw, got = b" " + run.encode(), scorer.value[np.searchsorted(scorer.key, words.hash[word])]
        logs = np.full((len(raw) + 1, 2), -np.inf)
        logs[0] = 0
        for e in range(1, len(raw) + 1):
            for k in range(1, min(e, 30) + 1):
                if (i := known.get(raw[e - k : e])) is not None:
                    logs[e] = np.logaddexp(logs[e], logs[e - k] + np.log(probability[i]))
        assert np.allclose(got, logs[-1], rtol=1e-9), run[:20]


def test_language_against_brute_force(spark):
    """Learning and prediction of a small corpus, by plain dictionaries and every segmentation."""
    r = random.Random(9)
    rows = []
    for k in range(60):
        lang = ("xx", "yy")[k % 2]
        rows.append((k, " ".join("".join(r.choice({"xx": "abcd", "yy": "cdef"}[lang]) for _ in range(r.randint(1, 9))) for _ in range(4)), lang))
    rows += [(60, "abab Feed", None), (61, "123", "xx"), (62, None, "yy")]
    pieces = language.vocabulary(language.default_vocabulary())
    start = {x: 0.25 ** len(x) + 1e-6 for x in pieces}

    def sums(word, p):
        forth, back, n = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0], len(word)
        cells = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if word[a:b] in p]
        for a, b in sorted(cells, key=lambda c: c[1]):
            forth[b] += forth[a] * p[word[a:b]]
        for a, b in sorted(cells, key=lambda c: -c[0]):
            back[a] += p[word[a:b]] * back[b]
        return forth, back, cells

    learned = {}
    for lang in ("xx", "yy"):
        used = Counter(b" " + w.lower().encode() for k, t, x in rows if x == lang and t and zlib.crc32(str(k).encode()) % 5 for w in re.findall("[A-Za-z]+", t))
        p = dict(start)
        for _ in range(language.ROUNDS):
            whole = sum(p.values())
            p, count = {x: v / whole for x, v in p.items()}, dict.fromkeys(pieces, 0.02)
            for word, n in used.items():
                forth, back, cells = sums(word, p)
                for a, b in cells:
                    count[word[a:b]] += n * forth[a] * p[word[a:b]] * back[b] / forth[-1]
            p = count
        whole = sum(p.values())
        learned[lang] = {x: v / whole for x, v in p.items()}
    for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        words = re.findall("[A-Za-z]+", rows[x.doc_id][1] or "")
        if not words:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        log = np.array([sum(np.log(sums(b" " + w.lower().encode(), learned[lang])[0][-1]) for w in words) for lang in ("xx", "yy")])
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert x.lang_pred == ("xx", "yy")[log.argmax()] and abs(x.score - post.max()) < 1e-4 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lang = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred)) a").first().a
    good = quality.rate(d, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = quality)) a").first().a
    tox = toxicity.detect(d, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = toxic)) a").first().a
    assert lang > 0.99 and good > 0.97 and tox > 0.96


def test_lines_ratio(spark):
    rows = [(k, f"menu\nbody {k}\n menu ", "h") for k in range(10)] + [(k, "menu\nx", None) for k in range(10, 16)] + [(20, "menu", "g")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == ("body 3", 3, 2) and got[12] == ("menu\nx", 2, 0) and got[20] == ("menu", 1, 0)


def test_offsets_map_back(spark):
    text = "Éé — Alpha, beta-gamma: delta; epsilon zeta eta theta iota KAPPA! lambda"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    r = decontamination.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string")).first()
    assert (r.n_words, r.n_hit, r["items"]) == (13, 10, ["q"])
    assert text.encode()[r.spans[0].start : r.spans[0].end].decode() == "Alpha, beta-gamma: delta; epsilon zeta eta theta iota KAPPA"


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline

    d = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        d = stage(spark, d, SF)
    assert d.count() == docs.count()
    classes = near.classes(d)
    kept = near.keep_one(d)
    assert kept.count() == classes.select("class_id").distinct().count()


def test_convolution_against_plain_loops():
    """Scoring by precomputed rows equals embedding, filtering and pooling word by word; training lowers the loss."""
    r = random.Random(3)
    texts = ["", "bad", *(" ".join(r.choice(["bad", "worse", "fine", "good", "lovely", "awful"]) for _ in range(r.randint(1, 12))) for _ in range(40))]
    raw = [t.encode() for t in texts]
    words, hashes = toxicity.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    docs = [hashes[a:b] for a, b in zip(words.range[:-1], words.range[1:])]
    model = toxicity.Model(np.unique(hashes))
    y = np.array([int("bad" in t or "awful" in t) for t in texts])

    def plain(doc):
        x = [model.embed[model.rows(h[None])[0]].sum(0) for h in doc]
        pooled = []
        for j, f in enumerate(model.filters):
            z = [sum((x[i + k] @ f[k] for k in range(len(f)) if i + k < len(x)), np.zeros(toxicity.FILTERS)) + model.bias[j * toxicity.FILTERS : (j + 1) * toxicity.FILTERS] for i in range(len(x))]
            pooled.append(np.maximum(0, np.max(z, 0)) if z else np.zeros(toxicity.FILTERS))
        return float(np.concatenate(pooled) @ model.out + model.base)

    def loss():
        logit = np.array([plain(d) for d in docs])
        return np.mean(np.log1p(np.exp(-np.where(y == 1, logit, -logit))))

    before = loss()
    model.train([model.rows(d) for d in docs], y)
    assert loss() < 0.5 * before
    got = model.logits(model.rows(hashes), words.count, model.table())
    assert np.allclose(got, [plain(d) for d in docs], atol=1e-3)


def test_attention_and_its_gradient():
    """Gated attention bag by bag, and the gradient against finite differences."""
    r = np.random.default_rng(2)
    count = np.array([1, 4, 2, 7])
    x, y = r.normal(0, 1, (14, quality.N_FEATURES)), np.array([1, 0, 0, 1])
    model = quality.Attention(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    logit, c = model.forward(x, count)
    p, at = model.p, 0
    for k, n in enumerate(count):
        h = np.tanh(x[at : at + n] @ p["e"] + p["eb"])
        s = (np.tanh(h @ p["v"]) / (1 + np.exp(-h @ p["u"]))) @ p["a"]
        w = np.exp(s) / np.exp(s).sum()
        assert np.isclose(logit[k], (w @ h) @ p["o"] + p["ob"][0]) and np.allclose(c["w"][at : at + n], w)
        at += n
    loss = lambda: np.log1p(np.exp(-np.where(y == 1, 1, -1) * model.forward(x, count)[0])).sum()
    g = model.gradient(1 / (1 + np.exp(-logit)) - y, count, c)
    for name, value in p.items():
        for i in r.integers(0, value.size, 5):
            old = value.flat[i]
            value.flat[i] = old + 1e-5
            up = loss()
            value.flat[i] = old - 1e-5
            down = loss()
            value.flat[i] = old
            assert np.isclose((up - down) / 2e-5, g[name].flat[i], atol=1e-5), name


def test_passage_features_do_not_depend_on_neighbours():
    texts = ["One two. THREE, four!", "", "x " * 200, "a|b|c 1 2 3"]
    raw = [t.encode() for t in texts]
    together, count = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = [quality.passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
    assert count.tolist() == [1, 1, 4, 1] and np.allclose(together, np.concatenate(alone), atol=1e-6)
