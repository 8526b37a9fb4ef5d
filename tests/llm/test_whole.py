"""Cases in which a bound once stood for the whole job."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import decontamination, frames, language, lines, media, near, packing, pii, quality, suffix, textkernel, toxicity
from rollbook.session import cut


def likeness(rows):
    """The classes of (id, text) by exact set Jaccard of 0.8 over all pairs."""
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
    return {i: find(i) for i in sets}


def decoys(n=300):
    """Two texts just above the threshold, and many just below it for either, whose estimates are often higher."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(500)]
    places = list(range(5, 495, 5))
    linked = dict(zip(r.sample(places, 11), [word() for _ in range(11)]))
    rows = [base, [linked.get(k, w) for k, w in enumerate(base)]]
    for _ in range(n):
        shared = r.sample(sorted(linked), 5)
        own = {k: word() for k in r.sample([p for p in places if p not in linked], 7)} | {k: linked[k] for k in shared}
        rows.append([own.get(k, w) for k, w in enumerate(base)])
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def near_classes(spark, rows):
    return {x.doc_id: x.class_id for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}


def test_near_goes_on_after_failed_candidates(spark):
    rows = decoys()
    want = likeness(rows)
    assert want[1] == 0 and near_classes(spark, rows) == want


def test_near_compares_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    r, rows = random.Random(12), []
    base = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(300)]
    for _ in range(40):  # pairs of near copies, apart from all other pairs by about 0.7
        pair = [r.choice("xyz") + str(r.random())[2:] if k % 7 == 3 and r.random() < 0.25 else w for k, w in enumerate(base)]
        rows += [pair, ["changed" + str(k) if k == 2 else w for k, w in enumerate(pair)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = likeness(rows)
    assert len(set(want.values())) > 20 and near_classes(spark, rows) == want


def test_near_repeated_passages(spark):
    r = random.Random(13)
    base = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(120)]
    rows = [(k, " ".join(base + base[30 * k : 30 * k + 30] * 50)) for k in range(4)]  # each repeats another passage
    assert set(likeness(rows).values()) == {0} and set(near_classes(spark, rows).values()) == {0}
    assert near.floor(0.8) == 102


def test_keep_one_without_unique_ids(spark):
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black", "red green blue white black"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (7, "north south east west up"), (7, "sun moon star sky rain"), (None, "!")]
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[k] for k in (0, 1, 3, 4, 5, 6)], key=str)


def test_packing_spreads_copies(spark):
    rows = [(k % 3 or None, "the same text in every row") for k in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group=20).collect()
    groups = {}
    for x in got:
        groups[x.sequence_id >> 32] = groups.get(x.sequence_id >> 32, 0) + x.length
    total = sum(x.length for x in got)
    assert total == sum(x.doc_tokens for x in got if x.start == 0) and len(groups) == 30 and max(groups.values()) < 0.1 * total


def test_disclosing_terms_of_whole_documents(spark):
    far = "and then a good many other words follow here "
    rows = [(k, f"zanzibar {far}call +39 081 555 1234 {far}zanzibar") for k in range(3)] + [(3, f"tel +39 02 555 9876 {far}quetzal")] + [(k, f"call {far}") for k in range(4, 12)]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    told = {k: [rows[k][1][t["start"] : t["end"]] for t in r["terms"]] for k, r in got.items()}
    assert told == {k: ["zanzibar"] * 2 for k in range(3)} | {3: ["tel", "quetzal"]} | {k: [] for k in range(4, 12)}
    assert all(t["removed"] for k in range(4) for t in got[k]["terms"])


def thue_morse(n=1024):
    """A string of two letters and its complement: every polynomial hash modulo a power of two gives both one value."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_no_text_is_taken_for_another(spark):
    one, two = thue_morse()
    data = [np.frombuffer(x.encode(), np.uint8) for x in (one, two)]
    sums = [textkernel.prefix_hashes(d) for d in data]
    whole = np.array([0]), np.array([1024])
    assert textkernel.span_hashes(sums[0], *whole) == textkernel.span_hashes(sums[1], *whole)  # so it is no identity
    assert textkernel.span_keys(data[0], *whole) != textkernel.span_keys(data[1], *whole)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, " ".join(one)), (5, " ".join(two))], "doc_id long, text string").repartition(1)
    for r in media.media(docs).collect():
        text = {1: one, 2: two, 3: one, 4: " ".join(one), 5: " ".join(two)}[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(media.payload(text.encode())).hexdigest()
    crc = {r.doc_id: r.ids_crc32 for r in packing.pack(docs).where("start = 0").collect()}
    assert crc[1] == crc[3] != crc[2] and crc[4] != crc[5]
    classes = {r.doc_id: r.class_id for r in near.classes(docs).collect()}
    assert classes[1] == classes[3] == 1 and classes[2] == 2


def test_units_with_one_first_half_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 9, 1), (5, None, 0)]
    told, shared = near.told_apart(spark.createDataFrame(rows, "doc_id long, unit long, check long"))
    unit = {r.doc_id: r.unit for r in told.collect()}
    assert shared == [7] and unit[1] == unit[3] != unit[2] and unit[4] == 9 and unit[5] is None


def test_store_keeps_each_chunk_once(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    texts = [passage, passage + "end", "start" + passage, "".join(r.choice("ijklmnop ") for _ in range(9000)), passage, None, "", passage * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in media.media(docs).collect()}
    for k, t in enumerate(texts):
        whole = media.payload((t or "").encode())
        assert (got[k].payload_sha256, got[k].payload_bytes, got[k].n_bytes) == (hashlib.sha256(whole).hexdigest(), len(whole), len((t or "").encode()))
    assert got[0].media_sha256 == got[4].media_sha256 and got[5].feature == got[6].feature
    references = cut(media.references_of(media.lists(docs)))
    plan, borrowed = media.settle(references)
    kept = [c.digest for t in media.store(docs, b"", plan) for x in t.collect() for c in x.own]
    every = [x.digest for x in references.collect()]
    assert sorted(kept) == sorted(set(every)) and len(every) == len(kept) + borrowed.count() > len(kept) + 10


def test_benchmark_of_several_automata(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.selectExpr("item_id", "text").unionByName(spark.createDataFrame([(-1, "the")], "item_id long, text string"))
    once = sorted(map(str, decontamination.decontaminate(docs, items).collect()))
    marks = sorted((r.doc_id, r.n) for r in decontamination.mark(docs, items, "n").collect())
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 3000)
    assert len(list(decontamination.dealt_items(items))) > 2
    assert sorted(map(str, decontamination.decontaminate(docs, items).collect())) == once
    assert sorted((r.doc_id, r.n) for r in decontamination.mark(docs, items, "n").collect()) == marks and any(n for _, n in marks)


def test_pii_of_long_texts(spark):
    import time

    addresses = " ".join(f"user{k}@host{k % 97}.example word{k % 500}" for k in range(20_000))
    rows = [(1, "9" * 2_000_000), (2, addresses), (3, "+" + "1 (" * 300_000), (4, "1." * 500_000), (5, "a@" * 200_000), (6, "4111 1111 1111 1111 " * 20_000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert got[2].n_email == 20_000 and got[4].n_ip == 125_000 and got[1].n_card == got[5].n_email == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = [int(c) for c in text if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 16 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_against_brute_force(spark):
    """Base spans by the plain patterns, terms by counting every pair of a document's terms and entities."""
    r = random.Random(5)
    said = ["call", "mail", "server", "zanzibar", "quetzal", "ocelot", "tapir", "host", "the", "card"]
    data = ["+39 081 555 1234", "a.b@c.de", "x@y.org", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "+1-2", "é@b.it", "00.01.002.3"]
    rows = [(k, " ".join(r.choice(said if r.random() < 0.8 else data) for _ in range(r.randint(0, 14)))) for k in range(150)]
    pairs = [("lynx", "x@y.org"), ("okapi", "10.0.0.1"), ("gnu", "a.b@c.de")]  # words that go with one value, more or less
    rows += [(300 + k, f"{r.choice(said)} {a} {b if r.random() < 0.7 else ''} {'rare' + chr(97 + k % 20) * 3}") for k in range(40) for a, b in [pairs[k % 3]]]
    rows += [(200, None), (7, "tapir +39 081 555 1234"), (7, "tapir +39 081 555 1234")]
    texts = [t or "" for _, t in rows]
    base = [[(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, t) if valid(kind, m[0])] for t in texts]
    value = lambda t, s: (s[0], re.sub(r"[ .()-]", "", t[s[1] : s[2]]) if s[0] in ("card", "phone") else t[s[1] : s[2]].lower())
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", t)] for t in texts]
    holds, both = Counter(), Counter()
    for t, s, w in zip(texts, base, words):
        terms = {x[0] for x in w if len(x[0]) >= 3}
        holds.update({x[0] for x in w})
        both.update((term, e) for term in terms for e in {value(t, x) for x in s})
    got = Counter()
    for row in pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[(row.doc_id, row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256, row.spans, str([(x.start, x.end, x.removed) for x in row.terms]))] += 1
    want = Counter()
    for (doc_id, _), t, s, w in zip(rows, texts, base, words):
        mine = {value(t, x) for x in s}
        told = {term: max(both[term, e] for e in mine) for term in {x[0] for x in w if len(x[0]) >= 3}} if mine else {}
        spans = [(a, b, told[x] == holds[x]) for x, a, b in w if x in told and 2 * told[x] >= holds[x] and not any(a < q and p < b for _, p, q in s)]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        n = Counter(x[0] for x in s)
        want[(doc_id, *(n[k] for k in PATTERNS), hashlib.sha256(text.encode()).hexdigest(), ",".join([text] * bool(text) + [f"term:{a}:{b}" for a, b, _ in spans]), str(spans))] += 1
    assert got == want and any("term" in k[6] for k in want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_unskewed_joins_like_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(frames, "SAMPLED", 2)
    big = spark.createDataFrame([(None if k % 7 == 0 else min(k, 9), k) for k in range(3000)], "key int, part int").repartition(3)
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5, 40)] + [(9, "again"), (None, "none")], "key int, parts string")
    got, want = frames.unskewed(big, small, ["key"], how), big.join(small, "key", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_texts_longer_than_a_block(spark):
    """Every operator on texts of more than a block, with what matters at their end."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    long = " ".join(r.choice(vocabulary) for _ in range(230_000)) + "\nmenu\nwrite to zora@example.org " + passage
    assert len(long) > textkernel.BLOCK
    other = " ".join(r.choice(vocabulary) for _ in range(300)) + "\nmenu\n"
    rows = [(1, long, "xx", "s"), (2, long + " tail", "xx", "s"), (3, other, "xx", "s"), (4, "short text " + passage, "yy", "s"), (5, "menu", "yy", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    get = lambda d: {x.doc_id: x for x in d.collect()}
    for got in (get(toxicity.detect(docs, labels)), get(quality.rate(docs, labels)), get(language.identify(docs))):
        assert sorted(got) == [1, 2, 3, 4, 5] and all(0 <= x.score <= 1 for x in got.values())
    assert {k: x.payload_sha256 for k, x in get(media.media(docs)).items()} == {k: hashlib.sha256(media.payload(t.encode())).hexdigest() for k, t, _, _ in rows}
    assert {k: x.n_dropped for k, x in get(lines.dedup_lines(docs)).items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}
    hit = get(decontamination.decontaminate(docs, spark.createDataFrame([(9, passage)], "item_id long, text string")))
    assert {k: x.n_hit for k, x in hit.items()} == {1: 30, 2: 30, 3: 0, 4: 30, 5: 0} and long.encode()[hit[1].spans[0].start :].decode() == passage
    pieces = packing.pack(docs).collect()
    total = {k: sum(p.length for p in pieces if p.doc_id == k) for k, *_ in rows}
    assert total == {p.doc_id: p.doc_tokens for p in pieces} and max(p.length for p in pieces) <= packing.LENGTH
    assert {k: x.class_id for k, x in get(near.classes(docs)).items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    gone = get(suffix.remove_repeats(docs))
    assert gone[1].n_removed == gone[1].n_bytes == len(long.encode()) and gone[2].n_removed == len(long.encode()) and gone[3].n_removed == 0 == gone[5].n_removed
    assert len(passage.encode()) < 200 or gone[4].n_removed >= len(passage.encode())
    assert {k: x.n_email for k, x in get(pii.detect(docs)).items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
