import random

import numpy as np
import xxhash

from sluicework.llm import simhash_dedup as S

from sluicework.llm import common

from .helpers import clashes_kept, documents, empty, with_clashes


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, fps, radius=4):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def test_against_brute_force(spark):
    docs = documents(spark)
    got = S.group_near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(((r.doc_id, f, c) for r, f, c in zip(rows, fps, want)), key=key)


def test_links_find_every_close_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_VARIANTS", 20_000)  # many prefixes, and heavy ones that are split
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(3):
            x = f
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = S.links(df, 4)
    for e in edges.collect():
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 4
    roots = {r.node: r.root for r in S.components(edges).collect()}
    got = [roots.get(s, s) for s in signed]
    assert got == plain_components(signed, fps)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(200)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in S.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1201)}}


def test_empty(spark):
    assert S.group_near_duplicates(empty(spark)).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_bits_counted_in_planes_are_the_bits():
    h = np.random.default_rng(5).integers(0, 2**63, (1237, 3)).astype(np.uint64)
    want = np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0)
    assert (S._ones(h) == want).all()


def test_texts_as_similar_as_asked_are_grouped_and_others_are_not(spark):
    rng = random.Random(9)
    texts, pairs = [], []
    for i in range(120):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400)))
        other = edited(rng, base, rng.choice([0.005, 0.01, 0.015, 0.02, 0.1, 0.2]))
        pairs.append((len(texts), len(texts) + 1, similar(base, other)))
        texts += [base, other]
    first = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    family = [first] + [edited(rng, first, 0.01) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts + family)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    close = [p for p in pairs if p[2] >= 0.82]
    assert len(close) > 40 and sum(got[b] == a for a, b, _ in close) >= 0.97 * len(close)
    apart = [p for p in pairs if p[2] < 0.7]
    assert len(apart) > 20 and all(got[a] == a and got[b] == b for a, b, _ in apart)
    want = exact_components(family)
    assert [got[len(texts) + i] - len(texts) for i in range(len(family))] == want and want.count(0) > 140


def test_no_rows_to_compare(spark):
    assert S.group_similar(empty(spark)).count() == 0
    assert S.drop_near_duplicates(empty(spark)).count() == 0


def variants(rng, n, words, changed):
    """Texts from one template that differ from it in so many words, each in two copies that differ in one word."""
    first = " ".join(f"w{rng.randrange(3000)}" for _ in range(words))
    out = []
    for _ in range(n):
        at = set(rng.sample(range(words), changed))
        text = " ".join(f"new{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(first.split()))
        out += [text, text + " end"]
    return out


def exact_components(texts, similarity=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_variants_of_one_template_do_not_grow_together(spark):
    texts = variants(random.Random(4), 150, 300, 5)
    want = exact_components(texts)
    assert len(set(want)) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    assert all(want[got[i]] == want[i] for i in range(len(texts)))


def test_groups_are_those_of_all_similar_pairs(spark):
    rng = random.Random(11)
    texts = variants(rng, 120, 300, 5)
    for n in (1, 3, 5, 7, 9, 14, 20, 28):  # short texts, at and beside the similarity asked
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
        texts += [base, base + " end", base + " one more", base.upper()]
    boiler = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    texts += [boiler + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    want = exact_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_frequent_fingerprints_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "MANY", 4)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    texts = [base] * 90 + [None, "", "  "] * 20 + [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(40)] + [edited(rng, base, 0.004) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(list(range(len(texts))), [plain_fingerprint(t) for t in texts])
    alike = {r.doc_id: r.component_id for r in S.group_similar(docs.where("trim(text) <> ''")).collect()}
    some = [i for i, t in enumerate(texts) if t and t.strip()]
    want = exact_components([texts[i] for i in some])
    assert [alike[i] for i in some] == [some[w] for w in want]


def test_one_row_of_each_group_stays_with_columns_of_any_name(spark):
    docs = with_clashes(documents(spark))
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert clashes_kept(rows) and all(r._n_words == 7 for r in rows if r.doc_id is not None)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (5, text, "b"), (5, text + " end", "c"), (6, text, "d"), (None, text, "e"), (None, "w " + text.upper(), "f"), (5, "other words of the same number", "g")]
    none = [(None, text[::-1], "h"), (None, text[::-1] + " z", "i"), (None, text[::-1], "j"), (None, None, "k"), (None, "", "l"), (None, None, "m")]
    out = S.drop_near_duplicates(spark.createDataFrame(rows + none, "doc_id long, text string, id string")).collect()
    assert len(out) == 6 and sum(r.doc_id == 5 and r.text.startswith("w0") for r in out) == 1
    assert {r.id for r in out} >= {"g", "k", "l", "m"} and sum(r.id in "hij" for r in out) == 1


def test_sieve_keeps_every_text_with_a_partner(spark):
    rng = random.Random(21)
    texts = []
    for n in [*range(1, 40), *(rng.randrange(40, 400) for _ in range(80))]:
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
        words, at = base.split(), rng.randrange(n)
        texts += [base, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])), " ".join(words[: max(1, n * 17 // 20)]), " ".join([*words[:at], "put in", *words[at:]]), base.upper()]
    texts += [f"w{i} " * 3 + "a common end of all these " + " ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for i in range(90)] + [None, "", " "]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7).cache()
    ids = S.shingle_sets(docs.withColumn("text_hash", S.F.xxhash64("text")), 5, ("text_hash",), ("id", "n"))
    got = {r.text for r in S.comparable_texts(docs, ids, 0.8, 5).collect()}
    some = sorted({t for t in texts if t and t.strip()})
    sets = [shingles(t) for t in some]
    partners = set()
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x != sets[j] and common >= 0.8 * (len(x) + len(sets[j]) - common):
                partners |= {some[i], some[j]}
    assert partners <= got and len(partners) > 200
    assert sum("common end" in t for t in got) == 0 and len(got) < len(some) - 90


def test_shingles_of_texts_without_a_partner_are_not_all_shuffled(spark, monkeypatch):
    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) + " with the same eight words at its end" for _ in range(200)]
    texts += [t + " more" for t in texts[:5]] + [texts[9].upper()]
    asked, whole = [], S.comparable_sets

    def comparable_sets(sets, similarity, total):
        asked.append(total)
        return whole(sets, similarity, total)

    monkeypatch.setattr(S, "comparable_sets", comparable_sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == exact_components(texts)
    assert 0 < asked[0] <= sum(len(shingles(t)) for t in texts) / 10
