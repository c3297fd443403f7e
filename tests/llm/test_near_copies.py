"""Near copies at five words and similarity 0.8 against exact similarities."""

import random

import numpy as np

from sparkfolio.llm import near_copies
from sparkfolio.llm.near_copies import _keys, budget, chains, near_groups, one_of_each


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus(families=60, copies=4):
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for f in range(families):
        base = [r.choice(words) for _ in range(r.choice([60, 200, 600]))]
        for c in range(copies):
            t = list(base)
            for _ in range(0 if c == 0 else r.randint(1, max(1, len(t) // 90))):
                t[r.randrange(len(t))] = r.choice(words)
            docs.append((f * 100 + c, " ".join(t)))
    return docs


def test_copies_are_found_and_others_left(spark):
    docs = corpus()
    truth = [(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[i + 1 : i + 4] if a // 100 == b // 100 and jaccard(x, y) >= 0.8]
    assert len(truth) > 200
    df = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(99_000, None, "x"), (99_001, "", "x"), (99_002, "one", "x"), (None, docs[0][1], "x")], "doc_id long, text string, least string").repartition(4)
    root = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    assert len(root) == len(docs) + 3 and all(root[d] == d for d in (99_000, 99_001, 99_002))  # texts without words are no copies
    assert sum(root[a] == root[b] for a, b in truth) / len(truth) > 0.97
    assert all(root[d] // 100 == d // 100 for d, _ in docs)
    kept = one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", *(str(d) for d, c in root.items() if d == c)]) and kept[0].least == "x"


def variants(r, base, words, rates):
    out = []
    for rate in rates:
        t = list(base)
        for k in r.sample(range(len(t)), int(len(t) * rate)):
            t[k] = r.choice(words)
        out.append(" ".join(t))
    return out


def test_the_stage_against_exact_similarities(spark):
    """Pairs of every similarity: those of 0.8 and over lose a side, none below does."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for f in range(400):
        base = [r.choice(words) for _ in range(r.choice([80, 200, 500]))]
        docs += [(2 * f, " ".join(base)), (2 * f + 1, variants(r, base, words, [r.uniform(0.005, 0.08)])[0])]
    likeness = {f: jaccard(docs[2 * f][1], docs[2 * f + 1][1]) for f in range(400)}
    high = {f for f, j in likeness.items() if j >= 0.8}
    assert min(len(high), 400 - len(high)) > 50 and sum(0.7 < j < 0.8 for j in likeness.values()) > 30
    kept = {x.doc_id for x in one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert all(2 * f in kept for f in range(400))
    gone = {f for f in range(400) if 2 * f + 1 not in kept}
    assert gone <= high and len(gone) / len(high) >= 0.95


def test_ids_that_several_texts_share(spark):
    """Ids 2, 5, 5 (another text) and 9, where the first text of 5 is a copy of 2's: only that row goes; and repeated rows."""
    r = random.Random(3)
    a, b, c = (" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(3))
    rows = [(2, a), (5, a + " end"), (5, b), (9, c), (9, c), (11, b), (5, ""), (None, a), (12, None), (2, c + " x")]
    kept = one_of_each(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, root string, fingerprint int").repartition(3))
    assert kept.columns == ["doc_id", "text", "root", "fingerprint"]
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    # of c's group (9, 9 and 2's second text) the row of the least id stays
    assert got == sorted([(2, a), (2, c + " x"), (5, b), (5, ""), (None, a), (12, None)], key=str)


def test_chains_of_segments_lose_nothing():
    r = np.random.default_rng(5)
    one = r.integers(0, 2**63, 8, dtype=np.uint64)
    for most in (0, 20, 98):
        others = np.array([one ^ np.packbits(np.arange(512)[None].repeat(8, 0)[0] < 0).view(np.uint64) for _ in range(1)] + [one ^ np.packbits(r.permutation(512) < r.integers(0, 2 * most + 2)).view(np.uint64) for _ in range(400)])
        want = np.flatnonzero(np.bitwise_count(others ^ one).sum(axis=1) <= most)
        assert (near_copies._linked(one, others, most) == want).all() and len(want)


def test_connected_groups_are_verified_in_blocks(spark, monkeypatch):
    docs = corpus(families=4, copies=60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    monkeypatch.setattr(near_copies, "SETS", 30_000)
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want


def test_blocks_and_large_groups(spark, monkeypatch):
    docs = corpus(families=3, copies=120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    monkeypatch.setattr(near_copies, "GROUP", 25)
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == [1, 3]
    assert one_of_each(df.limit(0)).count() == 0


def test_numbers():
    assert budget(1.0) == 0 and 77 < budget(0.8) < 105
    assert chains(1000, 0.8)[0] == 14 and chains(10**9, 0.8)[0] == 26
    r = np.random.default_rng(1)
    bits, starts = chains(10**5, 0.8)
    hit = 0
    for _ in range(300):
        same = np.concatenate([r.random(512) > 0.151] * 2)
        hit += any(same[p : p + bits].all() for p in (np.arange(starts) * 512) // starts)
    assert hit / 300 > 0.96


def shared(count, differing, pairs=1000):
    """Share of pairs of fingerprints with so many differing bits that have a chain in common."""
    r = np.random.default_rng(count)
    one = r.integers(0, 2, (pairs, 512), dtype=np.uint8)
    other = one ^ (r.random((pairs, 512)).argsort(axis=1) < differing)
    bits, starts = chains(count, 0.8)
    a, b = (_keys(np.packbits(x.astype(np.uint8), axis=1).view(np.uint64), bits, starts) for x in (one, other))
    return (a == b).any(axis=1).mean()


def test_recall_is_the_same_at_every_count():
    for count in (10**3, 200_000, 12 * 10**6, 120 * 10**6, 10**9):
        assert shared(count, budget(0.8)) > 0.95, count  # 1 - MISS, and three standard deviations
        assert shared(count, 78) > 0.99, count  # the mean at similarity 0.8


def test_rounds(spark, monkeypatch):
    df = spark.createDataFrame(corpus(families=10), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    monkeypatch.setattr(near_copies, "ROUND", 30)
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want


def test_rounds_bound_what_is_common():
    from sparkfolio.llm.near_copies import GROUP, HOT, ROUND, _rounds

    for count in (10, 10**6, 10**9, 3 * 10**10, 10**11):
        rounds = _rounds(count, 200)
        assert sorted({c for a, b, *_ in rounds for c in range(a, b)}) == list(range(200))
        assert all(b - a <= ROUND and count * (b - a) / parts <= HOT * GROUP * 1.01 or b - a == 1 and count / parts <= HOT * GROUP for a, b, _, parts in rounds)


def test_parts_of_values(spark, monkeypatch):
    df = spark.createDataFrame(corpus(families=10), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    monkeypatch.setattr(near_copies, "_rounds", lambda count, starts: [(0, starts, p, 3) for p in range(3)])
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want
