"""SimHash groups and components against brute force."""

import random

import numpy as np
import xxhash

from sparkfolio.llm._components import components
from sparkfolio.llm.simhash_pigeonring import chains_hold, links, simhash_groups


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 30, 200, 400]))] for _ in range(40)]
    docs = []
    for i in range(160):
        t = list(r.choice(base))
        if r.random() < 0.6:
            t[r.randrange(len(t))] = r.choice(words)
        docs.append((i * 3, r.choice([" ", "\n ", "\t"]).join(t).upper() if r.random() < 0.2 else " ".join(t)))
    docs += [(1, None), (2, ""), (4, " \n"), (5, docs[0][1]), (5, docs[0][1]), (7, "Éa b")]
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, key string").repartition(4)
    rows = simhash_groups(df, shingle=4, max_bits=4).collect()
    assert sorted((x.doc_id, x.fingerprint, x.component_id) for x in rows) == sorted((d, f"{prints[d]:016x}", want[d]) for d, _ in docs)


def test_links_lose_nothing(spark):
    r = random.Random(8)
    values = {r.getrandbits(64) for _ in range(300)}
    for v in list(values):
        for _ in range(r.randint(0, 3)):
            for b in r.sample(range(64), r.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
    centre = r.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    values = sorted(values)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    got = [(x.a & (2**64 - 1), x.b & (2**64 - 1)) for x in links(spark.createDataFrame(signed, "fingerprint long"), 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    want = groups(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4])
    assert groups(values, got) == want


def test_chains_never_lose_a_pair():
    r = random.Random(1)
    x = np.array([sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(20000)], dtype=np.uint64)
    assert chains_hold(x, 4).all()


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1000)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(1001, 1000)}


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stars_within_a_task():
    from sparkfolio.llm._components import stars

    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 40)
        edges = [(r.randrange(n) * 7, r.randrange(n) * 7) for _ in range(r.randint(0, 50))]
        a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        node, root = stars(a, b)
        want = groups({x for e in edges for x in e}, edges)
        assert dict(zip(node.tolist(), root.tolist())) == {k: v for k, v in want.items() if k != v}
