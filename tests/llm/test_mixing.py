"""Mixing: targets, the knapsack and whole results."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sparkfolio.llm import mixing
from sparkfolio.llm.mixing import fill, mix_sources, targets


def test_targets():
    assert targets([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    got = targets([1, 100, 100], [1, 2, 3], 3)
    assert got[0] == 3 and sum(got) == pytest.approx(201) and got[2] / got[1] == pytest.approx(1.5)
    assert targets([0, 0], [1, 2], 3) == [0, 0] and targets([], [], 3) == []


def reshared(sizes, weights, most):
    """Shares by weight in exact numbers: whoever is above its limit stops there, and the others share again, until none is."""
    stopped = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in stopped]
        budget, weight = sum(sizes) - sum(stopped.values()), sum(weights[i] for i in rest)
        share = {i: Fraction(budget * weights[i], weight) for i in rest}
        above = [i for i in rest if share[i] > most * sizes[i]]
        if not above:
            return [float(stopped.get(i, share.get(i))) for i in range(len(sizes))]
        stopped |= {i: most * sizes[i] for i in above}


def test_targets_against_resharing():
    r = random.Random(6)
    for _ in range(500):
        sizes = [r.choice([0, 1, r.randint(0, 50), r.randint(0, 10**9)]) for _ in range(r.randint(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        assert targets(sizes, weights, 3) == pytest.approx(reshared(sizes, weights, 3), rel=1e-9, abs=1e-6), sizes


def test_fill_is_best():
    r = random.Random(4)
    for _ in range(200):
        sizes = np.array(sorted(r.sample(range(1, 40), r.randint(1, 6))))
        counts = np.array([r.randint(1, 5) for _ in sizes])
        budget = r.randint(0, int((sizes * counts).sum()) + 5)
        take = fill(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (take * sizes).sum() <= max(budget, 0)
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {a + k * s for a in sums for k in range(c + 1)}
        assert (take * sizes).sum() == max(a for a in sums if a <= budget)
    assert (fill(np.array([7, 1000]), np.array([10**6, 10**6]), 123_456_789) * np.array([7, 1000])).sum() == 123_456_789


@pytest.mark.parametrize("split", [4096, 7])
def test_mix(spark, monkeypatch, split):
    monkeypatch.setattr(mixing, "SPLIT", split)
    r = random.Random(9)
    docs = [(d, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 5, 5, 5, r.randint(1, 60)]))), r.choice(["b", "a", "Z", "é", None, "tiny"] if d < 5 else ["b", "a", "Z", "é", None])) for d in range(700)]
    docs += [(701, None, "a"), (702, "", "a"), (703, "\t x\x0by\x0cz\r\n", "b"), (704, docs[3][1], "a"), (704, docs[3][1], "a"), (705, None, "void")]
    df = spark.createDataFrame([(d, t, s, 1.0) for d, t, s in docs], "doc_id long, text string, source string, target double").repartition(5)
    rows = mix_sources(df).collect()
    again = mix_sources(df.repartition(2)).collect()
    key = lambda x: (x.doc_id, str(x.source), x.size, x.source_size, round(x.target, 6), x.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in docs if s is not None}) + [None]
    totals = [sum(size(t) for _, t, s in docs if s == n) for n in names]
    want = dict(zip(names, reshared(totals, [1 + i % 3 for i in range(len(names))], 3)))
    for n, total in zip(names, totals):
        mine = [x for x in rows if x.source == n]
        assert {x.source_size for x in mine} == {total} and mine[0].target == pytest.approx(want[n])
        assert abs(sum(x.taken for x in mine) - want[n]) <= 1 + 0.001 * total
        assert all(x.size == 0 or x.taken % x.size == 0 and x.taken <= 3 * x.size for x in mine)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_drawn_documents(spark):
    """Repeated rows, ids of several texts and columns named like the mix's: as many rows as are taken, none doubled."""
    r = random.Random(2)
    docs = [(d, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 9))), r.choice(["a", "b", None])) for d in range(120)]
    docs += [docs[3]] * 3 + [(7, "x y z", "a"), (7, "x y z", "b"), (7, None, "a"), (8, docs[8][1], docs[8][2])]
    df = spark.createDataFrame([(d, t, s, "mine", 5) for d, t, s in docs], "doc_id long, text string, source string, size string, taken int").repartition(4)
    got = mixing.drawn_documents(df).collect()
    mixed = mix_sources(df).collect()
    assert sorted((x.doc_id, x.mix_size, x.mix_taken) for x in got) == sorted((x.doc_id, x.size, x.taken) for x in mixed if x.taken)
    assert all(x["size"] == "mine" and x["taken"] == 5 and x.mix_size == len(x.text.split()) and (x.doc_id, x.text, x.source) in docs for x in got)
    assert mixing.drawn_documents(df.limit(0)).count() == 0
