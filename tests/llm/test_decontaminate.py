"""Benchmark decontamination on planted passages and paraphrases."""

import random

from sparkfolio.llm.decontaminate import common_subsequence, decontaminated, leaks


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert common_subsequence(a, b) == longest(a, b)


def planted():
    r = random.Random(7)
    words = [f"{''.join(r.choice('abcdefghij') for _ in range(r.randint(3, 8)))}" for _ in range(20000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(words) for _ in range(n)]
    items = [(i, text(r.randint(12, 60))) for i in range(40)] + [(40, ["exact", "short", "item"])]
    docs, truth = [], set()
    for d in range(500):
        t = text(r.choice([5, 30, 200, 900]))
        if d % 5 == 0:
            i, item = items[r.randrange(len(items))]
            item = list(item)
            if d % 10 == 0 and len(item) > 20:  # a paraphrase: a few words changed, one lost
                for k in r.sample(range(len(item)), len(item) // 8):
                    item[k] = r.choice(words)
                del item[3]
            at = r.randint(0, len(t))
            t[at:at] = [w.upper() if d % 3 == 0 else w + "," if d % 3 == 1 else w for w in item]
            truth.add((d, i))
        docs.append((d, r.choice([" ", "\n"]).join(t)))
    return docs, items, truth


def test_planted(spark):
    docs, items, truth = planted()
    odd = [(None, " ".join(items[0][1])), (9001, None), (9002, ""), (9003, "..."), (9004, " ".join(items[1][1] * 3000)), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, d) for d, t in docs + odd], "doc_id long, text string, item_id long").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in items] + [(100, None, "x"), (101, "", "x"), (None, "a b", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    assert truth | {(9004, 1)} <= got
    assert {d for d, _ in got} == {d for d, _ in truth} | {9004}
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None, 9001, 9002, 9003} | {d for d, _ in docs} - {d for d, _ in truth}


def test_blocks_of_items(spark, monkeypatch):
    from sparkfolio.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    docs, items, truth = planted()
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert truth <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, none).count() == 0
    assert leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_every_word_of_every_document_is_in_the_space(spark):
    import numpy as np

    from sparkfolio.llm.decontaminate import document_frequencies, latent_space, terms_of

    texts = [f"a{d} b{d}" for d in range(41)] + [f"first{d} " + "x " * 70 + f"last{d}" for d in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    terms = terms_of(spark.createDataFrame([(" ".join(texts).replace("x ", ""),)], "text string"))
    df, n = document_frequencies(docs, terms)
    assert (df == 1).all()
    space, values = latent_space(docs, terms, np.log((1 + n) / (1 + df)), 8)
    assert len(values) == 8 and (np.diff(values) <= 0).all()
    assert (np.linalg.norm(space, axis=1) > 0.1).all()


def test_words_that_no_document_holds_hide_no_item(spark):
    r = random.Random(5)
    held = [f"c{i}" for i in range(14)]
    for everywhere in (False, True):  # in half of the documents, or in all
        docs = [(d, " ".join(r.sample(held, 14) if everywhere or d % 2 else ["other", f"o{d}"])) for d in range(60)] + [(60, " ".join(held))]
        item = [*held[:3], "no1", "no2", *held[3:7], "no3", "no4", *held[7:], "no5", "no6"]
        got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        assert [(r.doc_id, r.item_id) for r in got.collect()] == [(60, 1)]


def test_anchors():
    import numpy as np

    from sparkfolio.llm.decontaminate import anchors_of

    term = np.arange(20)
    assert anchors_of(term, np.arange(20) + 1, 0.65) == list(range(8))  # 7 words may be missing
    assert anchors_of(term, np.maximum(np.arange(20) - 4, 0), 0.65) == [5, 6, 7]  # 5 of the 7 are
    assert anchors_of(term, np.maximum(np.arange(20) - 7, 0), 0.65) == []


def passages_matrix(docs, terms, idf):
    """TF-IDF rows of unit length of all passages that follow each other, by plain loops."""
    import numpy as np

    from sparkfolio.llm.decontaminate import PASSAGE, word_names

    out = []
    for _, t in docs:
        names, _ = word_names([t.encode()])
        for k in range(0, len(names), PASSAGE):
            row = np.zeros(terms.size)
            for x in terms.places(names[k : k + PASSAGE])[1]:
                row[x] += idf[x]
            if row.any():
                out.append(row / np.linalg.norm(row))
    return np.array(out)


def test_singular_values_and_vectors_are_those_of_the_whole_matrix(spark):
    """A matrix of rank 12, sketched with 16 columns, must come out as numpy's SVD has it."""
    import numpy as np

    from sparkfolio.llm.decontaminate import document_frequencies, singular, sketch, terms_of

    r = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(4)] for k in range(12)]
    docs = [(d, " ".join(topics[r.randrange(12)] * r.choice([1, 8, 24]))) for d in range(300)] + [(300, ""), (301, "none of them")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    terms = terms_of(spark.createDataFrame([(" ".join(t),) for t in topics], "text string"))
    seen, n = document_frequencies(df, terms)
    idf = np.log((1 + n) / (1 + seen))
    gauss = np.random.default_rng(1).standard_normal((terms.size, 16))
    vectors, values = singular(sketch(df, terms, idf, gauss), gauss)
    whole = passages_matrix(docs, terms, idf)
    _, want, right = np.linalg.svd(whole, full_matrices=False)
    assert len(values) == (want > 1e-3 * want[0]).sum() == 12
    assert np.allclose(values, want[:12], rtol=1e-3)
    assert np.allclose(vectors @ vectors.T, right[:12].T @ right[:12], atol=1e-3)  # the same space


def test_rows_do_not_depend_on_how_documents_are_dealt(spark):
    docs, items, _ = planted()
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = []
    for k, n in enumerate((1, 4, 7)):
        random.Random(k).shuffle(docs)
        rows = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), bench).collect()
        got.append(sorted(tuple(r) for r in rows))
    assert got[0] == got[1] == got[2]


def test_paraphrases_and_long_items(spark):
    """Items with 10, 20 and 25 % of their words changed, as documents of their own and inside others; one item is long."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(6000)]
    items = [[r.choice(words) for _ in range(r.randint(24, 48))] for _ in range(60)] + [[r.choice(words) for _ in range(900)]]
    docs, truth = [(d, " ".join(r.choice(words) for _ in range(r.choice([20, 300])))) for d in range(500)], set()
    for rate in (0.1, 0.2, 0.25):
        for i, item in enumerate(items):
            for inside in (False, True):
                t = list(item)
                for k in r.sample(range(len(t)), int(rate * len(t))):
                    t[k] = r.choice(words)
                if longest(item[-8:], t) < 4:
                    continue
                if inside:
                    t = [r.choice(words) for _ in range(r.randint(1, 200))] + t + [r.choice(words) for _ in range(r.randint(1, 200))]
                truth.add((len(docs), i))
                docs.append((len(docs), " ".join(t)))
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}
    assert len(truth & got) / len(truth) >= 0.95
    assert got <= truth
    assert {d for d, i in truth if i == 60} <= {d for d, _ in got}
