"""Word and byte repeats against brute force."""

import hashlib
import random

import pytest

from sparkfolio.llm.substring_recompression import remove_repeated_words
from sparkfolio.llm.suffix_bpr import remove_repeated_bytes


def brute(docs, window, split, glue):
    seen = {}
    for d, t in docs:
        u = split(t)
        for p in range(len(u) - window + 1):
            k = tuple(u[p : p + window])
            seen[k] = min(seen.get(k, d), d)
    out = {}
    for d, t in docs:
        u = split(t)
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if seen[tuple(u[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        kept = glue([x for x, g in zip(u, gone) if not g])
        out.setdefault(d, []).append((len(u), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def words(t):
    return (t or "").encode().split()


def octets(t):
    return list((t or "").encode())


def corpus(seed, n=60, vocabulary=40):
    r = random.Random(seed)
    pieces = [[r.choice("abcdefghijklmnop") * r.randint(1, 3) + str(r.randrange(vocabulary)) for _ in range(r.randint(40, 90))] for _ in range(12)]
    pieces += [["x"] * 70, ["x"] * 120, ["p", "q"] * 60, ["éa", "b", "c"] * 40]
    docs = []
    for d in range(n):
        t = []
        for _ in range(r.randint(0, 4)):
            t += r.choice(pieces)[r.randint(0, 12) :]
            t += [str(r.randrange(10**6)) for _ in range(r.randint(0, 5))]
            if t and r.random() < 0.3:
                t[r.randrange(len(t))] = "edit"
        docs.append((d, r.choice([" ", "  ", "\n", "\t"]).join(t)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, docs[0][1]), (n + 4, docs[1][1]), (n + 4, docs[1][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 7, "h") for d, t in docs], "doc_id long, text string, bucket int, told string").repartition(3)
    got = {}
    for r in remove_repeated_words(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    want = {d: [(a, b, c) for a, b, _, c in v] for d, v in brute(docs, 50, words, b" ".join).items()}
    assert {d: sorted(v) for d, v in got.items()} == want
    assert sum(v[0][1] for v in want.values()) > 500


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, seed):
    docs = corpus(seed, n=40)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {}
    for r in remove_repeated_bytes(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == brute(docs, 50, octets, bytes)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_words(df).count() == 0
    assert remove_repeated_bytes(df).count() == 0


def test_no_id(spark):
    text = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(None, text), (3, text), (5, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_words(df).collect()) == [(0, 0), (3, 0), (5, 80)]


def test_suffix_classes():
    """The order of bucket pointers is that of the suffixes cut to the window, and equal ones share a pointer."""
    import numpy as np

    from sparkfolio.llm.suffix_bpr import suffix_classes

    r = random.Random(3)
    for _ in range(60):
        n, window = r.randint(60, 300), r.randint(1, 59)
        text = bytes(r.choice(b"ab") for _ in range(n // 2))
        text += text[: n // 3] if r.random() < 0.5 else b"a" * (n // 2)
        places = np.arange(len(text) - window + 1) if len(text) >= window else np.zeros(0, np.int64)
        pointers = suffix_classes(np.frombuffer(text, np.uint8), places, window).tolist()
        cut = [text[p : p + window] for p in places]
        order = sorted(range(len(cut)), key=cut.__getitem__)
        for a, b in zip(order, order[1:]):
            assert pointers[a] <= pointers[b] and (pointers[a] == pointers[b]) == (cut[a] == cut[b])


@pytest.mark.parametrize("many", [True, False])
def test_a_very_common_phrase(spark, monkeypatch, many):
    """A phrase shorter than a window in very many surroundings, some of them repeated: dealt by windows, or (where too
    many samples are like that to tell) all samples are."""
    from sparkfolio.llm import _repeats

    if not many:
        monkeypatch.setattr(_repeats, "HOT_MOST", -1)
    r = random.Random(8)
    around = ["".join(r.choice("abcdefgh ") for _ in range(45)) for _ in range(60)]
    docs = [(d, "".join(r.choice(around) + "a very common phrase of text " + r.choice(around) for _ in range(r.randint(1, 3)))) for d in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, 50, octets, bytes)
    rows = remove_repeated_bytes(df).collect()
    got = {}
    for x in rows:
        got.setdefault(x.doc_id, []).append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == want
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in rows)
    assert all(x.kept is None for x in remove_repeated_bytes(df, keep=False).collect())


def test_word_windows_and_symbols():
    """Equal windows, and only they, have one name, and equal windows have one sample: runs, few words and many."""
    from sparkfolio.llm.substring_recompression import word_units

    r = random.Random(5)
    for _ in range(60):
        vocabulary, window = r.choice([2, 3, 30, 1000]), r.choice([1, 2, 3, 5, 8, 13, 50, 50, 100])
        pool = [[b"w%d" % r.randrange(vocabulary) for _ in range(r.randint(0, 160))] for _ in range(6)] + [[b"x"] * r.randint(0, 200)]
        texts = [b" ".join(w for _ in range(r.randint(0, 3)) for w in r.choice(pool)[r.randint(0, 5) :]) for _ in range(12)]
        u = word_units(window)(texts)
        name, content, sample = {}, {}, {}
        for k, text in enumerate(texts):
            words_ = text.split()
            assert u.count[k] == len(words_)
            for i in range(len(words_) - window + 1):
                key, at = tuple(words_[i : i + window]), u.begin[k] + i
                assert name.setdefault(key, u.names[at]) == u.names[at]
                assert content.setdefault(u.names[at], key) == key
                assert sample.setdefault(key, u.samples[at]) == u.samples[at]
