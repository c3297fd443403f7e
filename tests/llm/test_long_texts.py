"""Texts that are handled in pieces give what they give whole."""

import random

import numpy as np
import public_tokenizers
import pytest

from sparkfolio.llm import _repeats, language_id, token_counts
from sparkfolio.llm.substring_recompression import _kept, remove_repeated_words, word_reader
from sparkfolio.llm.suffix_bpr import byte_reader, remove_repeated_bytes

from .test_repeats import brute, corpus, octets, words
import sparkfolio.llm.substring_recompression as recompression


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_chunks(kind, monkeypatch):
    """The samples and names of all windows do not depend on the chunks."""
    text = "\n".join(t for _, t in corpus(5) if t).encode()
    reader = word_reader(50) if kind == "words" else byte_reader(50)

    def windows():
        out = {}
        for u, _, _, first in reader.chunks([text], [0]):
            n = int(u.count[0]) - 49
            at = int(u.begin[0])
            out |= {first + i: (u.names[at + i], u.samples[at + i]) for i in range(max(0, n))}
        return out

    whole = windows()
    monkeypatch.setattr(_repeats, "LONG", 1000)
    monkeypatch.setattr(_repeats, "CHUNK", 700)
    assert windows() == whole and len(whole) > 1000


def test_repeats_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "LONG", 300)
    monkeypatch.setattr(_repeats, "CHUNK", 250)
    monkeypatch.setattr(recompression, "LONG", 300)
    docs = corpus(6, n=25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # the settings hold on the driver; workers get them with the reader's own module state, so run the maps here as well
    got = {}
    for r in remove_repeated_words(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == {d: [(a, b, c) for a, b, _, c in v] for d, v in brute(docs, 50, words, b" ".join).items()}
    got = {}
    for r in remove_repeated_bytes(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == brute(docs, 50, octets, bytes)


def test_kept_words(monkeypatch):
    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice(["ab", "é", " ", "\n", "\x0b", " \t"]) for _ in range(r.randint(0, 80))).encode()
        mask = np.array([r.random() < 0.4 for _ in text.split()], dtype=bool)
        for m in (None, mask):
            whole = _kept(text, m)
            with monkeypatch.context() as c:
                c.setattr(recompression, "LONG", -1)
                assert _kept(text, m) == whole


def test_a_really_long_text(spark):
    r = random.Random(4)
    line = " ".join(str(r.randrange(10**9)) for _ in range(300_000))
    df = spark.createDataFrame([(1, line), (2, "start " + line + " end")], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in remove_repeated_words(df).collect()) == [(1, 300_000, 0), (2, 300_002, 300_000)]
    n = len(line)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in remove_repeated_bytes(df).collect()) == [(1, n, 0, 0), (2, n + 10, n, 1)]


def test_tokens_in_pieces(monkeypatch):
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = ["".join(r.choice(["word", " and", "  ", "\n", "é", "!", " <|endoftext|>", "12", "'s"]) for _ in range(500)).encode() for _ in range(10)]
    whole = counter.count(texts)
    monkeypatch.setattr(token_counts, "PIECE", 100)
    assert counter.count(texts) == whole and len(list(token_counts.pieces(texts[0]))) > 5


def test_language_in_pieces(monkeypatch):
    idf = np.ones(language_id.FEATURES)
    model = language_id.fit(["the kato mithe " * 9, "schein örüß ein " * 9] * 6, ["aa", "bb"] * 6, idf)
    text = ("schein örüß ein 12 " * 400).encode()
    name, score = model.predict([text])
    monkeypatch.setattr(language_id, "PIECE", 1000)
    again, close = model.predict([text])
    assert name == again == ["bb"] and abs(score[0] - close[0]) < 1e-9
    assert model.predict([b"1 2 " * 1000])[0] == ["und"]
