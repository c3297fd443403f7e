"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased and everything that is no letter becomes a space. N-grams of one to three characters are
hashed to FEATURES places; the term frequency is relative to the text's n-grams, so a text's score is a sum over its
positions divided by their number and whole texts of any length cost linear time and constant memory: a text over PIECE
bytes is summed up in pieces, each with the ORDERS - 1 characters that follow it. Document frequencies come from all
labelled documents; the weights are fitted with follow-the-regularised-leader and an elastic-net penalty on a bounded
sample (per_language documents of each language, those with the least hash, and of each at most `chars` characters from a
place that the hash picks), and a temperature is fitted on a fifth of that sample.

Defined results: null text, or text without a letter: `und` with score 0; equal texts get equal predictions; without
any labelled row every text is `und`; labels are only ever read for learning; a row without id is predicted, not learnt
from, and in no held-out fold; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import slices, small_batches, tidy

BITS = 15
FEATURES = 1 << BITS
ORDERS = 3
UNKNOWN = "und"
#: Longest text, in bytes, that is scored at once.
PIECE = 2_000_000
#: Term frequencies are multiplied by this, so that learning rates suit them.
SCALE = 60.0


def _letters() -> np.ndarray:
    """For each code point below 65536: its lower case, or a space if it is no letter."""
    table = np.full(65536, 32, dtype=np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_tables: dict[str, np.ndarray] = {}


def grams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Feature of the n-gram that begins at each character, for each order; each text's first character, its number of
    characters, and whether it has a letter. Grams run over a text's end into two spaces, never into the next text."""
    if not _tables:
        _tables["letters"] = _letters()
    blob = b"\n\n".join(texts) + b"\n\n"
    data = np.frombuffer(blob, dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = chars[np.concatenate(([0], ends[:-1]))]
    count = chars[ends] - begin - 2
    c = np.frombuffer(blob.decode().encode("utf-32-le"), dtype=np.uint32)
    high = c >= 65536
    low = _tables["letters"][np.where(high, 0, c)]
    if high.any():
        low[high] = [x if chr(x).isalpha() else 32 for x in c[high].tolist()]
    letter = np.concatenate(([0], np.cumsum(low != 32)))
    h, out = low * np.uint32(2654435761), []
    for k in range(ORDERS):
        if k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + low[k:] * np.uint32(3266489917)
        f = h ^ (h >> np.uint32(16))
        out.append((f * np.uint32(668265263)) >> np.uint32(32 - BITS))
    return out, begin, count, letter[begin + count] > letter[begin]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, with IDF and SCALE, divided by the temperature
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not texts:
            return names, score
        if len(texts) == 1 and len(texts[0]) > PIECE:
            return self._long(texts[0])
        total, count, some = self._sums(texts)
        if not len(some):
            return names, score
        best, p = self._decided(total, count)
        for i, b in zip(some.tolist(), best.tolist()):
            names[i] = self.languages[b]
        score[some] = p
        return names, score

    def _sums(self, texts: list[bytes], every: bool = False, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of weights and numbers of characters of the texts with a letter (or of all), and which these are. after:
        characters at the end of each text that only complete the n-grams before them."""
        by_order, begin, count, has = grams(texts)
        count = count - after
        some = np.flatnonzero(has | every & (count > 0))
        edges = np.stack((begin[some], begin[some] + count[some]), axis=1).ravel()
        total = np.zeros((len(some), len(self.languages)))
        for k, f in enumerate(by_order if len(some) else ()):
            for j in range(len(self.languages)):
                w = self.weights[:, j][f]
                total[:, j] += np.add.reduceat(w, np.minimum(edges, len(w) - 1), dtype=np.float64)[::2]
        return total, count[some], some

    def _decided(self, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logits = total / (ORDERS * count)[:, None] + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]

    def _long(self, text: bytes) -> tuple[list[str], np.ndarray]:
        """One long text in pieces, with the n-grams of the whole."""
        total, count, letters = np.zeros((1, len(self.languages))), np.zeros(1), False
        begin = 0
        while begin < len(text):
            end = _whole(text, begin + PIECE)
            beyond, after = end, 0
            while after < ORDERS - 1 and beyond < len(text):
                beyond, after = _whole(text, beyond + 1), after + 1
            t, n, _ = self._sums([text[begin:beyond]], every=True, after=after)
            letters = letters or bool(grams([text[begin:end]])[3][0])
            total, count, begin = total + t.sum(axis=0), count + n.sum(), end
        if not letters:
            return [UNKNOWN], np.zeros(1)
        best, p = self._decided(total, count)
        return [self.languages[best[0]]], p


def _whole(text: bytes, at: int) -> int:
    """The first place from `at` on that begins a character, or the end."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def _features(texts: list[bytes], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    by_order, begin, count, _ = grams(texts)
    out = []
    for b, n in zip(begin.tolist(), count.tolist()):
        f, tf = np.unique(np.concatenate([g[b : b + n] for g in by_order]), return_counts=True)
        out.append((f, tf / (ORDERS * n) * idf[f] * SCALE))
    return out


def fit(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """FTRL-proximal over pieces of the texts (whole, and cut to a few lengths), then the temperature on a fifth."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0))
    r = np.random.default_rng(seed)
    pieces: list[tuple[bytes, int, bool]] = []
    for i, (t, label) in enumerate(zip(texts, labels)):
        for n in (len(t), 20, 80, 300):
            at = int(r.integers(0, max(1, len(t) - n + 1)))
            piece = t[at : at + n]
            if any(map(str.isalpha, piece)):
                pieces.append((piece.encode(), languages.index(label), i % 5 == 4))
    x = [f for k in range(0, len(pieces), 500) for f in _features([p[0] for p in pieces[k : k + 500]], idf)]
    y = [p[1] for p in pieces]
    train = [i for i, p in enumerate(pieces) if not p[2]]
    held = [i for i, p in enumerate(pieces) if p[2]] or train
    many = len(languages)
    z, n = np.zeros((FEATURES + 1, many)), np.zeros((FEATURES + 1, many))

    def weights(f):
        a, b = z[f], n[f]
        return np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(b)) / alpha + l2))

    for _ in range(epochs):
        for i in r.permutation(train).tolist():
            f, v = np.append(x[i][0], FEATURES), np.append(x[i][1], 1.0)
            w = weights(f)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            g2 = g * g
            old = n[f]
            z[f] += g - (np.sqrt(old + g2) - np.sqrt(old)) / alpha * w
            n[f] = old + g2
    w = weights(slice(None))
    scores = np.array([x[i][1] @ w[x[i][0]] + w[FEATURES] for i in held])
    truth = np.array([y[i] for i in held])

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    t = min((float(t) for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121))), key=loss)
    return Model(languages, np.asfortranarray((w[:FEATURES] * idf[:, None] * SCALE / t).astype(np.float32)), w[FEATURES] / t)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows (doc_id, text): documents with each feature, and documents. Each task sends one row a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for _, texts in slices(batches):
            by_order, begin, count, _ = grams(texts)
            for b, n in zip(begin.tolist(), count.tolist()):
                seen = np.zeros(FEATURES, dtype=bool)
                for g in by_order:
                    seen[g[b : b + n]] = True
                total[:FEATURES] += seen
            rows += len(texts)
        total[FEATURES] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["feature", "n"])

    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, n in small_batches(docs).mapInArrow(tidy(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows at most
        out[feature] = n
    return out[:FEATURES], int(out[FEATURES])


def learnt(labelled: DataFrame, per_language: int = 800, chars: int = 20_000) -> Model:
    """labelled: doc_id, text, lang; rows with a null are left out. per_language bounds the rows used to fit weights, and
    chars what is used of each, so the driver gets languages x per_language x chars characters at most."""
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    df, n = document_frequencies(labelled.select("doc_id", "text"))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    # about four times the wanted rows of each language pass by their hash, so none meets whole in one task
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bounds = [F.lit(x) for r in labelled.groupBy("lang").count().collect() for x in (r["lang"], int(min(1.0, 4 * per_language / r["count"]) * (1 << 40)))]  # one row a language
    few = labelled.select("doc_id", "lang", place.alias("place")).where(F.col("place") < F.try_element_at(F.create_map(*bounds), F.col("lang"))) if bounds else labelled.select("doc_id", "lang", place.alias("place"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    ids = [x[0] for x in few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id").collect()]
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    rows = labelled.where(F.col("doc_id").isin(ids)).select("doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(chars)).alias("text"), "lang").collect() if ids else []
    rows.sort(key=lambda x: (zlib.crc32(str(x.doc_id).encode()), x.doc_id, x.lang, x.text))
    return fit([x.text for x in rows], [x.lang for x in rows], idf)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of documents (doc_id, text)."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, score = held.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of documents, with all their columns, whose language is identified with a score of `least` or more."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, score = held.value.predict(texts)
            yield batch.filter(pa.array([n != UNKNOWN for n in names]) if least <= 0 else pa.array((np.array(names) != UNKNOWN) & (score >= least)))

    return small_batches(documents).mapInArrow(tidy(run), documents.schema)


def is_held_out(doc_id="doc_id"):
    """The fold that is never learnt from; a row without id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(documents: DataFrame, per_language: int = 800) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold and predicts every row."""
    model = learnt(documents.where(~is_held_out()).select("doc_id", "text", "lang"), per_language)
    return identify(documents, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
