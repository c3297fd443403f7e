"""Secret scan by character Markov models, in DataFrame functions alone.

Two first-order character models, one of random strings and one of ordinary identifiers, are counted from labelled
samples; a run of token characters is a secret where the log-likelihood ratio of its transitions is high, in sum and on
average. These spans (kind `random`) are added to those of three fixed patterns, which always stay. The model is at most
ALPHABET^2 numbers and enters the plan as one literal.

Defined results: null text is empty and has no spans; positions are code points, end exclusive; each kind's matches are
leftmost and do not overlap, spans of different kinds may; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed patterns: kind, pattern, group whose length counts, least length (fixed values).
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches of the last two kinds, without the ones that fail: a failing match is a whole run, so it hides none.
SHORTCUT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
RANDOM = "random"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
ALPHABET = len(LETTERS)
LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"
#: One of these is in every match of the first kind, in lower case.
WORDS = ("passw", "secret", "token", "api")
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Matches that are handled together when positions are summed up, so that time stays linear in their number.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _literal(values: list[int]) -> Column:
    """A constant array; folded by the optimiser."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _codes(token: Column) -> Column:
    """The place of each character in LETTERS."""
    places = [0] * 128
    for i, c in enumerate(LETTERS):
        places[ord(c)] = i
    table = _literal(places)
    return F.transform(F.split(token, "", -1), lambda c: F.get(table, F.ascii(c)))


def _transitions(token: Column) -> Column:
    codes = _codes(token)
    return F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: a * ALPHABET + b)


def train(samples: DataFrame, smoothing: float = 0.5, backoff: float = 4.0) -> list[int]:
    """samples: sample string (characters of LETTERS), secret int. Hundredths of the log-likelihood ratio of each
    transition; a rare first character backs off to the second one's own frequency."""
    some = samples.where(F.col("sample").rlike(r"^[A-Za-z0-9+/_=-]{2,}$"))
    rows = some.select("secret", F.explode(_transitions(F.col("sample"))).alias("t")).groupBy("secret", "t").count().collect()  # 2 * ALPHABET^2 rows at most
    counts = [[0] * ALPHABET**2, [0] * ALPHABET**2]
    for secret, t, n in rows:
        counts[int(secret != 0)][t] = n
    single = [[smoothing + sum(c[b::ALPHABET]) for b in range(ALPHABET)] for c in counts]
    single = [[x / sum(p) for x in p] for p in single]

    def log(model: int, a: int, b: int) -> float:
        row = counts[model][a * ALPHABET : (a + 1) * ALPHABET]
        return math.log((row[b] + backoff * single[model][b]) / (sum(row) + backoff))

    out = [round(100 * (log(1, a, b) - log(0, a, b))) for a in range(ALPHABET) for b in range(ALPHABET)]
    return out


def seeded_random(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Random strings of the usual encodings, made from a seeded hash: labelled by construction."""
    raw = F.unhex(F.sha2(F.concat(F.lit("seed-"), F.col("id").cast("string")), 256))
    coded = F.regexp_replace(F.base64(raw), "[\r\n]", "")
    forms = F.array(coded, F.translate(coded, "+/=", "-_"), F.regexp_replace(coded, "[+/=]", ""), F.upper(F.regexp_replace(coded, "[+/=]", "")), F.lower(F.hex(raw)))
    return spark.range(rows).select(F.explode(forms).alias("sample"), F.lit(1).alias("secret"))


def ordinary(documents: DataFrame, rows: int = 2000) -> DataFrame:
    """Identifiers without digits, and plain numbers, from a bounded sample: the `rows` documents with the least hash of their id."""
    ids = [r[0] for r in documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows).collect()]
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z_-]{3,}|[0-9]{4,})(?![A-Za-z0-9+/_=-])"), F.lit(0))
    return documents.where(F.col("doc_id").isin(ids)).select(F.explode(words).alias("sample"), F.lit(0).alias("secret"))


def _positions(text: Column, pattern: str, kind: int, keep, first: Column) -> Column:
    """Spans of the matches of pattern for which keep(whole match, its group 2 or itself) holds. first: a cheap test
    that holds for every text with a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    other = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), other.alias("o")), lambda g, m: F.struct(g.alias("gap"), F.length(m["w"]).alias("n"), keep(m["w"], m["o"]).alias("good")))

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + m["gap"]
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + m["n"]).alias("end")))
            return F.struct((begin + m["n"]).alias("at"), F.when(m["good"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(block, start, step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))))

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(first & text.rlike(pattern), F.aggregate(blocks, start, join)["spans"]).otherwise(F.array().cast(SPAN))


def find_secrets(documents: DataFrame, model: list[int], total: float = 14.0, mean: float = 0.5) -> DataFrame:
    """Per row: doc_id, base and spans (arrays of start, kind, end; kinds by their place in KINDS, then random)."""
    text = F.col("text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("run", text.rlike(RUN)).withColumn("low", F.lower("text"))
    named = F.lit(False)
    for word in WORDS:
        named = named | F.contains(F.col("low"), F.lit(word))

    def long_enough(n: int):
        return lambda w, o: F.length(o) >= n

    firsts = {"assign": named, "access": F.contains(text, F.lit("AKIA")), "hex": F.col("run")}
    base = [_positions(text, SHORTCUT.get(name, pattern), k, long_enough(n), firsts[name]) for k, (name, pattern, _, n) in enumerate(KINDS)]
    table = _literal(model)

    def random(w: Column, _: Column) -> Column:
        ratio = F.aggregate(_transitions(w), F.lit(0), lambda a, t: a + F.get(table, t))
        return (ratio >= int(100 * total)) & (ratio >= int(100 * mean) * (F.length(w) - 1))

    found = docs.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), _positions(text, CANDIDATE, len(KINDS), random, F.col("run")).alias("added"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame, model: list[int]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{name[0]}") for k, name in enumerate(KINDS)]
    return find_secrets(documents, model).select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def trained_on(documents: DataFrame) -> list[int]:
    """The model of the seeded random strings against the identifiers of documents."""
    return train(seeded_random(documents.sparkSession).unionByName(ordinary(documents)))
