"""Secret spans against a plain scan of the fixed patterns, and the Markov models on labelled strings."""

import base64
import hashlib
import math
import random
import re

from sparkfolio.llm import secret_markov as m

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(x.start(), 0, x.end()) for x in ASSIGN.finditer(text) if len(x[2]) >= 6]
    out += [(x.start(), 1, x.end()) for x in re.finditer(r"AKIA[A-Z0-9]+", text) if len(x[0]) >= 20]
    out += [(x.start(), 2, x.end()) for x in re.finditer(r"[0-9a-f]+", text) if len(x[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{['assign', 'access', 'hex', 'random'][k]}:{a}:{b}" for a, k, b in spans)


def corpus():
    r = random.Random(1)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", " ", ":", "=", "'", '"', "abc", "abcdef", "é", "😀", "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "A" * 15, "deadbeef" * 3, "0a" * 11, "\n", "\t", "-", "."]
    docs = [(d, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for d in range(400)]
    docs += [(900, None), (901, ""), (902, "secret: token: abcdefgh"), (903, "password==abc password = 'abcdef'"), (904, "é😀 token=abcdefg " * 900), (905, "a" * 200_000), (906, docs[3][1]), (906, docs[3][1])]
    return docs


def test_base_spans(spark):
    docs = corpus()
    model = m.train(m.seeded_random(spark, 200).unionByName(spark.createDataFrame([("getElementById", 0), ("user_name", 0)], "sample string, secret int")))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, base int, spans string").repartition(6)
    rows = m.secret_report(df, model).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for row in rows:
        want = base(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), row.doc_id
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, x, _ in want) for k in range(3))
        assert set(listed(want).split(",")) - {""} <= set(row.spans.split(","))
    assert m.secret_report(df.limit(0), model).count() == 0


def test_models_tell_random_from_ordinary(spark):
    r = random.Random(5)
    syllables = ["get", "user", "name", "set", "the", "ing", "tion", "list", "value", "comp", "ute", "er"]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    plain = spark.createDataFrame([(word(r.randint(2, 6)), 0) for _ in range(800)], "sample string, secret int")
    model = m.train(m.seeded_random(spark, 400).unionByName(plain))
    good = [word(7) for _ in range(100)]
    bad = [base64.b64encode(r.randbytes(24)).decode() for _ in range(100)]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(good + bad)], "doc_id long, text string")
    found = {row.doc_id: "random:2:" in row.spans for row in m.secret_report(df, model).collect()}
    assert sum(found[i] for i in range(100)) <= 2 and sum(found[i] for i in range(100, 200)) >= 95


def counted(samples, smoothing=0.5, backoff=4.0):
    """Log-likelihood ratio of each pair of characters, from the samples themselves."""
    pairs, seconds, firsts = ({}, {}), ({}, {}), ({}, {})
    for text, secret in samples:
        for a, b in zip(text, text[1:]):
            for table, key in ((pairs, a + b), (seconds, b), (firsts, a)):
                table[secret][key] = table[secret].get(key, 0) + 1

    def log(secret, a, b):
        own = (smoothing + seconds[secret].get(b, 0)) / (smoothing * len(m.LETTERS) + sum(seconds[secret].values()))
        return math.log((pairs[secret].get(a + b, 0) + backoff * own) / (firsts[secret].get(a, 0) + backoff))

    return {a + b: round(100 * (log(1, a, b) - log(0, a, b))) for a in m.LETTERS for b in m.LETTERS}


def test_random_spans_against_a_plain_sum(spark):
    """The whole list of spans: a run of 16 or more token characters counts where its ratio reaches 14 in sum and half of
    one for each transition; beside fixed patterns, at both ends, after wide characters, among many, null and repeated."""
    r = random.Random(11)
    syllables = ["get", "User", "name", "set", "the", "_", "tion", "list", "2024", "value", "-", "er"]
    mixed = lambda: "".join(r.choice(syllables) for _ in range(r.randint(3, 8)))
    coded = lambda: base64.b64encode(r.randbytes(r.randint(6, 40))).decode()
    samples = [(coded(), 1) for _ in range(150)] + [(mixed(), 0) for _ in range(150)]
    model = m.train(spark.createDataFrame(samples, "sample string, secret int").repartition(4))
    ratio = counted(samples)
    assert [ratio[a + b] for a in m.LETTERS for b in m.LETTERS] == model

    pieces = [lambda: "é😀", lambda: " ", lambda: "\n", lambda: ".", lambda: "token = ", mixed, mixed, coded, coded, lambda: coded()[:15], lambda: mixed() + coded()]
    docs = [(d, "".join(r.choice(pieces)() for _ in range(r.randint(0, 12)))) for d in range(300)]
    docs += [(900, None), (901, ""), (902, docs[7][1]), (902, docs[7][1]), (903, " ".join(coded() + " é " + mixed() for _ in range(700))), (904, coded()), (905, "x" * 100_000)]

    def added(text):
        out = []
        for x in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
            total = sum(ratio[a + b] for a, b in zip(x[0], x[0][1:]))
            if total >= 1400 and total >= 50 * (len(x[0]) - 1):
                out.append((x.start(), 3, x.end()))
        return out

    rows = m.secret_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), model).collect()
    texts = dict(docs)
    assert len(rows) == len(docs)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.spans == listed(sorted(base(text) + added(text))), row.doc_id
    some = [len(added(t or "")) for t in texts.values()]
    assert sum(some) > 500 and 0 in some[:300]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = m.secret_report(df, [0] * m.ALPHABET**2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
