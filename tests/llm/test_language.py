"""Language identification: held-out accuracy and edge cases."""

import random
import zlib

from sparkfolio.llm.language_id import identify_languages, is_held_out

PARTS = {"aa": ["ka", "to", "mi", "the"], "bb": ["ßü", "ör", "sch", "ein"], "cc": ["ño", "ción", "que", "ra"]}


def corpus(n=600):
    r = random.Random(2)
    out = []
    for d in range(n):
        lang = r.choice(list(PARTS))
        out.append((d, " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang if d % 10 else None, lang))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    odd = [(9000, None, "aa"), (9001, "", "aa"), (9002, "123 !? \n", "bb"), (9003, "日本語" * 3, None), (None, "the kato", "aa"), (9004, "katothe " * 40000, "aa")]
    df = spark.createDataFrame([d[:3] for d in docs] + odd, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in identify_languages(df, per_language=60).collect()}
    assert len(rows) == len(docs) + len(odd)
    held = [(rows[d].lang_pred, lang) for d, _, _, lang in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in docs)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [rows[d].lang_pred for d in (9000, 9001, 9002)] == ["und"] * 3
    assert rows[9003].lang_pred in PARTS and rows[9004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_neighbours_do_not_matter(spark):
    docs = corpus(200)
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")
    a = {r.doc_id: r.score for r in identify_languages(df.repartition(1), 50).collect()}
    b = {r.doc_id: r.score for r in identify_languages(df.repartition(7), 50).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify_languages(df).collect()] == ["und"]
    assert identify_languages(df.limit(0)).count() == 0
    assert df.select(is_held_out().alias("x")).count() == 1
