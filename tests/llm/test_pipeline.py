"""The pipeline's stages on a fixture against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline

from .test_line_dedup import brute as without_boilerplate
from .test_near_copies import shingles
from .test_simhash import groups

PARTS = {"aa": ["ka", "to", "mi", "the"], "bb": ["ßü", "ör", "sch", "ein"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def fixture():
    r = random.Random(4)
    words = {lang: ["".join(r.choice(p) for _ in range(r.randint(1, 6))) + r.choice("abcdefgh") for _ in range(4000)] for lang, p in PARTS.items()}
    items = [" ".join(r.choice(words["aa"]) for _ in range(30)) for _ in range(5)]
    docs = []
    for d in range(400):
        lang = r.choice(["aa", "bb"])
        text = "\n".join(" ".join(r.choice(words[lang]) for _ in range(r.randint(5, 40))) for _ in range(r.randint(1, 6)))
        if d % 11 == 0:
            text = f"menu home\n{text}"
        if d % 17 == 0:
            text += " " + items[d % 5]
        docs.append((d, text, lang, r.choice(["s1", "s2", None, "s3"])))
    docs += [(1000 + k, docs[k][1], docs[k][2], "s1") for k in range(0, 60, 3)]
    for k in range(60, 120, 3):  # near copies of several similarities
        if k % 17 == 0:  # holds a benchmark item, and its copy would be a paraphrase of it
            continue
        t = docs[k][1].split(" ")
        for i in r.sample(range(len(t)), min(len(t), r.choice([1, 1, 2, 5]))):
            t[i] = t[i] if "\n" in t[i] else r.choice(words[docs[k][2]])
        docs.append((1000 + k, " ".join(t), docs[k][2], "s1"))
    docs += [(2000, None, "aa", "s1"), (2001, "", None, "s2"), (2002, "12 34 !!", "bb", "s2"), (5, *docs[5][1:])]
    return [(d, t, lang, s, len(t or ""), "n") for d, t, lang, s in docs], items


def test_stages(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now.collect())
        if k < 4:
            assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [Counter(x.doc_id for x in rows) for rows in kept]
    assert ids[0] == Counter(d[0] for d in docs if re.search(r"[^\W\d_]", d[1] or ""))
    before = [(x.doc_id, x.source, x.text) for x in kept[0]]
    assert sorted(((x.doc_id, x.text) for x in kept[1]), key=str) == sorted(without_boilerplate(before, 0.02, 5), key=str)
    assert all(x.n_chars == len(x.text) for x in kept[1])
    sets = {x.doc_id: shingles(x.text) for x in kept[1]}
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
    root = groups(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert ids[2] == Counter(d for d in sets if root[d] == d) and 20 < len(sets) - len(ids[2])
    clean = Counter(x.doc_id for x in kept[2] if not any(i in x.text for i in items))
    assert ids[3] == clean
    texts = {x.doc_id: x.text for x in kept[3]}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) == 1
    for x in kept[4]:
        assert x.text == texts[x.doc_id] and x.taken % x.size == 0 and x.size == len(x.text.split())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.taken) for x in whole) == sorted((x.doc_id, x.taken) for x in kept[4])
