"""Line dedup against brute force and the SQL oracle's form."""

from collections import Counter

from sparkfolio.llm.line_dedup import drop_boilerplate


def brute(rows, ratio, least):
    pages, on = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        for x in {x.rstrip(" \t\r") for x in (t or "").split("\n")} - {""}:
            on[h, x] += 1
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.rstrip(" \t\r")) not in bad)) for d, h, t in rows]


def test_against_brute_force(spark):
    rows = []
    for d in range(300):
        host = [None, "a", "b", "hot", "hot"][d % 5]
        lines = [f"own {d}", "menu \t" if d % 2 else "menu", "", "rare" if d % 60 == 0 else f"x{d % 7}", "menu"]
        rows.append((d, host, "\n".join(lines) + ("\n" if d % 3 else "")))
    rows += [(900, "tiny", "menu\nmenu"), (901, "tiny", "menu"), (902, "a", None), (903, "a", ""), (904, "a", "menu"), (904, "a", "menu"), (905, "a", "\n\n"), (906, "b", "z\n" * 20000)]
    df = spark.createDataFrame([(d, h, t, "keep", 1) for d, h, t in rows], "doc_id long, source string, text string, `__host` string, lines int")
    for ratio, least in ((0.02, 5), (0.3, 3), (0.9, 1)):
        got = drop_boilerplate(df, max_ratio=ratio, min_pages=least)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, ratio, least), key=str)
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_lists_too_large_to_send(spark, monkeypatch):
    from sparkfolio.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    test_against_brute_force(spark)
