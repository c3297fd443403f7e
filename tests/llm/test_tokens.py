"""Token counts against the library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from sparkfolio.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(3)
    pools = ["abc déf", " \n\t\r\x0b\x1c", "0123٣", "!?.'’-", "'s't're", "日本語", "😀👍🏽", "ՙ֋", "  　"]
    out = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "it's  we'll\n\n don't", "hello world"]
    return out + ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 60))) for _ in range(400)]


def test_against_library(spark):
    t = Tokenizer.from_file(PATH)
    docs = list(enumerate(texts()))
    rows = token_counts(spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, n_tokens int"), PATH, limit=20).collect()
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in docs}
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in rows} == {d: (want[d], len((x or "").encode()), want[d] > 20) for d, x in docs}
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_tokens_are_proven():
    c = Counter(PATH)
    assert " the" in c.whole and len(c.whole) > 40000
    some = random.Random(1).sample(sorted(c.whole), 300)
    assert all(len(c.tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_the_two_libraries_class_all_other_characters_alike():
    """Over all code points: a letter goes with a letter, a number with a number, a sign with a sign, and white space with
    none of them, except where UNPROVEN says that this isn't known."""
    import regex

    from sparkfolio.llm.token_counts import PROVEN

    pre = Tokenizer.from_file(PATH).pre_tokenizer
    kinds = [("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), (None, regex.compile(r"\s")), ("!", regex.compile(r"."))]
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        beside = next(k for k, r in kinds if r.match(x))
        same = len(pre.pre_tokenize_str(beside + x)) == 1 if beside else [p for _, p in pre.pre_tokenize_str(f"a{x}  b")] == [(0, 1), (1, 3), (3, 5)]
        assert same == bool(PROVEN.fullmatch(x)), hex(c)


def test_scripts_beyond_latin_take_the_shortcut():
    from sparkfolio.llm.token_counts import PROVEN

    assert all(PROVEN.fullmatch(x) for x in ("日本語のテキスト", "한국어", "😀👍🏽", "ｆｕｌｌ　ｗｉｄｔｈ"))
    assert not PROVEN.fullmatch("a\u0558") and not PROVEN.fullmatch("\U0003d000")
