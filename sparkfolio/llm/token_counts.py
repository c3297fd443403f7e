"""Token counts of a byte-level BPE tokenizer with a whole-token shortcut.

Before any text is read, every vocabulary string is given to the tokenizer alone; those that come back as one token are
proven (once for each tokenizer file and process; the vocabulary itself is never kept), and a pre-token that equals one
counts 1 with no merging. Only the other pre-tokens are merged, each distinct one once for as long as the cache (CACHE
entries) of a worker lasts.

Pre-tokens are cut by the tokenizer's pattern, which only asks whether a character is a letter, a number or white space.
Characters that the two libraries class differently (UNPROVEN, by a test over all code points) make their text go to the
tokenizer whole.

Defined results: null or empty text has 0 tokens; special strings inside texts are special tokens (the library's
default) and nothing is added around a text; texts of any length are counted whole; equal rows give equal rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, small_batches, tidy

CACHE = 600_000
#: Longest text, in bytes, that is split at once.
PIECE = 2_000_000
CUT = re.compile(rb"[!-~](?= [!-~])")
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the pattern's library and the tokenizer class differently (fixed values): first and last of each run.
UNPROVEN = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
PROVEN = regex.compile("[^" + "".join(f"{chr(int(x.split('-')[0], 16))}-{chr(int(x.split('-')[-1], 16))}" for x in UNPROVEN.split()) + "]*+")
_proven: dict[tuple[str, float], frozenset[str]] = {}
_counters: dict[str, Counter] = {}


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut before a space that follows a word or sign: no token spans such a place."""
    begin = 0
    while len(text) - begin > PIECE:
        m = CUT.search(text, begin + PIECE)
        if not m:
            break
        yield text[begin : m.start() + 1]
        begin = m.start() + 1
    yield text[begin:]


class Counter:
    """Counts tokens."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        special = [x["content"] for x in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.whole = self.proven() if whole is None else whole
        self.cache = dict.fromkeys(self.whole, 1)

    def proven(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and one token alone."""
        out = []
        for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False)):
            s = self.tokenizer.decode([i], skip_special_tokens=False)
            if s and "�" not in s and self.split(s) == [s]:
                out.append((s, i))
        coded = self.tokenizer.encode_batch([s for s, _ in out], add_special_tokens=False)
        return frozenset(s for (s, i), e in zip(out, coded) if e.ids == [i])

    def merge(self, words: list[str]) -> None:
        ids = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False).word_ids
        counts = np.bincount(np.array(ids, dtype=np.int64), minlength=len(words))
        self.cache.update(zip(words, counts.tolist()))

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and special tokens."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [w for p in parts for w in self.split(p)], len(parts) - 1
        return self.split(text), 0

    def count(self, texts: list[bytes]) -> list[int]:
        out = []
        for long, group in groupby(texts, lambda t: len(t) > PIECE):
            out += [sum(self._count([p])[0] for p in pieces(t)) for t in group] if long else self._count(list(group))
        return out

    def _count(self, texts: list[bytes]) -> list[int]:
        strings = [t.decode() for t in texts]
        cut = [self.pieces(s) if PROVEN.fullmatch(s) else None for s in strings]
        unknown = [w for w in set().union(*(c[0] for c in cut if c)) if w not in self.cache]
        if len(self.cache) > CACHE:
            known = set().union(*(c[0] for c in cut if c))
            self.cache = dict.fromkeys(self.whole, 1)
            unknown = [w for w in known if w not in self.cache]
        if unknown:
            self.merge(unknown)
        one = self.cache.__getitem__
        return [sum(map(one, c[0])) + c[1] if c else len(self.tokenizer.encode(s, add_special_tokens=False).ids) for c, s in zip(cut, strings)]


def whole_tokens(tokenizer: str) -> frozenset[str]:
    """The proven strings of a tokenizer file, found out once."""
    key = (tokenizer, os.path.getmtime(tokenizer))
    if key not in _proven:
        _proven[key] = Counter(tokenizer).whole
    return _proven[key]


def counter(tokenizer: str, whole: frozenset[str]) -> Counter:
    """This worker's counter; it and its cache serve all tasks that the worker runs."""
    if tokenizer not in _counters:
        _counters.clear()
        _counters[tokenizer] = Counter(tokenizer, whole)
    return _counters[tokenizer]


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. tokenizer: a path that every executor has."""
    whole = documents.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(tokenizer, whole.value)
        for batch, texts in slices(batches):
            n = np.array(mine.count(texts), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
