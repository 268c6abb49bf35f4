"""Collocations against a count of every phrase, transducers against dictionaries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelwalk.llm import collocations
from panelwalk.llm.collocations import Transducer

from .test_llm import lower


def brute(rows, least, top):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    covered = collections.Counter()
    for (lang, p), a in counts.items():
        if len(p) > 2 and a >= least:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[lang, p[i : i + size]] = max(covered[lang, p[i : i + size]], a)
    found = collections.defaultdict(list)
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least and not (covered[lang, p] and 100 * covered[lang, p] >= 80 * a):
            score, _, left, right = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, every in found.items() for i, (s, a, p, left, right) in enumerate(sorted(every)[:top]))


def random_paths(rng, n):
    return {tuple(rng.choice("abcdé") for _ in range(rng.randint(1, 4))): rng.choice([1, 1, 1, 2, 3, 500]) for _ in range(n)}


def made(counts):
    words = sorted({w.encode() for p in counts for w in p})
    number = {w: i for i, w in enumerate(words)}
    rows = sorted(([number[w.encode()] for w in p], c) for p, c in counts.items())
    paths = np.array([r + [-1] * (4 - len(r)) for r, _ in rows], np.int64).reshape(-1, 4)
    return Transducer.of(pa.array(words, pa.large_binary()), paths, np.array([c for _, c in rows], np.int64))


def read(t, paths=None, weights=None):
    if paths is None:
        paths, weights = t.paths()
    words = [w.decode() for w in t.words.to_pylist()]
    return {tuple(words[i] for i in p if i >= 0): c for p, c in zip(paths.tolist(), weights.tolist(), strict=True)}


def test_transducers_hold_sum_and_compose_counts():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 60, 400):
        one, two, asked = (random_paths(rng, n) for _ in range(3))
        a, b, q = made(one), made(two), made(asked)
        assert read(a) == one and read(Transducer.from_bytes(a.to_bytes())) == one
        assert read(Transducer.union([a, b])) == dict(collections.Counter(one) + collections.Counter(two))
        assert read(a.at_least(3)) == {p: c for p, c in one.items() if c >= 3}
        assert read(q, *a.composed(q)) == {p: c for p, c in one.items() if p in asked}
        trie = {p[:k] for p in one for k in range(1, len(p) + 1)}
        assert len(a.label) <= len(trie)
    same = made({(x, y, z): 1 for x in "abcdefgh" for y in "ab" for z in "ab"})
    assert len(same.label) == 8 + 2 + 2  # suffixes are shared
    short = made({("a",): 5, ("a", "b"): 1, ("b",): 2})
    assert read(short) == {("a",): 5, ("a", "b"): 1, ("b",): 2}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "new", "york", "city", "naïve", "漢字", "x\x85y", "a-b", "…", "q"] + [f"w{i}" for i in range(12)]
    out = []
    for _ in range(300):
        n = rng.choice([0, 1, 2, 5, 30, 60])
        words = []
        while len(words) < n:
            words += rng.choice([["new", "york", "city", "hall"], ["of", "the"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return [*out, ("", "en"), (None, "en"), (None, None), ("hot pair " * 3000, "en"), out[3], out[3]]


@pytest.mark.parametrize(("held", "bits", "ranges"), [(1 << 20, 1 << 26, 16), (50, 1 << 16, 3), (10, 64 << 10, 40)])
def test_collocations_equal_brute_force(spark, rows, monkeypatch, held, bits, ranges):
    monkeypatch.setattr(collocations, "PHRASES_AT_ONCE", held)
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    docs = spark.createDataFrame([(1, t, lang, 7, "x", 3) for t, lang in rows], "doc_id long, text string, lang string, n int, phrase string, range int").repartition(5)
    for least, top in ((30, 2000), (4, 10), (1, 50)):
        got = sorted(map(tuple, collocations.mine(docs, least, top, ranges).collect()))
        assert got == brute(rows, least, top)


def test_a_full_bitmap_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations.Prefixes, "frequent", lambda self, hashes: np.ones(len(hashes), bool))
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.mine(docs, 5, 100).collect())) == brute(rows, 5, 100)


def test_empty_table_and_long_counts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en"), (" .,", "en")], "text string, lang string")).collect() == []
    big = made({("a",): 2**61, ("a", "b"): 2**60})
    assert read(Transducer.union([big, Transducer.from_bytes(big.to_bytes())])) == {("a",): 2**62, ("a", "b"): 2**61}
