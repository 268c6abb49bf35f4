"""Words and word sequences that differ by a Thue-Morse pattern and its complement: sums over bytes and powers of a
base modulo 2^64 are equal for such pairs, so nothing may rest on them."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelwalk.llm import bpe, decontaminate, jaccard_join, lm_score, queries, substring_dedup
from panelwalk.llm.text import PRIME, Ranges, times, utf8, word_bounds, word_hashes


def pattern(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return [(a, b)[x] for x in bits[:n]]


def words(n):
    return "".join(pattern(n, "a", "b")), "".join(pattern(n, "b", "a"))


PAIRS = [words(1024), words(2048), tuple(f"samehead{w}sametail" for w in words(1024))]


def hashes(texts):
    data, offsets = utf8(pa.array(texts))
    starts, ends, at = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), at


def test_hashes_of_words_and_ranges_differ():
    for pair in PAIRS:
        one, two = hashes(list(pair))[0]
        assert one != two
    short, _ = hashes([" ".join("".join(pattern(n, x, y)) for n in range(1, 80) for x, y in ("ab", "ba"))])
    assert len(set(short.tolist())) == len(short)
    for a, b in ((3, 5), (2**63, 2**63 + 1)):
        one, two = (Ranges(np.array(pattern(2048, *x), np.uint64)) for x in ((a, b), (b, a)))
        for n in (1024, 2048):
            assert one.all_of(n)[0] != two.all_of(n)[0] and one.of(np.array([0]), n)[0] == one.all_of(n)[0]


def test_products_modulo_the_prime():
    p = int(PRIME)
    a = np.array([0, 1, p - 1, 1 << 60, 123456789012345678], np.uint64)
    assert times(a, a[::-1]).tolist() == [int(x) * int(y) % p for x, y in zip(a, a[::-1], strict=True)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("merge", [bpe.merge_in_step, bpe.merge_by_trees])
def test_op3_op6_and_op10_encode_both(name, merge):
    path = {"byte_bpe_50k.json": queries.BYTE_BPE, "word_bpe_49k.json": queries.WORD_BPE}[name]
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path), merge)
    texts = [f"x {w} y" for pair in PAIRS for w in pair]
    for _ in range(2):  # the second time from memory
        ids, stops = encoder.encode(*utf8(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op1_keeps_words_that_do_not_repeat(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{w} {rest[: 100 if i > 1 else None]}") for i, w in enumerate([*PAIRS[0], *PAIRS[1]])]
    sequences = [(9, " ".join(pattern(1024, "p", "q"))), (10, " ".join(pattern(1024, "q", "p")))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}
    got = {r.doc_id: r.n_removed for r in substring_dedup.report(spark.createDataFrame(sequences, "doc_id long, text string")).collect()}
    grams = {i: [tuple(t.split()[k : k + 35]) for k in range(990)] for i, t in sequences}
    every = [g for x in grams.values() for g in x]
    for i, x in grams.items():
        gone = {j for k, g in enumerate(x) if every.count(g) > 1 for j in range(k, k + 35)}
        assert got[i] == len(gone)


def test_op8_and_op7_tell_them_apart(spark):
    docs = spark.createDataFrame([(1, PAIRS[0][0]), (2, PAIRS[0][1]), (3, PAIRS[0][0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.links(docs, n=3, share=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    text = "{} two three four five six seven eight"
    benchmark = spark.createDataFrame([(7, text.format(PAIRS[0][0]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.format(PAIRS[0][0])), (2, text.format(PAIRS[0][1]))], "doc_id long, text string")
    found = {r.doc_id: r.similarity for r in decontaminate.find(docs, benchmark).collect()}
    assert found.get(1) == 1 and found.get(2, 0) < 1


def test_op4_counts_them_apart(spark):
    rows = [(1, f"{PAIRS[0][0]} plain words"), (2, f"{PAIRS[0][1]} plain words"), (3, f"{PAIRS[0][0]} again plain")] + [(i, "plain words go on") for i in range(4, 30)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_BPE).collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        t = dict(rows)[r.doc_id]
        tokens = [*t.split(), None]
        assert r.n_known == sum(w in counts for w in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
