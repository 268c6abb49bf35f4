"""What op8's products deal out: packed texts, and for stars those of their nodes alone."""

import numpy as np
import pyarrow as pa

from panelwalk.llm import jaccard_join


def test_packed_texts_come_back_in_bounded_pieces(spark):
    texts = ["é漢字 🎉", "", "a" * 5000, "b c", "d" * 90, "word " * 400]
    rows = jaccard_join._packed(spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)).orderBy("k").toArrow()
    column, found = pa.array(rows["text"].to_pylist(), pa.binary()), []
    for start, data, offsets in jaccard_join._unpacked(column, 2100):
        assert start == len(found) and (offsets[-1] <= 2100 or len(offsets) == 2)
        found += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert found == texts and rows["k"].to_pylist() == list(range(6))


def test_star_products_deal_out_texts_of_stars_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN", 0)
    shared, words = "x" * 40 + " y z ", lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    copy = words("w", 100)
    docs = [(1, shared + words("a", 10)), (2, shared + words("b", 300)), (3, copy), (4, copy + " end"), (5, words("c", 50))]
    seen = []
    real = jaccard_join._product
    monkeypatch.setattr(jaccard_join, "_product", lambda pairs, texts, *rest: seen.append(texts.count()) or real(pairs, texts, *rest))
    got = jaccard_join.links(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    assert seen[:2] == [2, 2] and seen[2] == 4
    assert np.all(np.array([r.n_shingles for r in sorted(got)]) == [11, 301, 98, 99, 48])
