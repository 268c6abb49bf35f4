"""What the language model learns from: every window, and enough to beat the base score on texts it has not seen."""

import random
import zlib

import numpy as np
import pytest

from panelwalk.llm import lm_score, queries


@pytest.mark.parametrize("windows", [1, 40, 3000, 200_000])
def test_every_window_is_learnt_at_any_size(windows):
    order = lm_score._order(windows, 125 * lm_score.WINDOWS_A_STEP, np.random.default_rng(1))
    counts = np.bincount(order, minlength=windows)
    assert counts.min() >= 1 and counts.max() - counts.min() <= 1


def test_scores_of_unseen_texts_beat_the_base(spark):
    rng = random.Random(9)
    names = ["river", "stone", "garden", "window", "market", "letter", "summer", "winter"]
    after = {w: [names[(3 * i + k) % 8] for k in (1, 2)] for i, w in enumerate(names)}

    def text():
        words = [rng.choice(names)]
        while len(words) < 120:
            words.append(rng.choice(after[words[-1]]))
        return " ".join(words)

    rows = [(i, text()) for i in range(240)] + [(None, "river"), (900, None), (901, "")]
    rows += [(902, rows[7][1]), (903, rows[7][1])]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_BPE).collect()
    unseen = [r for r in got if r.held_out and r.n_tokens > 50]
    assert len(unseen) > 20 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got if r.doc_id is not None)
    gain = sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen)
    assert gain > 0.25  # log10 a token; the order leaves one of two words where the base has one of eight: 0.6
    equal = {r.doc_id: (r.score, r.base_score) for r in got}
    for a, b in ((902, 903), (900, 901)):
        assert np.allclose(equal[a], equal[b], rtol=1e-6)  # texts of a batch are summed in single precision
    alone = [r for r in got if r.doc_id in (900, 901)]
    assert all(r.n_tokens == 1 for r in alone) and [r.held_out for r in got if r.doc_id is None] == [False]


def test_a_step_of_training_follows_the_slope():
    """Of one step, each array's change against differences of the loss, which the model's own scores give."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, 31)]
    totals = np.r_[np.bincount(texts[0], minlength=40), 1].astype(float)
    classes = lm_score._grouped(np.zeros(0, np.int64), np.zeros(0, np.int64), totals)
    compact, p = lm_score._start(totals, classes)
    flat, shapes = lm_score._packed(p)
    assert all(np.array_equal(p[k], x) for k, x in lm_score._unpacked(flat, shapes).items())

    def loss(p):
        model = lm_score._model({k: x.astype(float) for k, x in p.items()}, compact, classes, totals)
        return -(model.scores(texts[0], np.array([0, 31]))[0] - model.inside[np.r_[texts[0], 40]].sum())

    seen = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_score, "STEPS", 1)
        patch.setattr(lm_score, "WINDOWS_A_STEP", 1)
        new = lm_score._fitted(p, [np.r_[40, texts[0], 40]], compact, classes, 0, 1)
    for k in p:
        # The first step moves each weight by the rate against the sign of its slope.
        step = new[k] - p[k]
        seen[k] = loss({**p, k: p[k] + step / np.abs(step).max() * 0.02}) - loss({**p, k: p[k] - step / np.abs(step).max() * 0.02})
    assert all(x < 0 for x in seen.values()), seen


def test_words_after_a_first_subword_have_probabilities_that_sum_to_one():
    """Of an alphabet of three subwords: hot words by their counts, all others by what the counts leave, spelling after spelling."""
    stop, counts = 3, np.array([6, 4, 2])
    hot = [[0, 1], [0, 2, 2], [1]]
    texts = [[*w, stop + 1 + i] for i, (w, n) in enumerate(zip(hot, counts, strict=True)) for _ in range(n)] + [[0, 0, stop]] * 3
    spelt = np.concatenate(texts).astype(np.int64)
    column = lm_score._contexts(np.bincount(spelt[spelt < stop], minlength=stop + 1).astype(float), lm_score.COLUMNS)
    firsts, totals = np.array([w[0] for w in hot]), np.array([13.0, 2.0, 0.0, 0.0])
    model = lm_score.Spelling(column, *np.unique(model_pairs := lm_score.Spelling.pairs(spelt, column), return_counts=True), firsts, counts, totals)
    assert len(model_pairs) == sum(len(t) - 1 for t in texts)
    total, live = 0.0, [[0]]
    for _ in range(9):  # all words of up to nine subwords
        rows = [[*w, stop + 1 + hot.index(w) if w in hot else stop] for w in live]
        flat = np.concatenate(rows).astype(np.int64)
        total += np.exp(model.scores(flat, np.cumsum([0, *map(len, rows)]))).sum()
        live = [[*w, x] for w in live for x in range(stop)]
    assert 0.97 < total <= 1 + 1e-9
    assert model.scores(np.zeros(0, np.int64), np.array([0, 0, 0])).tolist() == [0, 0]


def test_frequent_words_are_ids_and_others_are_spelt():
    from panelwalk.llm import bpe
    from panelwalk.llm.text import utf8, word_bounds, word_hashes

    import pyarrow as pa

    stop = len(bpe.vocabulary(queries.BYTE_BPE).strings)
    data, offsets = utf8(pa.array(["The river zqxjing the", None, "", "zqxjing   kvv"]))
    starts, ends, at = word_bounds(data, offsets)
    words = [bytes(data[a:b]).lower() for a, b in zip(starts, ends, strict=True)]
    hashes = word_hashes(lm_score.LOWER[data], starts, ends)
    units, hot = np.unique(hashes[:2]), np.unique(hashes[:3])
    ids, spelt, spelt_at = lm_score._word_ids(bpe.encoder(queries.BYTE_BPE, bpe.merge_in_step), stop, units, hot, data, starts, ends, at)
    assert [i > stop for i in ids] == [True, True, False, True, False, False] and ids[0] == ids[3]
    begins, stops = lm_score.Spelling.words(spelt, stop)
    strings = bpe.vocabulary(queries.BYTE_BPE).strings
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(queries.BYTE_BPE)))
    for word, a, b in zip([words[2], *words[4:]], begins, stops, strict=True):
        assert spelt[a:b].tolist() == library.encode(" " + word.decode(), add_special_tokens=False).ids and max(spelt[a:b]) < len(strings)
    assert (spelt[stops] > stop).tolist() == [True, False, False]
    assert spelt_at.tolist() == [0, stops[0] + 1, stops[0] + 1, stops[0] + 1, len(spelt)]
