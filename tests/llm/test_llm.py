"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwalk.llm import bpe, bpe_codec, decontaminate, jaccard_join, lm_score, mpeg_audio, quality, queries, sstable, substring_dedup, token_count, toxicity
from panelwalk.llm.text import utf8

from ..oracle import differences, duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ODD = ["", None, " \n\t", "one", "<|endoftext|> x<|endoftext|>y", "a" * 700, "漢字 テスト  İǅ Σς", "  b\x85 c", "don't  stop\n\n  now", "𝔘𝔫𝔦 ١٢٣ éclaiŕ", "x " * 3000, "same " * 90]


@pytest.fixture(scope="module")
def rows(sf):
    found = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    extra = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id here"), found[3], (found[3][0], found[5][1])]
    return found + extra


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "clash") for i, t in rows], "doc_id long, text string, anchor string, node int, k string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, anchor string")


def same(got, expected):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("merge", [bpe.merge_in_step, bpe.merge_by_trees])
def test_encoders_equal_the_library(rows, name, merge):
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path), merge)
    random.seed(1)
    alphabet = "abcdefgh  \n\t'sre ÉéΣςß漢١🎉\x1c\x85 　İ.,!?--123"
    texts = [t or "" for _, t in rows[-15:]] + [t for _, t in rows[:15]] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(400)]
    ids, stops = encoder.encode(*utf8(pa.array(texts)))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[stops[i] : stops[i + 1]].tolist() == e.ids, texts[i]
    for e in library.encode_batch(texts[:20], add_special_tokens=False):
        assert encoder.v.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_of_more_units_than_the_memory_holds(monkeypatch, name):
    monkeypatch.setattr(bpe, "MEMORY", 64)
    monkeypatch.setattr(bpe, "PART", 24)
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path), bpe.merge_in_step)
    numbers = lambda a, b: " ".join(f"n{i}x{i * i}" for i in range(a, b))
    for texts in (["a few words"], [numbers(0, 40)], [numbers(20, 75)], [numbers(0, 500)], [numbers(0, 64), "a few words"], [numbers(490, 700) + " " + numbers(0, 70), numbers(650, 660)], ["a few words"]):
        ids, stops = encoder.encode(*utf8(pa.array(texts)))
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)] == expected
        assert encoder.counts(*utf8(pa.array(texts))).tolist() == list(map(len, expected))


def test_token_counts(docs, none, rows):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    expected = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    same(token_count.count_tokens(docs, queries.BYTE_BPE).collect(), expected)
    assert token_count.count_tokens(none, queries.BYTE_BPE).collect() == []


def test_codec_round_trip(docs, none, rows):
    library = Tokenizer.from_file(queries.WORD_BPE)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    same(bpe_codec.round_trip(docs, queries.WORD_BPE).collect(), expected)
    assert bpe_codec.round_trip(none, queries.WORD_BPE).collect() == []
    some = docs.limit(5).withColumn("ids", bpe_codec.encode(F.col("text"), queries.WORD_BPE)).withColumn("back", bpe_codec.decode(F.col("ids"), queries.WORD_BPE)).collect()
    assert all(r.back == library.decode(r.ids, skip_special_tokens=False) for r in some)


def test_substring_dedup(docs, none, rows, spark):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = collections.Counter(" ".join(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if counts[" ".join(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    same(substring_dedup.report(docs).collect(), expected)
    assert substring_dedup.report(none).collect() == []
    out = substring_dedup.removed(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_jaccard_join(docs, none, rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if c and 100 * c >= 90 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
        if s and rows[i][0] is not None:
            parent[find(i)] = find(first.setdefault(rows[i][0], i))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    expected = [(d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
    same(jaccard_join.links(docs).select("doc_id", "n_shingles", "component_id").collect(), expected)
    assert jaccard_join.links(none).collect() == []
    stay = jaccard_join.representatives(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len({e[2] for e in expected if e[1] and e[2] is not None}) + sum(not e[1] or e[2] is None for e in expected)


def test_jaccard_join_of_many_near_copies(spark):
    random.seed(3)
    base = [f"w{random.randint(0, 300)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"z{random.randint(0, 50)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {r.doc_id: r.component_id for r in jaccard_join.links(docs).collect()} == {i: find(i) for i in range(len(sets))}


def test_decontamination(spark, sf, none):
    random.seed(5)
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet' ORDER BY item_id").fetchall()][:10] + ["one two", "a b c d e", "x", "", None, " The the the the the the"]
    texts = ["one two", "say ONE two x", "a b c d e", "a b", "", None, "the " * 8]
    for _ in range(80):
        w = random.choice(items[:10]).split()
        for _ in range(random.randint(0, 4)):
            p = random.randrange(len(w))
            w[p : p + random.randint(0, 1)] = [f"v{random.randint(0, 30)}"] * random.randint(0, 1)
        texts.append(" ".join([f"v{random.randint(0, 30)}" for _ in range(random.randint(0, 9))] + w + ["tail"] * random.randint(0, 4)))

    def shingles(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    expected = {}
    for t, text in enumerate(texts):
        w = WORD.findall(lower(text))
        for i, item in enumerate(items):
            v = WORD.findall(lower(item))
            n = min(len(v), len(w))
            for s in range(len(w) - n + 1) if n else ():
                a, b = shingles(v), shingles(w[s : s + n])
                alike = (a & b).total() / (a | b).total()
                if alike >= 0.8:
                    expected[t, i] = max(alike, expected.get((t, i), 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(docs, benchmark).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(len(texts))) - {t for t, _ in got}
    assert decontaminate.find(none, benchmark).collect() == [] and decontaminate.find(docs, benchmark.limit(0)).collect() == []


def test_sstable(docs, none, rows, spark, tmp_path):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    ordered, start, expected, ids_of = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 0, [], collections.defaultdict(list)
    for i, t in ordered:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of[i].append(ids)
        start += len(ids)
    same(sstable.write_and_read(docs, queries.BYTE_BPE).collect(), expected)
    assert sstable.write_and_read(none, queries.BYTE_BPE).collect() == []
    shards = sstable.write(docs, queries.BYTE_BPE, f"file://{tmp_path}/shards").collect()
    tables = [sstable.Shard.opened(f"file://{tmp_path}/shards/{r.shard}") for r in shards]
    for key in (0, 7, 10_005, None):
        assert sorted(x.tolist() for t in tables for x in t.get(key)) == sorted(ids_of[key])
    assert not any(t.get(-5) or t.get(123_456_789) for t in tables)


def test_media(docs, none, rows):
    for r, (i, t) in zip(sorted(mpeg_audio.round_trip(docs).collect(), key=lambda r: (str(r.doc_id), r.payload_sha256)), sorted(((i, mpeg_audio.padded((t or "").encode())) for i, t in rows), key=lambda x: (str(x[0]), hashlib.sha256(x[1]).hexdigest())), strict=True):
        assert (r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(t), hashlib.sha256(t).hexdigest(), zlib.crc32(t[-32:]))
    assert mpeg_audio.described(mpeg_audio.media(none)).collect() == []
    stream = mpeg_audio.to_mpeg(bytes(576 * 5))
    plain = mpeg_audio.read_mpeg(stream)
    assert (plain["table"], plain["table_frames"], plain["samples"], plain["bad"], plain["skipped"]) == ("Xing", 3, 3 * 1152, 0, 0)
    noisy = mpeg_audio.read_mpeg(stream.replace(b"Xing", b"Xinh", 1) + b"TAG" + bytes(125))
    assert noisy["table"] is None and "ID3v1" in noisy["tags"]
    cut = mpeg_audio.read_mpeg(b"junk" * 9 + stream[plain["places"][0] :])
    assert cut["skipped"] == 36 and len(cut["places"]) == 3
    broken = bytearray(stream)
    broken[plain["places"][1] + 10] ^= 1
    assert mpeg_audio.read_mpeg(bytes(broken))["bad"] == 1
    assert mpeg_audio.read_mpeg(b"no audio")["places"] == []


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifiers_hold_out(spark, sf, docs, none, module, label, least):
    big = sf.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{big}/labels.parquet")
    model = module.fit(table, labels)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in module.score(table, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((s >= module.THRESHOLD) == bool(y) for s, y in held) / len(held) >= least
    assert module.score(none, model).collect() == []
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert {round(r.score, 9) for r in module.score(docs, module.fit(docs, labels.limit(0))).collect()} <= {0.5, 0.3}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labelled_texts_stay_off_the_driver(spark, sf, module, monkeypatch):
    """The driver gets features only, of 6000 labelled documents; the sample's features are those of each text alone."""
    assert module.SAMPLE == 6000
    table, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    taken = []
    for name in ("collect", "toArrow", "toPandas", "first"):
        monkeypatch.setattr(type(table), name, lambda self, real=getattr(type(table), name): taken.append(self.columns) or real(self))
    model = module.fit(table, labels)
    assert taken and not any("text" in columns for columns in taken)
    assert model is not None and np.any(model[0 if module is toxicity else 2])


def test_toxicity_features_are_those_of_each_text_alone(spark):
    texts = ["kill the thing", "a b", "", "Kill THE thing again and again", "nothing at all " * 40]
    sample = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "doc_id long, label int, text string")
    each = [set(toxicity.features(*utf8(pa.array([t]))).tolist()) for t in texts]
    got = sample.mapInArrow(toxicity._bucket_counts, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic"), F.sum("other")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {b: (sum(b in e for e in each[1::2]), sum(b in e for e in each[::2])) for b in set().union(*each)}
    column = np.full(toxicity.BUCKETS, -1)
    chosen = sorted(each[3])[:11]
    column[chosen] = np.arange(11)
    for r in toxicity._chosen_columns(sample, column).collect():
        assert np.unpackbits(np.frombuffer(r.held, np.uint8), count=11).tolist() == [int(b in each[r.doc_id]) for b in chosen]


def test_lm_score(spark, docs, none, rows):
    got = lm_score.score(docs, queries.BYTE_BPE).collect()
    train = [(i, WORD.findall(lower(t))) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for _, ws in train for w in ws)
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    expected = collections.defaultdict(list)
    for i, t in rows:
        ws = WORD.findall(lower(t))
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(counts[w] for w in ws), len(train)])
        expected[i].append((len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total, round(base, 6)))
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert r.score < 0 and math.isfinite(r.score)
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in expected.items()}
    assert lm_score.score(none, queries.BYTE_BPE).collect() == []


def test_lm_weights_come_from_all_training_texts(spark, monkeypatch):
    """1,300 texts, then 60 with ids of their own: these get rows, classes and a better score than by counts alone."""
    monkeypatch.setattr(lm_score, "STEPS", 160)
    monkeypatch.setattr(lm_score, "TASK_IDS", 2000)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, 12) for _ in range(1300)] + [np.tile(np.arange(300, 308), 3) for _ in range(60)]
    encoded = spark.createDataFrame([(i, i, bytearray(t.astype("<i4").tobytes())) for i, t in enumerate(texts)], "doc_id long, text_key long, ids binary")
    totals = np.bincount(np.concatenate(texts), minlength=401).astype(float)
    totals[-1] = len(texts)
    model = lm_score.fit(encoded, totals)
    assert (model.compact[300:308] > 0).all() and ((model.compact > 0) == (totals > 0)).all()
    assert model.scores(texts[-1], np.array([0, 24]))[0] > np.log(totals[texts[-1]] / totals.sum()).sum() * 0.9
    pairs = [lm_score._follow(s, lm_score._contexts(totals)) for s in (np.r_[400, t, 400] for t in texts)]
    got = lm_score._tallied(encoded, lambda ids: np.concatenate([lm_score._follow(s, lm_score._contexts(totals)) for s in lm_score._sequences(ids, 400)]))
    assert all(np.array_equal(a, b) for a, b in zip(got, np.unique(np.concatenate(pairs), return_counts=True), strict=True))
    again = lm_score.fit(encoded.orderBy(F.rand(3)).repartition(5), totals)
    assert np.array_equal(again.own, model.own)


def test_lm_score_equals_one_masked_pass():
    """A text within one window, id by id with a whole softmax."""
    rng = np.random.default_rng(4)
    model = lm_score.train([rng.integers(0, 300, 200) for _ in range(4)], np.r_[rng.integers(1, 50, 300).astype(float), 4.0])
    ids, end = rng.integers(0, 300, 20), 300
    before, total = [end, *ids], 0.0
    for t, goal in enumerate([*ids, end]):
        rows = model.compact[before[: t + 1]]
        w = np.exp([model.query[rows[-1]] @ model.key[r] + model.bias[t, lm_score.BEFORE + j] for j, r in enumerate(rows)])
        seen = (w[:, None] * model.value[rows]).sum(0) / w.sum()
        outer = seen @ model.out_group + model.own_group[rows[-1]]
        inner = (seen @ model.out).reshape(-1, lm_score.GROUP) + model.own[rows[-1]]
        each = (outer - np.log(np.exp(outer).sum()))[:, None] + inner - np.log(np.exp(inner).sum(1, keepdims=True))
        assert math.isclose(np.exp(each).sum(), 1, rel_tol=1e-4)
        total += each.ravel()[model.classes[goal]] + model.inside[goal]
    assert math.isclose(model.scores(ids, np.array([0, 20]))[0], total, rel_tol=1e-4)


def test_lm_windows_score_each_id_once():
    rng = np.random.default_rng(0)
    model = lm_score.train([rng.integers(0, 40, 300) for _ in range(3)], np.ones(41))
    long = rng.integers(0, 40, 100)
    both, _ = model.scores(np.r_[long, long], np.array([0, 100, 200])), None
    assert math.isclose(both[0], both[1], rel_tol=1e-5)
    every = [model.scores(long[:0], np.array([0, 0]))[0]]
    assert every[0] < 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) == []


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_drops_copies_of_five_word_jaccard_at_least_80_percent(spark):
    import corpus_pipeline

    random.seed(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(100)]
        texts.append(base)
        for _ in range(3):
            w = list(base)
            for p in random.sample(range(8, 92), random.randint(1, 4)):
                w[p] = f"new{random.randint(0, 10**9)}"
            texts.append(w)
    # 100 words, two of them apart replaced: 86 / 106 of five words, 92 / 104 of three.
    pair = [f"p{i}" for i in range(100)]
    texts += [pair, [*pair[:30], "x", *pair[31:70], "y", *pair[71:]]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    assert len(sets[-1] & sets[-2]) == 86 and len(sets[-1] | sets[-2]) == 106
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {find(i) for i in range(len(sets))}


def test_decontamination_candidates_come_from_the_index(spark):
    """With an empty multi-index nothing is found; in blocks of few items the same as in one."""
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(words[i : i + 20]) for i in range(0, 40, 4)]
    index = decontaminate.Index(list(range(len(items))), items)
    text = utf8(pa.array([" ".join(["a", *words[:24], "b"]), None, "a b"]))
    found = index.matches(*text)
    assert {(t, i) for t, i, *_ in found} == {(0, 0), (0, 1)}
    index.near[:] = False
    assert index.matches(*text) == []


def test_decontamination_in_blocks_and_odd_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(words[i : i + 20])) for i in range(0, 40, 4)], "item_id long, text string")
    rows = [(None, " ".join(words[:24])), (1, " ".join(words[8:28])), (1, " ".join(words[8:28])), (2, "a " * 200_000 + " ".join(words[:20]))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, item_id int, similarity string")
    one = sorted(map(str, decontaminate.find(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert sorted(map(str, decontaminate.find(docs, benchmark).collect())) == one and len(one) == 5
    assert decontaminate.clean(docs.union(docs.limit(1).selectExpr("3L", "'clean'", "item_id", "similarity")), benchmark).collect()[0].doc_id == 3


def test_benchmark_items_without_id_are_found(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"say {text} now"), (2, "nothing of it")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, text), (7, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id or -1) for r in decontaminate.find(docs, benchmark).collect()) == [(1, -1), (1, 7)]
    assert [r.doc_id for r in decontaminate.clean(docs, benchmark).collect()] == [2]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "word_hashes", lambda data, starts, ends: np.full(len(starts), 5, np.uint64))
    library, encoder = Tokenizer.from_file(queries.BYTE_BPE), bpe.Encoder(bpe.vocabulary(queries.BYTE_BPE), bpe.merge_in_step)
    texts = ["some plain words here", "other words there and there", "some words again"]
    ids, stops = encoder.encode(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_toxicity_pieces_make_the_features_of_the_whole(monkeypatch):
    text = utf8(pa.array(["", "Kill é漢字 THE thing 🎉 " * 40, "aé", None, "x" * 500]))
    whole = toxicity.features(*text)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.array_equal(toxicity.features(*text), whole)
    grams = {(i, t[k : k + n]) for i, t in enumerate(["kill é漢字 the thing 🎉 " * 40, "aé", "x" * 500]) for n in toxicity.SIZES for k in range(len(t) - n + 1)}
    assert len(grams) - len(whole) <= 2  # buckets may be shared


@pytest.mark.parametrize("module", [toxicity, quality])
def test_a_column_of_the_score_name_is_replaced(spark, sf, module):
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    table = spark.createDataFrame([(1, "a text", "old")], "doc_id long, text string, Score string")
    got = module.score(table, module.fit(table.drop("Score"), labels))
    assert got.columns == ["doc_id", "text", "score"] and got.first().score in (0.5, module.THRESHOLD)


def test_equal_texts_have_equal_media(spark):
    rows = [(1, "same text"), (2, "same text"), (3, None), (4, "")]
    got = {r.doc_id: tuple(r)[1:] for r in mpeg_audio.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1][0] == 9 and len(got[1][-1]) == 1
    stream = mpeg_audio.to_mpeg(mpeg_audio.padded(b"same text"))
    assert got[1][4:6] == (len(stream), hashlib.sha256(stream).hexdigest())
