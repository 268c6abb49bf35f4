"""Prefix trie of conversations against dictionaries of prefixes; z-fast tries against sets of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from panelwalk.llm import prefix_trie
from panelwalk.llm.prefix_trie import ROOT, ZFastTrie, two_fattest


def path_of(symbols):
    out = [ROOT]
    for s in symbols:
        out.append(hashlib.blake2b(out[-1] + s.encode(), digest_size=16).digest())
    return out


def test_two_fattest():
    for low in range(0, 70):
        for high in range(low + 1, 140):
            powers = {n: n & -n for n in range(low + 1, high + 1)}
            assert powers[two_fattest(low, high)] == max(powers.values())


@pytest.mark.parametrize("batch", [1, 3, 256])
def test_trie_finds_exits_and_expands_edges(batch):
    rng = random.Random(batch)
    for _ in range(60):
        base = [rng.choice("ab") for _ in range(rng.choice([3, 12, 70]))]
        found = {}
        for i in range(rng.randint(1, 60)):
            s = tuple(base[: rng.randint(0, len(base))] + [rng.choice("abc") for _ in range(rng.randint(0, 5))])
            found.setdefault(s, (i, rng.randint(1, 3)))
        rows = [(path_of(s), *v) for s, v in found.items()]
        trie = ZFastTrie()
        for at in range(0, len(rows), batch):
            trie.insert_all(rows[at : at + batch])
        extents = {n.path[n.depth] for n in trie.nodes}
        for _ in range(30):
            path = path_of(base[: rng.randint(0, len(base))] + [rng.choice("abcd") for _ in range(rng.randint(0, 5))])
            assert trie.exit_of(path, trie.root).depth == max(d for d, x in enumerate(path) if x in extents)
        expected = collections.defaultdict(list)
        for s, (least, members) in found.items():
            for d, x in enumerate(path_of(s)):
                expected[x, d].append((least, members))
        got = {(p, d): (n, least) for p, d, _, n, least in trie.expanded()}
        assert got == {k: (sum(m for _, m in v), min(c for c, _ in v)) for k, v in expected.items()}
        assert len(trie.nodes) <= 2 * len(rows) + 1


def brute(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, prefix_digest(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100 * (1 if c > 0 else -1))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = collections.defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, convs in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        ids = ",".join(map(str, sorted(ends[p])))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in inside)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children[p]), sum(not children[q] for q in inside), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


def prefix_digest(role, text):
    return hashlib.sha256("".join(hashlib.sha256((x or "").encode()).hexdigest() for x in (role, text)).encode()).digest()[:16]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in [*range(0, 230), *range(-12, 0), 700, 703, 705, 1_000_000_007]:
        shared = c % 3 == 0
        for t in range(rng.choice([1, 1, 2, 4, 8, 9])):
            out.append((c, t, rng.choice(["user", "assistant"]) if not shared else "user", "hot turn" if shared and t < 3 else rng.choice(["a", "b", "𝔘𝔫 long", "", None])))
    out += [(350, None, "user", "null first"), (350, 0, None, "x"), (350, 0, "user", "tie"), (350, 0, "user", "tie"), (350, 1, "user", "t" * 50_000)]
    out += [(351, t, "user", f"turn {t}") for t in range(300)] + [(352, t, "user", f"turn {t}" if t < 250 else "else") for t in range(290)]
    out += [(None, 0, "user", "no conversation"), (353, 0, "user", "turnless")]
    rng.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, prefix int, depth string, path string"


@pytest.mark.parametrize(("turns", "batch", "ids"), [(1 << 20, 256, 1024), (60, 7, 3)])
def test_nodes_equal_brute_force(spark, rows, monkeypatch, turns, batch, ids):
    monkeypatch.setattr(prefix_trie, "TURNS_AT_ONCE", turns)
    monkeypatch.setattr(prefix_trie, "BATCH", batch)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", ids)
    table = spark.createDataFrame([(*r, 1, "x", "clash") for r in rows], SCHEMA).repartition(6)
    got = prefix_trie.nodes(table)
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    # 353 takes crc32 % 6 turns of an absent base and has fewer of its own.
    c = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 > 1)
    table = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie.nodes(table).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
