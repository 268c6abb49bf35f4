"""Phrase collocations from counts held in weighted acyclic automata.

A count transducer is an acyclic automaton over words. Its first symbol is the language, then come the words
of a phrase; an arc's weight is the count of the phrase that ends with it. States with the same arcs, weights
and targets are one state.

    shards      each task sorts the distinct phrases of its texts and builds transducers from them, one for each
                prefix range; it does so anew whenever PHRASES_AT_ONCE phrases have come together
    union       transducers of one range, from all shards, are united and their weights summed
    part lookup the parts of the candidates form an automaton as well; it is composed with the range's
                transducer, and the weights of the common paths are the parts' counts

A prefix range is a range of the hashes of first words. A first word, or first two words, with more than a
small share of all words is spread over several ranges by the word after it; there are no more such prefixes than
`SPLIT` times the ranges, so the list of them is bounded.

Phrases are counted in rounds: words, then two words, then three and four. No phrase is more frequent than
its parts, so a later round leaves out phrases with a part below `least`. Tasks know the frequent phrases of the
round before from a bitmap of FILTER_BITS bits, whatever their number: a bit may belong to several phrases, so
a full bitmap leaves out less and the counts stay exact.

Defined results. Null text: no words. Null language: `und`. Empty table: no rows. Repeated rows and equal doc_ids
count each time. Columns other than text and lang aren't read. Ties of the score and of the count are broken by the
phrase's bytes. A text of any length is one row; its words are read whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, kept, mix, slices, utf8, word_hashes

#: Most distinct phrases that a task holds before it hands on its transducers.
PHRASES_AT_ONCE = 1 << 20
FILTER_BITS = 1 << 26
#: A prefix with more than 1 / (SPLIT * ranges) of all words is spread over several ranges.
SPLIT = 8
#: Words of a phrase at most.
LONGEST = 4
ROUNDS = ((1,), (2,), (3, 4))

# Bytes that end a word, and those of them that end a piece.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True


class Transducer:
    """words: distinct symbols, whose numbers are the labels; arcs of state s: first[s] .. first[s + 1], ascending by
    label. State 0 is the start. Target -1: no arcs follow. Paths are sorted by labels."""

    def __init__(self, words: pa.Array, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.words, self.first, self.label, self.weight, self.target = words, first, label, weight, target

    @classmethod
    def of(cls, words: pa.Array, paths: np.ndarray, weight: np.ndarray) -> Transducer:
        """From sorted, different paths: a row for each, labels from the left, -1 after its end."""
        n, depth = paths.shape
        # Arcs of the trie by depth: one for each different prefix.
        differs = np.ones((depth, n), bool)
        for d in range(depth):
            if n:
                differs[d, 1:] = paths[1:, d] != paths[:-1, d]
            if d:
                differs[d] |= differs[d - 1]
        target = np.full(n, -1, np.int64)
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts: list[np.ndarray] = []
        made = 0
        for d in range(depth - 1, -1, -1):
            at = np.flatnonzero(differs[d] & (paths[:, d] >= 0))
            # Where a path ends with this arc, its weight is the arc's; shorter paths come first.
            ends = paths[at, d + 1] < 0 if d + 1 < depth else np.ones(len(at), bool)
            own = (paths[at, d], np.where(ends, weight[at], 0), target[at])
            state = np.searchsorted(np.flatnonzero(differs[d - 1]), at, "right") - 1 if d else np.zeros(len(at), np.int64)
            starts = np.flatnonzero(np.r_[True, state[1:] != state[:-1]]) if len(at) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(at)])
            number, leaders = _same_states(own, starts, sizes)
            # States of the deeper levels come first, the start last.
            some = _ranges(starts[leaders], sizes[leaders])
            arcs.append(tuple(x[some] for x in own))
            counts.append(sizes[leaders])
            target = np.full(n, -1, np.int64)
            if d:
                rows = np.flatnonzero(differs[d - 1])
                target[rows[state[starts]]] = made + number
            made += len(leaders)
        below = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if not n:
            below, made = np.zeros(1, np.int64), 1
        label, weights, targets = (np.concatenate([x[i] for x in arcs]) if arcs else np.zeros(0, np.int64) for i in range(3))
        # The start becomes state 0.
        first = np.cumsum(np.r_[0, below])
        order = np.r_[made - 1, np.arange(made - 1)]
        some = _ranges(first[order], below[order])
        return cls(words, np.cumsum(np.r_[0, below[order]]), label[some], weights[some], np.where(targets[some] < 0, -1, targets[some] + 1))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All weighted paths, sorted, and their weights."""
        rows, weights = [], []
        state, so_far = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        while len(state):
            sizes = self.first[state + 1] - self.first[state]
            arc = _ranges(self.first[state], sizes)
            so_far = np.column_stack([np.repeat(so_far, sizes, 0), self.label[arc]])
            there = self.weight[arc] > 0
            rows.append(so_far[there])
            weights.append(self.weight[arc][there])
            on = self.target[arc] >= 0
            state, so_far = self.target[arc][on], so_far[on]
        depth = max(r.shape[1] for r in [*rows, np.zeros((0, 2))])
        padded = [np.pad(r, ((0, 0), (0, depth - r.shape[1])), constant_values=-1) for r in rows]
        every, weight = np.concatenate(padded), np.concatenate(weights)
        order = _sorted(every)
        return every[order], weight[order]

    def composed(self, other: Transducer) -> tuple[np.ndarray, np.ndarray]:
        """The paths that both have, in the other's labels, and this one's weights. Both are walked together, a
        level of pairs of states at a time."""
        mine = pc.index_in(other.words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        width = max(len(self.words), 1)
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * width + self.label
        rows, weights = [], []
        here, there, so_far = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        while len(here):
            sizes = other.first[there + 1] - other.first[there]
            arc = _ranges(other.first[there], sizes)
            symbol = mine[other.label[arc]]
            key = np.repeat(here, sizes) * width + symbol
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = (symbol >= 0) & (keys[at] == key) if len(keys) else np.zeros(len(arc), bool)
            arc, at, so_far = arc[found], at[found], np.repeat(so_far, sizes, 0)[found]
            so_far = np.column_stack([so_far, other.label[arc]])
            asked = (other.weight[arc] > 0) & (self.weight[at] > 0)
            rows.append(so_far[asked])
            weights.append(self.weight[at][asked])
            on = (other.target[arc] >= 0) & (self.target[at] >= 0)
            here, there, so_far = self.target[at][on], other.target[arc][on], so_far[on]
        depth = max(r.shape[1] for r in [*rows, np.zeros((0, 2))])
        padded = [np.pad(r, ((0, 0), (0, depth - r.shape[1])), constant_values=-1) for r in rows]
        return (np.concatenate(padded), np.concatenate(weights)) if rows else (np.zeros((0, 1), np.int64), np.zeros(0, np.int64))

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """All paths of the parts, with the sums of their weights."""
        words = pa.concat_arrays([p.words for p in parts]).unique()
        rows, weights = zip(*(p.paths() for p in parts), strict=True)
        depth = max(r.shape[1] for r in rows)
        every = []
        for part, r in zip(parts, rows, strict=True):
            number = np.r_[pc.index_in(part.words, words).to_numpy().astype(np.int64), -1]
            every.append(np.pad(number[r], ((0, 0), (0, depth - r.shape[1])), constant_values=-1))
        return cls.of(words, *_summed(np.concatenate(every), np.concatenate(weights)))

    def at_least(self, least: int) -> Transducer:
        """Without the paths of a smaller weight."""
        paths, weight = self.paths()
        paths, weight = paths[weight >= least], weight[weight >= least]
        used, labels = np.unique(paths, return_inverse=True)
        none = int(len(used) > 0 and used[0] < 0)
        return Transducer.of(self.words.take(pa.array(used[none:])), labels.reshape(paths.shape) - none, weight)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        text = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        for x in (np.diff(offsets), text, np.diff(self.first), self.label, self.weight, self.target + 1):
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
            out.write(np.array([x.itemsize, len(x)], np.int64).tobytes() + x.tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        parts, at = [], 0
        while at < len(data):
            size, n = np.frombuffer(data, np.int64, 2, at).tolist()
            parts.append(np.frombuffer(data, f"u{size}", n, at + 16).astype(np.int64) if len(parts) != 1 else np.frombuffer(data, np.uint8, n, at + 16))
            at += 16 + size * n
        sizes, text, counts, label, weight, target = parts
        return cls(_binary(text, np.cumsum(np.r_[0, sizes])), np.cumsum(np.r_[0, counts]), label, weight, target - 1)


def _binary(text: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size of all ranges, one after the other."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)


def _same_states(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each state the number of its class, and the class's first state. Classes are found by a hash of the arcs
    and every state's arcs are held against those of its class; one that differs stays by itself."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(arcs[0])) - np.repeat(starts, sizes)
    one = place.astype(np.uint64)
    for x in arcs:
        one = mix(one * np.uint64(0x9FB21C651E98DF25) + x.astype(np.uint64))
    sums = mix(np.add.reduceat(one, starts) + sizes.astype(np.uint64))
    _, leaders, number = np.unique(sums, return_index=True, return_inverse=True)
    lead = leaders[number]
    same = sizes == sizes[lead]
    both = np.where(same, sizes, 0)
    here, there = _ranges(starts, both), _ranges(starts[lead], both)
    differ = np.zeros(len(here), bool)
    for x in arcs:
        differ |= x[here] != x[there]
    wrong = np.unique(np.repeat(np.arange(len(starts)), both)[differ])
    alone = np.union1d(np.flatnonzero(~same), wrong)
    number[alone] = len(leaders) + np.arange(len(alone))
    return number, np.r_[leaders, alone]


def _sorted(paths: np.ndarray) -> np.ndarray:
    """The order of rows, first columns first."""
    if not len(paths):
        return np.zeros(0, np.int64)
    width = int(paths.max()) + 2
    keys: list[np.ndarray] = []
    for d in range(paths.shape[1]):
        column = paths[:, d] + 1
        if d and width < 1 << 31 and d % 2:
            keys[-1] = keys[-1] * width + column
        else:
            keys.append(column)
    return np.lexsort(keys[::-1])


def _summed(paths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows and the sums of their weights."""
    order = _sorted(paths)
    paths, weight = paths[order], weight[order]
    if not len(paths):
        return paths, weight
    starts = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]).any(1)])
    return paths[starts], np.add.reduceat(weight, starts)


class Prefixes:
    """What tasks know of the rounds before: frequent phrases as bits, prefixes that are spread over ranges."""

    def __init__(self, ranges: int, bits: np.ndarray | None = None, spread: dict[int, int] | None = None):
        self.ranges, self.bits = ranges, bits
        self.keys = np.array(sorted(spread or {}), np.uint64)
        self.parts = np.array([(spread or {})[int(k)] for k in self.keys], np.uint64)

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        at = (hashes >> np.uint64(3)) % np.uint64(len(self.bits))
        return (self.bits[at] >> (hashes & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def _spread(self, prefix: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(prefix), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, prefix), len(self.keys) - 1)
        return np.where(self.keys[at] == prefix, self.parts[at], np.uint64(1))

    def ranges_of(self, words: list[np.ndarray]) -> np.ndarray:
        """The range of phrases, from hashes of language and first word, then of the other words by column."""
        r = (words[0] >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
        prefix = words[0]
        for later in words[1:3]:
            r += (mix(later + np.uint64(1)) % self._spread(prefix)) * np.uint64(0x9E3779B1)
            prefix = joined(prefix, later)
        return (r % np.uint64(self.ranges)).astype(np.int64)


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last and that of the last."""
    return mix(prefix * np.uint64(0x9FB21C651E98DF25) + word)


def _hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return word_hashes(np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:])


def pieces(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word, its document, and how many words of its piece follow it."""
    data, offsets = utf8(batch.column(0))
    if not len(data):
        return pa.array([], pa.large_binary()), *(np.zeros(0, np.int64) for _ in range(3))
    data = LOWER[data]
    ends_word, ends_piece = WORD_END[data], PIECE_END[data]
    inside = ~ends_word
    begins = inside.copy()
    begins[1:] &= ends_word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.large_binary()), *(np.zeros(0, np.int64) for _ in range(3))
    number = np.cumsum(inside)
    sizes = np.diff(np.r_[number[starts] - 1, number[-1]])
    words = _binary(data[inside], np.cumsum(np.r_[0, sizes])).dictionary_encode()
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(ends_piece)[starts]
    stops = np.flatnonzero(np.r_[(piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]), True])
    left = np.repeat(stops, np.diff(np.r_[-1, stops])) - np.arange(len(starts))
    return words.dictionary, words.indices.to_numpy().astype(np.int64), doc, left


class Shard:
    """Phrases of a task's texts, counted until they are handed on."""

    def __init__(self, lengths: tuple[int, ...], known: Prefixes):
        self.lengths, self.known = lengths, known
        self.tables: list[pa.Array] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        table, word, doc, left = pieces(batch)
        if not len(word):
            return
        langs = pc.fill_null(batch.column(1), "und").cast(pa.large_string()).cast(pa.large_binary()).dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[doc]
        # A symbol is a word in a language, so phrases of symbols are phrases of one language.
        both, symbol = np.unique(lang * len(table) + word, return_inverse=True)
        symbol_lang, symbol_word = both // len(table), both % len(table)
        as_first = mix(_hashes(langs.dictionary)[symbol_lang] + np.uint64(0x5851F42D4C957F2D)) ^ _hashes(table)[symbol_word]
        as_first = mix(as_first)
        later = _hashes(table)[symbol_word]
        shift = len(langs.dictionary)
        self.tables.append(pa.concat_arrays([langs.dictionary, table]))
        n = len(both)

        def put(symbols: list[np.ndarray], count: np.ndarray) -> None:
            paths = np.full((len(count), LONGEST + 1), -1, np.int32)
            paths[:, 0] = symbol_lang[symbols[0]]
            for d, s in enumerate(symbols):
                paths[:, d + 1] = symbol_word[s] + shift
            self.rows.append((paths, count))
            self.size += len(count)

        if self.lengths == (1,):
            put([np.arange(n)], np.bincount(symbol, minlength=n))
            return
        if self.lengths == (2,):
            good = self.known.frequent(as_first)[symbol]
            at = np.flatnonzero((left[:-1] >= 1) & good[:-1] & good[1:]) if len(symbol) > 1 else np.zeros(0, np.int64)
            pair, count = np.unique(symbol[at] * n + symbol[at + 1], return_counts=True)
            put([pair // n, pair % n], count)
            return
        at = np.flatnonzero(left >= 1)
        pair, which = np.unique(symbol[at] * n + symbol[at + 1], return_inverse=True)
        good = self.known.frequent(joined(as_first[pair // n], later[pair % n]))
        number = np.full(len(symbol), -1, np.int64)  # of the frequent pair that begins at each word
        number[at] = np.where(good[which], which, -1)
        for length in self.lengths:
            at = np.flatnonzero(left >= length - 1)
            for k in range(length - 1):
                at = at[number[at + k] >= 0]
            if length == 3:
                key, count = np.unique(number[at] * n + symbol[at + 2], return_counts=True)
                put([pair[key // n] // n, pair[key // n] % n, key % n], count)
            else:
                m = len(pair)
                key, count = np.unique(number[at] * m + number[at + 2], return_counts=True)
                a, b = pair[key // m], pair[key % m]
                put([a // n, a % n, b // n, b % n], count)

    def transducers(self) -> Iterator[tuple[int, bytes]]:
        """A transducer for each range; the shard is empty afterwards."""
        if not self.size:
            return
        words = pa.concat_arrays(self.tables).unique()
        every = []
        for table, (paths, _) in zip(np.repeat(np.arange(len(self.tables)), len(self.rows) // len(self.tables)), self.rows, strict=True):
            every.append(np.r_[pc.index_in(self.tables[table], words).to_numpy().astype(np.int64), -1][paths])
        paths, weight = _summed(np.concatenate(every), np.concatenate([c for _, c in self.rows]))
        self.tables, self.rows, self.size = [], [], 0
        r = self.known.ranges_of(phrase_hashes(words, paths[:, : max(self.lengths) + 1]))
        order = np.argsort(r, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(r[order])) + 1):
            some = np.sort(some)
            used, labels = np.unique(paths[some, : max(self.lengths) + 1], return_inverse=True)
            none = int(used[0] < 0)
            labels = labels.reshape(len(some), -1) - none
            yield int(r[some[0]]), Transducer.of(words.take(pa.array(used[none:])), labels, weight[some]).to_bytes()


def phrase_hashes(words: pa.Array, paths: np.ndarray) -> list[np.ndarray]:
    """Of each path: the hash of its language and first word, then those of the other words by column."""
    hashes = np.r_[_hashes(words), np.uint64(0)]
    lang = np.r_[mix(hashes[:-1] + np.uint64(0x5851F42D4C957F2D)), np.uint64(0)]
    return [mix(lang[paths[:, 0]] ^ hashes[paths[:, 1]]), *(hashes[paths[:, d]] for d in range(2, paths.shape[1]))]


def _whole_hashes(words: pa.Array, paths: np.ndarray) -> np.ndarray:
    columns = phrase_hashes(words, paths)
    out = columns[0]
    for d, later in enumerate(columns[1:], 2):
        out = np.where(paths[:, d] >= 0, joined(out, later), out)
    return out


def _phrases(words: pa.Array, paths: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Languages and phrases, words joined by one space."""
    text = words.cast(pa.large_string())
    langs, out = text.take(pa.array(paths[:, 0])), None
    for d in range(1, paths.shape[1]):
        there = paths[:, d] >= 0
        word = text.take(pa.array(np.where(there, paths[:, d], 0)))
        out = word if out is None else pc.if_else(pa.array(there), pc.binary_join_element_wise(out, word, pa.scalar(" ", pa.large_string())), out)
    return langs.cast(pa.string()), (out if out is not None else pa.array([], pa.large_string())).cast(pa.string())


def _of_phrases(langs: pa.Array, phrases: pa.Array) -> Transducer:
    """An automaton of phrases, each of weight 1, and its words."""
    split = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    sizes, flat = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten().cast(pa.large_binary())
    langs = langs.cast(pa.large_string()).cast(pa.large_binary())
    both = pa.concat_arrays([langs, flat])
    words = both.unique()
    number = pc.index_in(both, words).to_numpy().astype(np.int64)
    paths = np.full((len(sizes), int(sizes.max(initial=1)) + 1), -1, np.int64)
    paths[:, 0] = number[: len(sizes)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    paths[row, _ranges(np.ones(len(sizes), np.int64), sizes)] = number[len(sizes) :]
    paths, weight = _summed(paths, np.ones(len(paths), np.int64))
    return Transducer.of(words, paths, weight)


def _count_round(docs: DataFrame, lengths: tuple[int, ...], known: Prefixes, least: int) -> DataFrame:
    """range, transducer of the phrases with `least` or more, totals: words by language (first round only)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(lengths, shared.value)

        def out() -> Iterator[pa.RecordBatch]:
            ranges, blocks = [], []
            for r, block in shard.transducers():
                ranges.append(r)
                blocks.append(block)
            if ranges:
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blocks, pa.binary())], ["range", "block"])

        for piece in slices(batches):
            shard.add(piece)
            if shard.size >= PHRASES_AT_ONCE:
                yield from out()
        yield from out()

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def done() -> pa.RecordBatch:
            whole = Transducer.union(parts)
            totals = _totals(whole) if lengths == (1,) else []
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([whole.at_least(least).to_bytes()], pa.binary()), pa.array([totals], pa.map_(pa.string(), pa.int64()))], ["range", "transducer", "totals"]
            )

        for batch in batches:
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != now and parts:
                    yield done()
                    parts, size = [], 0
                now = r
                parts.append(Transducer.from_bytes(block))
                size += len(parts[-1].label)
                if size > 4 * PHRASES_AT_ONCE and len(parts) > 1:
                    parts = [Transducer.union(parts)]
                    size = len(parts[0].label) // 2
        if parts:
            yield done()

    blocks = docs.select("text", "lang").mapInArrow(shards, "range int, block binary")
    dealt = blocks.repartition(known.ranges, "range").sortWithinPartitions("range")
    return kept(dealt.mapInArrow(united, "range int, transducer binary, totals map<string,bigint>"), f"phrases{lengths[0]}")


def _totals(t: Transducer) -> list[tuple[str, int]]:
    paths, weight = t.paths()
    langs, at = np.unique(paths[:, 0], return_inverse=True)
    sums = np.zeros(len(langs), np.int64)
    np.add.at(sums, at, weight)
    return list(zip(t.words.take(pa.array(langs)).cast(pa.large_string()).to_pylist(), sums.tolist(), strict=True))


def phrases(transducers: DataFrame) -> DataFrame:
    """lang, phrase, words, n of all weighted paths."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                t = Transducer.from_bytes(block)
                paths, weight = t.paths()
                langs, text = _phrases(t.words, paths)
                yield pa.RecordBatch.from_arrays([langs, text, pa.array((paths[:, 1:] >= 0).sum(1), pa.int32()), pa.array(weight)], ["lang", "phrase", "words", "n"])

    return transducers.select("transducer").mapInArrow(expand, "lang string, phrase string, words int, n long")


def _next_round(transducers: DataFrame, known: Prefixes, n: int) -> Prefixes:
    """Frequent phrases as bits and prefixes to spread, for the round after this one."""
    size, block = FILTER_BITS >> 3, 1 << 13
    limit = max(1, n // (SPLIT * known.ranges))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                t = Transducer.from_bytes(data)
                hashes = _whole_hashes(t.words, t.paths()[0])
                at = np.unique((hashes >> np.uint64(3)) % np.uint64(size) * np.uint64(8) + (hashes & np.uint64(7))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // (8 * block)), pa.array(at % (8 * block))], ["block", "bit"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(at).tolist():
                np.bitwise_or.at(found.setdefault(b, np.zeros(block, np.uint8)), bit[at == b] >> 3, (1 << (bit[at == b] & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "bits"])

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                t = Transducer.from_bytes(data)
                paths, weight = t.paths()
                some = weight > limit
                yield pa.RecordBatch.from_arrays([pa.array(_whole_hashes(t.words, paths[some]).view(np.int64)), pa.array(weight[some])], ["prefix", "n"])

    bits = np.zeros(size, np.uint8)
    one = transducers.select("transducer")
    for r in one.mapInArrow(positions, "block long, bit long").repartition("block").mapInArrow(blocks, "block long, bits binary").collect():  # FILTER_BITS at most
        bits[r.block * block : (r.block + 1) * block] = np.frombuffer(r.bits, np.uint8)
    spread = dict(zip(known.keys.tolist(), known.parts.tolist(), strict=True))
    for r in one.mapInArrow(hot, "prefix long, n long").collect():  # SPLIT * ranges rows at most
        spread[r.prefix % (1 << 64)] = min(known.ranges, -(-r.n // limit))
    return Prefixes(known.ranges, bits, spread)


def _looked_up(parts: DataFrame, rounds: list[tuple[DataFrame, Prefixes]]) -> DataFrame:
    """lang, phrase, n of those of the different phrases in `parts` (lang, phrase, words) that the transducers hold."""
    schema = "lang string, phrase string, n long"

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        asked = _of_phrases(left.column("lang").combine_chunks(), left.column("phrase").combine_chunks())
        rows, weights = [], []
        for block in right.column("transducer").to_pylist():
            paths, weight = Transducer.from_bytes(block).composed(asked)
            rows.append(_phrases(asked.words, paths))
            weights.append(weight)
        none = pa.array([], pa.string())
        return pa.table({"lang": pa.concat_arrays([none, *(r[0] for r in rows)]), "phrase": pa.concat_arrays([none, *(r[1] for r in rows)]), "n": np.concatenate([np.zeros(0, np.int64), *weights])})

    out = None
    for (transducers, known), lengths in zip(rounds, ROUNDS, strict=True):
        shared = parts.sparkSession.sparkContext.broadcast(Prefixes(known.ranges, None, dict(zip(known.keys.tolist(), known.parts.tolist(), strict=True))))

        def ranged(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                split = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
                size = int(pc.list_value_length(split).to_numpy().max())
                words = [_hashes(pc.list_element(split, k).cast(pa.large_binary())) if k == 0 else _later(split, k) for k in range(size)]
                langs = _hashes(batch.column(0).cast(pa.large_string()).cast(pa.large_binary()))
                words[0] = mix(mix(langs + np.uint64(0x5851F42D4C957F2D)) ^ words[0])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.ranges_of(words), pa.int32())], ["lang", "phrase", "range"])

        mine = parts.where(F.col("words").isin(*lengths)).select("lang", "phrase").mapInArrow(ranged, "lang string, phrase string, range int")
        found = mine.groupBy("range").cogroup(transducers.select("range", "transducer").groupBy("range")).applyInArrow(compose, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _later(split: pa.Array, k: int) -> np.ndarray:
    """Hashes of the words at place k, of phrases that have as many."""
    there = pc.list_value_length(split).to_numpy() > k
    out = np.zeros(len(there), np.uint64)
    out[there] = _hashes(pc.list_element(split.filter(pa.array(there)), k).cast(pa.large_binary()))
    return out


def mine(docs: DataFrame, least: int = 30, top: int = 2000, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    a: the phrase's count; l, r: those of the two parts of its worst cut; n: words of the language;
    score: floor(2,000,000 a / (l + r)). Phrases inside a longer one with 80 % of their count are left out."""
    spark = docs.sparkSession
    ranges = ranges or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"))
    known, rounds, total = Prefixes(ranges), [], None
    for lengths in ROUNDS:
        transducers = _count_round(docs, lengths, known, least)
        rounds.append((transducers, known))
        if total is None:
            totals = transducers.select(F.explode("totals").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
            total = transducers.select(F.explode("totals").alias("lang", "n")).agg(F.sum("n")).first()[0] or 0
        if lengths != ROUNDS[-1]:
            known = _next_round(transducers, known, total)
    candidates = kept(phrases(rounds[1][0]).unionByName(phrases(rounds[2][0])).withColumn("w", F.split("phrase", " ", -1)), "candidates")

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.select("lang", "phrase", "w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"), F.size("w").alias("words"))
    cuts = kept(cuts, "cuts")
    parts = cuts.select("lang", F.col("left").alias("phrase"), F.col("k").alias("words")).unionByName(cuts.select("lang", F.col("right").alias("phrase"), (F.col("words") - F.col("k")).alias("words"))).distinct()
    counts = kept(_looked_up(parts, rounds), "parts")
    left, right = (counts.select(F.col("lang"), F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", F.expr("(2000000BD * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    # Parts of longer candidates, two words or more, with the largest count of a phrase that they lie in.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: part(start, size))))
    inner = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(80) * wide("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = stay.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
