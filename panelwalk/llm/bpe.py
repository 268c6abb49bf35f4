"""Byte-pair vocabularies of tokenizers .json files: pre-tokens, merges as sorted arrays, two ways to merge.

Both ways give what the library's model gives: of all adjacent pairs the one of lowest rank is merged,
the leftmost first, until no pair is in the list of merges. A merge yields a symbol that no earlier
merge uses, so all places of the lowest pair can be merged together (leftmost first where they overlap).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from typing import NamedTuple

import numpy as np
import regex
from tokenizers import Tokenizer

from .text import SPACE, same_bytes, word_hashes

#: Rank of a pair that cannot be merged.
NEVER = np.int64(1) << 40
#: Most units that a worker remembers; it starts anew beyond that.
MEMORY = 1 << 20
#: Most units that are cut and merged together.
PART = 1 << 18
#: Scripts whose letters, digits and spaces all Unicode versions class alike; a text with others is cut
#: by the library's own rules.
SETTLED = re.compile("[\x00-ԯ‐-‧‰-⁞　-〿ぁ-ゖ゠-ヿ一-龥가-힣！-～]*")
#: Words of more symbols than this get a tree of their own.
LONG_WORD = 256

# The byte-level alphabet and the patterns of the two public files.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD_LEVEL = CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in PRINTABLE else spare))
        spare += b not in PRINTABLE
    return out


class Vocabulary:
    """Arrays of a .json file: first symbols by byte, merges sorted by pair, strings by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lower = bool(spec["normalizer"])
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(WORD_LEVEL if self.lower else BYTE_LEVEL)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.first = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + self.suffix] for c in alphabet], np.int64)
        size = max([*ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), pairs[order, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that mergeable pairs give."""
        return self.made[np.searchsorted(self.keys, left << 20 | right)]

    def cut(self, text: str) -> list[str]:
        """Pieces of a text that are merged on their own."""
        if self.lower:
            # The library lowers character by character: no special case for a sigma that ends a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def whole(self, text: str) -> list[bytes | int]:
        """The pieces of any text by the library's rules; an int stands for a special string in it."""
        out: list[bytes | int] = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part and SETTLED.fullmatch(part):
                out += map(str.encode, self.cut(part))
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.lower else part
                alphabet = {c: b for b, c in enumerate(byte_alphabet())}
                out += [bytes(alphabet[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def symbols(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all pieces, one after the other, and n + 1 offsets."""
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.first[data]
        if self.suffix and len(data):
            ids[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        return ids, offsets


    def decode(self, ids) -> str:
        """As the library's decode with special tokens kept: pieces joined by spaces where the file
        names no decoder, else the bytes that the pieces stand for."""
        pieces = map(self.strings.__getitem__, ids)
        if self.suffix:
            return " ".join(pieces)
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        return bytes(alphabet[c] for c in "".join(pieces)).decode("utf-8", "replace")


class Table:
    """64-bit hashes to entry numbers: open addressing in an array, many hashes at a time."""

    def __init__(self, most: int):
        self.keys, self.entry, self.size, self.most = np.zeros(4 * most, np.uint64), np.zeros(4 * most, np.int32), 0, most

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entries, -1 where there is none."""
        out, todo, mask = np.full(len(hashes), -1, np.int32), np.arange(len(hashes)), len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == hashes[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """New entries for different hashes that aren't in the table."""
        numbers, mask = np.arange(self.size, self.size + len(hashes), dtype=np.int32), len(self.keys) - 1
        self.size += len(hashes)
        todo, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]
            mine = self.keys[at] == hashes[todo]
            self.entry[at[mine]] = numbers[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & mask
        return numbers


def _other_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of units whose hash another unit has."""
    salt = turn.to_bytes(8, "little")
    return np.array([int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8, salt=salt).digest(), "little") | 1 for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


class Units(NamedTuple):
    """Units of a batch: ids[start : start + count] of its entry is what a unit came to."""

    entries: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    count: np.ndarray
    at: np.ndarray  # offsets by text
    whole: np.ndarray  # texts that are cut as a whole


class Encoder:
    """Encodes batches of texts and remembers what their units came to.

    A unit is what lies between two blanks, with the blank before it. No piece goes on beyond a blank,
    which begins the next piece unless white space comes before it. Texts with such runs, special
    strings or letters of unsettled scripts are cut as a whole instead."""

    def __init__(self, v: Vocabulary, merge):
        self.v, self.merge = v, merge
        self.forget()

    def forget(self) -> None:
        self.table = Table(MEMORY)
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.count = np.zeros(MEMORY + 1, np.int64), np.zeros(MEMORY + 1, np.int64)
        self.bytes, self.bytes_used = np.zeros(1 << 20, np.uint8), 0
        self.place, self.size = np.zeros(MEMORY + 1, np.int64), np.zeros(MEMORY + 1, np.int64)

    def merged(self, parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each part's pieces, one after the other, and offsets by part."""
        pieces: dict[bytes, int] = {}
        use = np.array([pieces.setdefault(x, len(pieces)) for part in parts for x in part], np.int64)
        ids, offsets = self.merge(self.v, *self.v.symbols(list(pieces)))
        stops = np.cumsum(np.r_[0, np.diff(offsets)[use]])
        return gathered(ids, offsets[use], np.diff(stops)), stops[np.cumsum([0, *map(len, parts)])]

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        """The units of all texts, and which texts are cut as a whole."""
        blank = data == 0x20
        odd = data >= 0xD5
        odd[1:] |= blank[1:] & SPACE[data[:-1]] | (data[1:] == 0x7C) & (data[:-1] == 0x3C)
        odd[2:] |= blank[2:] & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)) & (data[:-2] == 0xC2)
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        lengths = np.diff(offsets)
        mine = np.repeat(~whole, lengths)
        begins = blank & mine
        firsts = offsets[:-1][~whole & (lengths > 0)]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(data)]
        text = np.searchsorted(offsets, starts, "right") - 1
        ends = np.minimum(ends, offsets[text + 1])
        hashes = word_hashes(data, starts, ends) | np.uint64(1)
        if self.table.size + len(hashes) > MEMORY and self.table.size > MEMORY // 2:
            self.forget()
        found, ids, start, count = self.looked_up(data, starts, ends, hashes)
        return Units(found, ids, start, count, np.searchsorted(starts, offsets), np.flatnonzero(whole))

    def looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the units, and the ids, starts and counts that they refer to. Units that the memory has
        no room for are encoded in parts and not remembered: their entries follow the memory's. The bytes of each
        unit are held against those remembered for its hash; where they differ, the unit gets another hash."""
        found = self.table.find(hashes)
        sizes = ends - starts
        known, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        clash = np.zeros(len(hashes), bool)
        clash[known] = ~self._remembered(data, starts[known], sizes[known], found[known])
        fresh, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
        leads = new[first][back]
        clash[new] = (sizes[new] != sizes[leads]) | ~same_bytes(data, starts[new], np.minimum(sizes[new], sizes[leads]), data, starts[leads])
        if clash.any():
            again = hashes.copy()
            again[clash] = _other_hashes(data, starts[clash], ends[clash], turn)
            return self.looked_up(data, starts, ends, again, turn + 1)
        if not len(new):
            return found, self.ids, self.start, self.count
        if self.table.size and self.table.size + len(fresh) > MEMORY:
            self.forget()
            return self.looked_up(data, starts, ends, hashes, turn)
        at = new[first]
        for part in range(0, min(len(fresh), MEMORY), PART):
            some = slice(part, min(part + PART, MEMORY))
            ids, stops = self.encoded(data, starts[at[some]], ends[at[some]])
            numbers = self.table.add(fresh[some])
            while self.used + len(ids) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            self.ids[self.used : self.used + len(ids)] = ids
            self._remember(data, starts[at[some]], sizes[at[some]], numbers)
            self.start[numbers], self.count[numbers] = self.used + stops[:-1], np.diff(stops)
            self.used += len(ids)
        if len(fresh) <= MEMORY:
            found[new] = self.table.find(fresh)[back]
            return found, self.ids, self.start, self.count
        # The memory was empty, so its entries are those of the first MEMORY fresh units.
        found[new] = back
        more, counts = [self.ids[: self.used]], [self.count[:MEMORY]]
        for part in range(MEMORY, len(fresh), PART):
            ids, stops = self.encoded(data, starts[at[part : part + PART]], ends[at[part : part + PART]])
            more.append(ids.astype(np.int32))
            counts.append(np.diff(stops))
        count = np.concatenate(counts)
        return found, np.concatenate(more), np.cumsum(count) - count, count

    def _remember(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> None:
        units = gathered(data, starts, sizes)
        while self.bytes_used + len(units) + 8 > len(self.bytes):
            self.bytes = np.r_[self.bytes, np.zeros_like(self.bytes)]
        self.bytes[self.bytes_used : self.bytes_used + len(units)] = units
        self.place[numbers], self.size[numbers] = self.bytes_used + np.cumsum(sizes) - sizes, sizes
        self.bytes_used += len(units)

    def _remembered(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether the units have the bytes of their entries."""
        equal = sizes == self.size[numbers]
        equal[equal] = same_bytes(data, starts[equal], sizes[equal], self.bytes, self.place[numbers[equal]], np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, strides=(1,)))
        return equal

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units and their offsets, without a look at the memory."""
        return self.merged([[x.encode() for x in self.v.cut(data[a:b].tobytes().decode("utf-8", "replace"))] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


    def apart(self, data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts that are cut as a whole."""
        out = []
        for i in which.tolist():
            pieces = self.v.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            ids, stops = self.merged([[x] if isinstance(x, bytes) else [] for x in pieces])
            if any(isinstance(x, int) for x in pieces):
                ids = np.concatenate([[x] if isinstance(x, int) else ids[a:b] for x, a, b in zip(pieces, stops, stops[1:], strict=False)])
            out.append(ids)
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many symbols are left of each text."""
        units = self.units(data, offsets)
        sums = np.cumsum(np.r_[0, units.count[units.entries]])
        out = sums[units.at[1:]] - sums[units.at[:-1]]
        out[units.whole] = [len(x) for x in self.apart(data, offsets, units.whole)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and n + 1 offsets."""
        units = self.units(data, offsets)
        sizes, whole = units.count[units.entries], units.whole
        ids, stops = gathered(units.ids, units.start[units.entries], sizes), np.cumsum(np.r_[0, sizes])[units.at]
        if not len(whole):
            return ids, stops
        each = np.split(ids, stops[1:-1])
        for i, x in zip(whole.tolist(), self.apart(data, offsets, whole), strict=True):
            each[i] = x.astype(np.int32)
        return np.concatenate(each), np.cumsum([0, *map(len, each)])


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all ranges, one after the other."""
    stops = np.cumsum(sizes)
    return values[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, merge) -> Encoder:
    """The encoder of a Python worker, which lives on from task to task."""
    return Encoder(vocabulary(path), merge)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_in_step(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging of ragged sequences: in each round every sequence that still has a
    mergeable pair applies its lowest-ranked pair at all its places at once.
    Returns the surviving symbols and the new offsets."""
    n = len(offsets) - 1
    counts = np.diff(offsets)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seq = np.repeat(np.arange(n), counts)
    ranks = np.full(len(ids), NEVER)  # of the pair that begins at each symbol
    if len(ids) > 1:
        same = seq[:-1] == seq[1:]
        ranks[:-1][same] = v.rank(ids[:-1][same], ids[1:][same])
    while len(ids):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        best = np.minimum.reduceat(ranks, starts)
        if (over := best == NEVER).any():
            out = np.repeat(over, sizes)
            done.append((seq[starts[over]], sizes[over], ids[out]))
            ids, seq, ranks = ids[~out], seq[~out], ranks[~out]
            best, sizes = best[~over], sizes[~over]
            if not len(ids):
                break
        hit = ranks == np.repeat(best, sizes)
        if (hit[1:] & hit[:-1]).any():  # runs such as aaa: every second place
            at = np.arange(len(hit))
            begins = hit & ~np.r_[False, hit[:-1]]
            hit &= (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
        at = np.flatnonzero(hit)
        ids[at] = v.merged(ids[at], ids[at + 1])
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ranks[at] = ranks[at + 1]
        moved = np.cumsum(keep) - 1
        ids, seq, ranks = ids[keep], seq[keep], ranks[keep]
        at = moved[at]
        for left in (at, at[at > 0] - 1):
            left = left[left + 1 < len(ids)]
            left = left[seq[left] == seq[left + 1]]
            ranks[left] = v.rank(ids[left], ids[left + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    which, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
    lengths = np.zeros(n, np.int64)
    lengths[which] = sizes
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    place = np.repeat(ends[which], sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    result = np.empty(len(flat), np.int64)
    result[place] = flat
    return result, ends


def merge_by_trees(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merging with a segment tree over adjacent pair ranks for each word.

    A leaf holds rank * width + place of the pair that begins at its symbol, an inner node the least of
    its two children; the root thus is the leftmost pair of lowest rank. A merge changes at most three
    leaves, each of which costs one way up the tree. Words whose trees have the same width are worked
    on together, a row for each word; long words one by one."""
    n, counts = len(offsets) - 1, np.diff(offsets)
    widths = 1 << np.ceil(np.log2(np.maximum(counts, 2))).astype(int)
    flat: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        if width > LONG_WORD:
            for w in which:
                flat[w] = _one_tree(v, ids[offsets[w] : offsets[w + 1]], int(width))
            continue
        for part in np.array_split(which, max(1, len(which) * int(width) // 400_000)):
            rows, alive = _tree_rows(v, ids, offsets[part], counts[part], int(width))
            sizes = alive.sum(1)
            for w, x in zip(part, np.split(rows[alive], np.cumsum(sizes)[:-1]), strict=True):
                flat[w] = x
    ends = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) for x in flat], out=ends[1:])
    return (np.concatenate(flat) if n else np.zeros(0, np.int64)), ends


def _tree_rows(v: Vocabulary, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    m, place = len(starts), np.arange(width)
    alive = place < counts[:, None]
    sym = np.where(alive, ids[np.minimum(starts[:, None] + place, len(ids) - 1)], 0) if len(ids) else np.zeros((m, width), np.int64)
    after = np.where(place + 1 < counts[:, None], place + 1, width)  # the next symbol that is left, or width
    before = np.repeat(place[None, :] - 1, m, 0)
    tree = np.full((m, 2 * width), NEVER * width)
    pairs = after < width
    pairs_at = np.nonzero(pairs)
    tree[:, width:][pairs_at] = v.rank(sym[pairs_at], sym[pairs_at[0], pairs_at[1] + 1]) * width + pairs_at[1]
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < NEVER * width)
    while len(rows):
        at = tree[rows, 1] % width
        right = after[rows, at]
        sym[rows, at] = v.merged(sym[rows, at], sym[rows, right])
        alive[rows, right] = False
        beyond = after[rows, right]
        after[rows, at] = beyond
        has = beyond < width
        before[rows[has], beyond[has]] = at[has]
        leaf = np.full(len(rows), NEVER * width)
        leaf[has] = v.rank(sym[rows[has], at[has]], sym[rows[has], beyond[has]]) * width + at[has]
        prior = before[rows, at]
        had = prior >= 0
        prior_leaf = v.rank(sym[rows[had], prior[had]], sym[rows[had], at[had]]) * width + prior[had]
        # The leaf that vanished first, then the merged symbol's and the one before it.
        for r, p, value in ((rows, right, NEVER * width), (rows, at, leaf), (rows[had], prior[had], np.where(prior_leaf >= NEVER * width, NEVER * width, prior_leaf))):
            node = p + width
            tree[r, node] = np.minimum(value, NEVER * width)
            while node[0] > 1 if len(node) else False:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] < NEVER * width]
    return sym, alive


def _one_tree(v: Vocabulary, ids: np.ndarray, width: int) -> np.ndarray:
    """The same for one long word, in plain integers."""
    never = int(NEVER) * width
    sym, n = ids.tolist(), len(ids)
    after, before = [*range(1, n), width], [*range(-1, n - 1)]
    tree = [never] * (2 * width)
    ranks = v.rank(ids[:-1], ids[1:])
    for i, r in enumerate(ranks.tolist()):
        if r < NEVER:
            tree[width + i] = r * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r = int(v.rank(np.array([a]), np.array([b]))[0])
            known[a, b] = (r, int(v.merged(np.array([a]), np.array([b]))[0]) if r < NEVER else -1)
        return known[a, b]

    def put(place: int, value: int) -> None:
        node = place + width
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    gone = bytearray(n)
    while tree[1] < never:
        at = tree[1] % width
        right = after[at]
        sym[at] = pair(sym[at], sym[right])[1]
        gone[right] = 1
        put(right, never)
        beyond = after[at] = after[right]
        if beyond < width:
            before[beyond] = at
            r = pair(sym[at], sym[beyond])[0]
            put(at, r * width + at if r < NEVER else never)
        else:
            put(at, never)
        if (prior := before[at]) >= 0:
            r = pair(sym[prior], sym[at])[0]
            put(prior, r * width + prior if r < NEVER else never)
    return np.array([s for s, g in zip(sym, gone, strict=True) if not g], np.int64)
