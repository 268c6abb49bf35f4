"""Trie of conversation prefixes from z-fast tries.

    rebuilt     every conversation gets the first turns of its base and its own later ones; turns are 128-bit digests
    sequences   equal conversations become one row, with the digests of all its prefixes, its smallest conversation
                and its number of members
    tries       sequences are range-partitioned by their first turns, so that those which share prefixes meet and a
                frequent prefix is spread over tasks by what follows it. A task inserts them in batches into a
                compacted trie; a node is hashed at its handle, the prefix whose depth is the two-fattest number
                of the node's interval of depths. Fat binary search over depths finds where each sequence of
                the batch leaves the trie. At TURNS_AT_ONCE turns the task hands on its nodes and starts anew
    nodes       compacted edges are expanded: a row for each depth. Nodes that several tasks have meet by the digest of
                their prefix; there is one row from each trie for a node
    sums        sums over subtrees: a node's own value is carried by its smallest conversation, on whose path all the
                node's ancestors lie; values are summed from the end of each path and then by prefix

Defined results. Rows without conv_id belong to no conversation. Turns go by turn (null first), equal turns by role and
text; rows that repeat are turns each. Null role or text is empty. A conversation of any length is one row of its task
(48 bytes a turn); texts are digests by then. An empty table gives no nodes. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import kept

#: Turns of sequences that a task's trie holds before it is handed on.
TURNS_AT_ONCE = 1 << 20
#: Sequences that are located before any of them is inserted.
BATCH = 256
#: A conversation takes at most so many turns of its base, which is the first of BASE conversations.
FROM_BASE, BASE = 5, 100
#: Conversations of one prefix end whose ids are written as one text.
IDS_AT_ONCE = 1024
#: Turns by which sequences are range-partitioned.
SORTED_TURNS = 8
ROOT = bytes(16)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that a power of two as large as possible divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    __slots__ = ("above", "count", "depth", "ends", "least", "parent", "path")

    def __init__(self, parent: Node | None, above: int, depth: int, path: list[bytes]):
        self.parent, self.above, self.depth, self.path = parent, above, depth, path
        self.ends = self.count = 0
        self.least: int | None = None


class ZFastTrie:
    """A compacted trie of sequences that are given by the digests of all their prefixes: path[d] is that of the
    first d turns. A node has depths above + 1 .. depth of its edge."""

    def __init__(self):
        self.root = Node(None, -1, 0, [ROOT])
        self.handles: dict[bytes, Node] = {}  # digest of the prefix at a node's handle
        self.edges: dict[bytes, Node] = {}  # digest of the first prefix of a node's edge
        self.nodes, self.turns = [self.root], 0

    def exit_of(self, path: list[bytes], start: Node) -> Node:
        """The deepest node whose whole prefix begins the path, at `start` or below it: fat binary search."""
        low, high, node = start.depth, len(path) - 1, start
        while low < high:
            f = two_fattest(low, high)
            there = self.handles.get(path[f])
            if there is None:
                high = f - 1
            elif there.depth < len(path) and there.path[there.depth] == path[there.depth]:
                low, node = there.depth, there
            else:
                high = f - 1
        return node

    def _hashed(self, node: Node) -> None:
        self.handles[node.path[two_fattest(node.above, node.depth)]] = node
        self.edges[node.path[node.above + 1]] = node

    def _below(self, parent: Node, depth: int, path: list[bytes]) -> Node:
        node = Node(parent, parent.depth, depth, path)
        self._hashed(node)
        self.nodes.append(node)
        return node

    def _split(self, node: Node, depth: int) -> Node:
        """A node at `depth` of the node's edge; it takes the edge's upper part."""
        del self.handles[node.path[two_fattest(node.above, node.depth)]]
        upper = Node(node.parent, node.above, depth, node.path)
        node.parent, node.above = upper, depth
        self._hashed(upper)
        self._hashed(node)
        self.nodes.append(upper)
        return upper

    def insert(self, path: list[bytes], least: int, members: int, start: Node) -> None:
        node, end = self.exit_of(path, start), len(path) - 1
        if node.depth < end:
            edge = self.edges.get(path[node.depth + 1])
            if edge is None:
                node = self._below(node, end, path)
            else:
                low, high = node.depth + 1, min(end, edge.depth)
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if edge.path[middle] == path[middle] else (low, middle - 1)
                node = self._split(edge, low)
                if low < end:
                    node = self._below(node, end, path)
        node.ends += members
        node.least = least if node.least is None else min(node.least, least)
        self.turns += len(path)

    def insert_all(self, sequences: list[tuple[list[bytes], int, int]]) -> None:
        """Locates all sequences in the trie as it is, then inserts them, those that leave it at one node together."""
        exits = [(self.exit_of(path, self.root), path, least, members) for path, least, members in sequences]
        exits.sort(key=lambda x: x[0].depth)
        for node, path, least, members in exits:
            self.insert(path, least, members, node)

    def expanded(self) -> Iterator[tuple[bytes, int, bytes | None, int, int]]:
        """prefix, depth, prefix of the parent, members and smallest member: a row for each depth of each edge."""
        order = sorted(self.nodes, key=lambda n: -n.depth)
        for node in order:
            node.count += node.ends
            if node.parent is not None:
                node.parent.count += node.count
                if node.parent.least is None or node.least < node.parent.least:
                    node.parent.least = node.least
        for node in order:
            if node.count:
                for d in range(node.above + 1, node.depth + 1):
                    yield node.path[d], d, node.path[d - 1] if d else None, node.count, node.least


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn (digest), chars of every turn of a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("no"), turn.alias("turn"), F.char_length(text).cast("long").alias("chars"))
    # Of rows with equal turn numbers the digest decides, which is a rule by role and text.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("no"), "turn"))
    return rows.select("conv_id", place.cast("long").alias("place"), "turn", "chars")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (depth, turn, chars) in order; empty for conversations without turns."""
    turns = kept(ordered(conversations), "turns")
    base = F.col("conv_id") - F.col("conv_id") % BASE
    ids = turns.where("place = 1").select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (FROM_BASE + 1)).alias("h"))
    heads = turns.where(f"conv_id % {BASE} = 0 AND place <= {FROM_BASE}").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "turn", "chars"))).alias("head"))  # FROM_BASE at most
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (FROM_BASE + 1)).where("place > h")
    own = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "chars"))).alias("own"))
    none = F.array().cast("array<struct<place:bigint,turn:binary,chars:bigint>>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest(F.col("h").cast("int"), F.lit(1)))).otherwise(none)
    both = ids.join(heads, "base", "left").join(own, "conv_id", "left")
    return both.select("conv_id", F.concat(head, F.coalesce("own", none)).alias("turns"))


def _prefixes(turns: pa.Array) -> tuple[list[bytes], list[int]]:
    """Digests of all prefixes, the empty one first, and code points by depth."""
    path, chars = [ROOT], [0]
    for turn in turns:
        path.append(hashlib.blake2b(path[-1] + turn["turn"], digest_size=16).digest())
        chars.append(turn["chars"])
    return path, chars


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all rebuilt conversations: conv_id, last (digest of the whole); of the different ones: conv_id (the
    smallest), members, path, chars."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_prefixes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[-1] for p, _ in rows], pa.binary()), pa.array([p for p, _ in rows], pa.list_(pa.binary())), pa.array([c for _, c in rows], pa.list_(pa.int64()))],
                ["conv_id", "last", "path", "chars"],
            )

    every = kept(rebuilt(conversations).mapInArrow(hashed, "conv_id long, last binary, path array<binary>, chars array<bigint>"), "rebuilt")
    ends = every.select("conv_id", "last")
    least = ends.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members"))
    return ends, kept(every.drop("last").join(least, "conv_id"), "sequences")


def _end_digests(ends: DataFrame) -> DataFrame:
    """last, ends_sha256. Ids are joined in blocks of a range of conv_ids; a digest reads its blocks in order, one
    after the other, and holds one at a time."""
    blocks = ends.groupBy("last", F.floor(F.col("conv_id") / IDS_AT_ONCE).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for last, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = last, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["last", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["last", "ends_sha256"])

    dealt = blocks.repartition("last").sortWithinPartitions("last", "block")
    return dealt.mapInArrow(digests, "last binary, ends_sha256 string")


def _local_nodes(distinct: DataFrame) -> DataFrame:
    """prefix, depth, parent, n_convs, conv_id of the nodes of every task's tries."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(trie.expanded())
            for at in range(0, len(rows), 1 << 16):
                prefix, depth, parent, n, least = zip(*rows[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix, pa.binary()), pa.array(depth, pa.int64()), pa.array(parent, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())],
                    ["prefix", "depth", "parent", "n_convs", "conv_id"],
                )

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                trie.insert_all(list(zip(*(some.column(k).to_pylist() for k in (0, 1, 2)), strict=True)))
                if trie.turns >= TURNS_AT_ONCE:
                    yield from out()
                    trie = ZFastTrie()
        yield from out()

    firsts = [F.get("path", F.lit(k)) for k in range(1, SORTED_TURNS + 1)]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("path", "conv_id", "members").repartitionByRange(parts, *firsts).sortWithinPartitions(*firsts)
    return dealt.mapInArrow(tries, "prefix binary, depth long, parent binary, n_convs long, conv_id long")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    ends, distinct = sequences(conversations)
    merged = _local_nodes(distinct).groupBy("prefix").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    merged = kept(merged, "nodes")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    whole = kept(merged.join(children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # A node's values lie on the path of its smallest conversation, whose row of that depth it is.
    owned = whole.select("conv_id", "depth", "n_convs", (F.col("n_children") == 0).cast("long").alias("leaf"))
    paths = distinct.select("conv_id", F.posexplode(F.arrays_zip("path", "chars")).alias("depth", "turn")).select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("turn.path").alias("prefix"), F.col("turn.chars").alias("chars"))
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = paths.join(owned, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "prefix", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce((F.col("n_convs") - 1) * F.col("chars"), F.lit(0)).alias("saved")
    )
    sums = own.select("prefix", F.sum("leaf").over(from_end).alias("leaf"), F.sum("saved").over(from_end).alias("saved")).groupBy("prefix").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = whole.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    no_ends: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = whole.join(sums, "prefix").join(_end_digests(ends).withColumnRenamed("last", "prefix"), "prefix", "left").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """prefix, depth, parent, n_convs, conv_id: the expanded trie itself, digests of prefixes as keys."""
    merged = _local_nodes(sequences(conversations)[1]).groupBy("prefix")
    return merged.agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
