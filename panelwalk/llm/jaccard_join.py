"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

Two sets can only be as alike as SHARE / 100 if they share one of the first n - ceil(SHARE n / 100) + 1
n-grams of each, in any common order; so only these columns of the matrix are multiplied to find pairs. Spark
deals the columns to blocks by n-gram; products are summed by pair, and a pair is discarded when what its
sizes and places leave cannot reach the least overlap. The order puts first the n-grams that no counting task
has met in two sets and last those that several sets of one task held.

Equal sets are one node (128 bits of hash). A column of many nodes would give a product for every pair, so it
is multiplied in steps:

1. Stars. The pivot of a column is its node with the largest share of late n-grams, which is the text that the
   others are copies of where there is one. Each node's row is multiplied with its pivots' rows only: a block is
   a batch of rows in CSR form times the pivot's row. What reaches the bound is linked.
2. Differences. Two nodes of one star differ from the pivot in known n-grams, some added and some removed. They
   can only be linked, and not yet be of one component, if they share so many of these differences that they
   share one of the first few, added ones first. The columns of these differences are multiplied as stars
   again, and only what these leave is paired: copies that were changed in places of their own share none.
3. The rest. Nodes that failed a pivot's bound meet the other nodes of the column by classes of size, where
   one of each pair must have the n-gram early enough to reach a set of its own size.

Pairs of one component are never formed: they cannot change it. A row of the matrix is made from its text in
the task that multiplies it, for the text is half as long as its row; texts travel compressed one by one, and those of
the stars are set apart, so that products of stars don't deal out all others.

Defined results: a null or empty text has no n-grams and is linked with nothing; a text of fewer than n
words is one n-gram; rows that repeat are equal sets; a doc_id with several texts belongs to all their
components, which it joins; a null doc_id gets a null component; of equal candidates for a pivot the least node
is taken, which settles no result; long texts count whole and are one row of a block; an empty table gives
none; other columns, whatever their names, are ignored by links() and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import CHUNK_BYTES, LOWER, Ranges, identified, kept, mix, settled, signed, slices, spare, utf8, word_bounds, word_hashes

#: n-grams that several sets of a counting task hold are reported, and the most frequent, at most OFTEN, go to
#: the end of the order.
OFTEN = 1 << 20
#: Bytes of text after which a counting task reports.
COUNT_BYTES = 16 << 20
#: Classes of size: each reaches this factor beyond the one before it. A row goes to every class of its partners, so
#: narrow classes cost more rows than they save pairs.
CLASS = 1.04


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its distinct n-grams, and the bytes that each one spans."""
    starts, ends, at = word_bounds(data, offsets)
    ranges = Ranges(word_hashes(LOWER[data], starts, ends))
    full = ranges.all_of(n)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= n:
            hashes, first = np.unique(full[a : b - n + 1], return_index=True)
            # Bytes of the words alone: white space between them may differ.
            sizes = np.cumsum(np.r_[0, ends[a:b] - starts[a:b]])
            yield hashes, (sizes[n:] - sizes[:-n])[first]
        elif b > a:
            yield ranges.of(np.array([a]), np.array([b - a])), np.array([int((ends[a:b] - starts[a:b]).sum())])
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _prefix_length(n: int, share: int) -> int:
    return n - (share * n + 99) // 100 + 1 if n else 0


def _node(hashes: np.ndarray) -> bytes:
    """128 bits for a set: two sums of differently mixed hashes, and its size."""
    one = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True) + np.uint64(len(hashes))
    two = mix(hashes * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)).sum(keepdims=True)
    return np.r_[mix(one), mix(two)].tobytes()


def _often(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of frequent n-grams, at most OFTEN: they settle the order only, never the result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0

        def report() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(hashes[counts > 1])), pa.array(counts[counts > 1])], ["gram", "n"])

        for batch in slices(batches):
            data, offsets = utf8(batch.column(0))
            for hashes, _ in gram_sets(data, offsets, n):
                if len(hashes):
                    sets[_node(hashes)] = hashes
            size += len(data)
            if size >= COUNT_BYTES and sets:
                yield report()
                sets, size = {}, 0
        if sets:
            yield report()

    found = kept(docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.least(F.sum("n"), F.lit(4096)).alias("n")), "often")
    # The least count of which no more than OFTEN n-grams have as much; a row for each of 4,096 counts at most.
    held = sorted(((r.n, r.k) for r in found.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = 4097, 0
    for count, k in held:
        if (total := total + k) > OFTEN:
            break
        least = count
    return np.sort(found.where(F.col("n") >= least).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _columns(docs: DataFrame, n: int, share: int, often: np.ndarray) -> DataFrame:
    """doc_id, text_key, node, size, late (per mille of late n-grams) and the n-grams of the prefix, by row."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in slices(batches):
            nodes, sizes, lates, prefixes = [], [], [], []
            for hashes, spans in gram_sets(*utf8(batch.column(2)), n):
                at = np.minimum(np.searchsorted(last, hashes), max(0, len(last) - 1))
                late = last[at] == hashes if len(last) else np.zeros(len(hashes), bool)
                order = np.lexsort((hashes, -spans, late))[: _prefix_length(len(hashes), share)]
                nodes.append(_node(hashes) if len(hashes) else None)
                sizes.append(len(hashes))
                lates.append(int(late.sum()) * 1000 // max(1, len(hashes)))
                prefixes.append(signed(hashes[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lates, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "size", "late", "grams"])

    return docs.mapInArrow(work, "doc_id long, text_key long, node binary, size long, late int, grams array<long>")


def _differences(mine: np.ndarray, pivot: np.ndarray, share: int) -> tuple[int, list[int], list[int]]:
    """Overlap of a set with its pivot's, the first of its differences, and a role for each of these: 0 of a set
    that is linked with the pivot, 1 of another, 2 of another where it can only meet a 0.

    With r removed and a added n-grams, f = 100 r + share a, two sets of the star are linked if they share at
    least (f + f' - (100 - share) |pivot|) / (100 + share) differences; one is linked with the pivot itself
    if f <= (100 - share) |pivot|."""
    at = np.minimum(np.searchsorted(pivot, mine), len(pivot) - 1)
    inside = pivot[at] == mine
    common = int(inside.sum())
    lost = np.ones(len(pivot), bool)
    lost[at[inside]] = False
    added, removed = mine[~inside], pivot[lost]
    f, free = 100 * len(removed) + share * len(added), (100 - share) * len(pivot)
    every = np.concatenate([added, removed])
    with_other = f // (100 + share) + 1  # differences shared with a set that the pivot isn't linked with
    if f <= free:
        first = max(0, len(every) - with_other + 1)
        return common, signed(every[:first]).tolist(), [0] * first
    with_any = -(-(f - free) // 100)
    long, short = max(0, len(every) - with_any + 1), max(0, len(every) - max(with_any, with_other) + 1)
    return common, signed(every[:long]).tolist(), [1] * short + [2] * (long - short)


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed, each by itself, after its size in eight bytes."""
    place = rows.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in slices(batches):
            raw = batch.column(place).cast(pa.large_binary()).to_pylist()
            packed = pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield batch.set_column(place, "text", packed)

    return rows.mapInArrow(work, ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema))


def _unpacked(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, bytes and offsets of pieces of a column of packed texts, of at most `most` bytes but for single rows."""
    codec, packed = pa.Codec("zstd"), column.to_pylist()
    ends = np.cumsum([int.from_bytes(x[:8], "little") for x in packed])
    start = 0
    while start < len(packed):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        offsets = np.r_[0, ends[start:stop] - before]
        raw = [codec.decompress(x[8:], decompressed_size=int(size), asbytes=True) if size else b"" for x, size in zip(packed[start:stop], np.diff(offsets), strict=True)]
        yield start, np.frombuffer(b"".join(raw), np.uint8), offsets
        start = stop


def _product(pairs: DataFrame, texts: DataFrame, n: int, share: int) -> DataFrame:
    """For pairs (a, b) of nodes: whether their sets are linked, with size_b and the first differences of b from a."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, row = None, None
        for batch in batches:
            pivots = batch.column(0).to_pylist()
            for start, data, offsets in _unpacked(batch.column(3)):
                sizes, linked, firsts, roles = [], [], [], []
                for i, (mine, _) in enumerate(gram_sets(data, offsets, n), start):
                    if pivots[i] != pivot:
                        pivot, (_, *text) = pivots[i], next(_unpacked(batch.column(2).slice(i, 1)))
                        row = next(gram_sets(*text, n))[0]
                    common, first, role = _differences(mine, row, share)
                    sizes.append(len(mine))
                    linked.append(100 * common >= share * (len(mine) + len(row) - common))
                    firsts.append(first)
                    roles.append(role)
                part = batch.slice(start, len(sizes))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(roles, pa.list_(pa.int32()))], ["a", "b", "linked", "size_b", "firsts", "roles"])

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right_text")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left_text")), "a")
    return both.select("a", "b", "left_text", "right_text").mapInArrow(work, "a binary, b binary, linked boolean, size_b long, firsts array<long>, roles array<int>")


def _near(a: str, b: str, share: int) -> Column:
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(CLASS))).cast("int")


def _difference_columns(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """Columns (a, gram) of the first differences from each pivot that nodes of several components share, of which
    one at least isn't linked with the pivot: node, size, role, part, and how many differences the node brought."""
    entries = stars.join(parts.withColumnRenamed("node", "b"), "b", "left").select("a", F.col("b").alias("node"), F.col("size_b").alias("size"), F.coalesce("least", "b").alias("part"), F.size("firsts").alias("brought"), F.explode(F.arrays_zip("firsts", "roles")).alias("x"))
    entries = entries.select("a", "node", "size", "part", "brought", F.col("x.firsts").alias("gram"), F.col("x.roles").alias("role"))
    shared = entries.groupBy("a", "gram").agg(F.count("*").alias("k"), F.count_if(F.col("role") == 0).alias("in"), F.count_if(F.col("role") == 1).alias("out"), F.min("part").alias("low"), F.max("part").alias("high"))
    shared = shared.where("k > 1 and low <> high and (in > 0 and in < k or out > 1)").select("a", "gram")
    return kept(entries.join(shared, ["a", "gram"]), "differences")


def _inner_stars(columns: DataFrame) -> DataFrame:
    """Pairs of the nodes of each column with its pivot: the node of whose differences the largest share is shared."""
    central = columns.groupBy("a", "node").agg((-F.count("*") / F.first("brought")).alias("share"))
    best = columns.select("a", "gram", "node").join(central, ["a", "node"]).groupBy("a", "gram").agg(F.min(F.struct("share", "node")).alias("best"))
    pairs = columns.select("a", "gram", "node").join(best, ["a", "gram"]).select(F.col("best.node").alias("a"), F.col("node").alias("b"))
    return pairs.where("a <> b").distinct()


def _by_difference(columns: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes of different components that share one of their first differences from a pivot."""
    left, right = (columns.select("a", "gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "role", "part")]) for s in "xy")
    meet = ((F.col("role_x") == 0) & (F.col("role_y") > 0)) | ((F.col("role_x") == 1) & (F.col("role_y") == 1) & (F.col("node_x") < F.col("node_y")))
    return left.join(right, ["a", "gram"]).where(meet & (F.col("part_x") != F.col("part_y")) & _near("size_x", "size_y", share)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def _by_size(entries: DataFrame, stars: DataFrame, parts: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes of one column but of different components of which one has no product with the pivot."""
    inside = stars.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("in"))
    labelled = entries.drop("late").join(parts, "node", "left").withColumn("part", F.coalesce("least", "node")).drop("least")
    labelled = labelled.join(inside, ["pivot", "node"], "left").withColumn("in", F.coalesce("in", F.col("node") == F.col("pivot")))
    labelled = kept(labelled, "labelled")
    mixed = labelled.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("in").alias("all_in")).where("low <> high and not all_in").select("gram")
    # The largest partner with which an overlap that begins at this place can reach the least one.
    reach = (F.floor((F.col("size") - F.col("place")) * (100 + share) / share) - F.col("size")).alias("reach")
    left = labelled.join(mixed, "gram", "left_semi").select("gram", "node", "size", "place", "part", "in", reach)
    early = left.where("reach >= size").select("gram", _class(F.col("size")).alias("class"), *[F.col(c).alias(f"{c}_y") for c in ("node", "size", "reach", "part", "in")])
    low, high = F.ceil(F.col("size") * share / 100), F.least("reach", F.floor(F.col("size") * 100 / share))
    wide = left.where(high >= low).select("gram", F.explode(F.sequence(_class(low), _class(high))).alias("class"), *[F.col(c).alias(f"{c}_x") for c in ("node", "size", "reach", "part", "in")])
    once = (F.col("reach_x") < F.col("size_x")) | (F.col("node_x") < F.col("node_y"))
    meet = (F.col("part_x") != F.col("part_y")) & ~(F.col("in_x") & F.col("in_y")) & (F.col("size_y") <= F.col("reach_x")) & (F.col("size_x") <= F.col("reach_y")) & once & _near("size_x", "size_y", share)
    return wide.join(early, ["gram", "class"]).where(meet).groupBy("node_x", "node_y", "size_x", "size_y").agg(F.count("*").alias("shared")).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def links(docs: DataFrame, n: int = 3, share: int = 90) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row."""
    return settled(docs.sparkSession, lambda: _links(docs, n, share), "linked")


def _links(docs: DataFrame, n: int, share: int) -> DataFrame:
    own = identified(docs)
    rows = kept(_columns(own, n, share, _often(own, n)), "columns")
    entries = rows.where("node is not null").select("node", "size", "late", "grams").dropDuplicates(["node"])
    entries = entries.select("node", "size", "late", F.posexplode("grams").alias("place", "gram")).repartition("gram")
    # The least of all columns, though a node is in a column once: what is dealt out serves both the minimum and the join.
    shared = entries.groupBy("gram").agg(F.min(F.struct(-F.col("late"), "node", "size", "place")).alias("best"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("best.node").alias("pivot"))
    entries = kept(entries.join(shared, "gram").select("gram", "pivot", "node", "size", "place", "late"), "entries")

    chosen = entries.select("node").distinct().join(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at")), "node")
    k = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k")
    texts = _packed(own.select(k, "text_key", "text")).join(chosen.select("node", "at.doc_id", "at.text_key").select("node", k, "text_key"), ["k", "text_key"])
    texts = kept(texts.groupBy("k", "text_key", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")

    known = rows.where("doc_id is not null and node is not null").select("doc_id", "node").distinct()
    same_id = known.join(known.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))

    # What the prefixes share and what lies behind the one that ends first must reach the least overlap.
    sizes = rows.where("node is not null").groupBy("node").agg(F.first("size").alias("size"))
    behind = F.floor((share * F.greatest("size_a", "size_b") + 99) / 100) - 1
    least = F.ceil(F.lit(share) * (F.col("size_a") + F.col("size_b")) / (100 + share))
    stars = entries.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("size").alias("size_b")).agg(F.count("*").alias("shared"))
    stars = stars.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").where(_near("size_a", "size_b", share) & (F.col("shared") + behind >= least)).select("a", "b")
    stars = kept(stars, "pairs")
    near = kept(texts.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("shuffle_hash"), "node", "left_semi"), "near")
    stars = kept(_product(stars, near, n, share), "stars")
    found = kept(stars.where("linked").select("a", "b").unionByName(same_id), "links")
    inner = kept(_product(_inner_stars(_difference_columns(stars, components(found))), near, n, share), "stars")
    found = kept(found.unionByName(inner.where("linked").select("a", "b")), "links")
    parts = components(found)

    def rest() -> DataFrame:
        pairs = _by_difference(_difference_columns(inner, parts), share).unionByName(_by_size(entries, stars, parts, share))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # A step, so that what pairs are found by is gone when texts are dealt out.
    pairs = settled(docs.sparkSession, rest, "pairs")
    more = _product(pairs, texts, n, share).where("linked").select("a", "b")
    found = components(found.unionByName(more))

    joined = rows.select("doc_id", "text_key", "size", "node").join(found, "node", "left").select("doc_id", "text_key", "size", F.coalesce("least", "node").alias("part"))
    least_id = joined.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    alone = joined.where("part is null").select("doc_id", "text_key", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    together = joined.join(least_id, "part").select("doc_id", "text_key", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return together.unionByName(alone)


def representatives(docs: DataFrame, n: int = 3, share: int = 90) -> DataFrame:
    """The rows of docs that stay: of each component the row of its least doc_id (of its least text key
    where that repeats); rows without n-grams and rows without doc_id stay."""
    found = links(docs, n, share)
    best = found.where("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
    i, key, empty, there = (spare(docs, x) for x in ("id", "key", "empty", "in"))
    stay = best.select(F.col("at.doc_id").alias(i), F.col("at.text_key").alias(key), F.lit(True).alias(there))
    own = docs.withColumns({i: F.col("doc_id").cast("long"), key: F.xxhash64("text"), empty: ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]") | F.col("doc_id").isNull()})
    chosen = own.join(stay, [i, key], "left").where(F.col(empty) | F.col(there))
    # Rows that repeat with equal doc_id and text are one document.
    once = chosen.where(~F.col(empty)).dropDuplicates([i, key])
    return once.unionByName(chosen.where(F.col(empty))).select(*[F.col(f"`{c}`") for c in docs.columns])
