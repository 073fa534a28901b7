"""Near-duplicates by SimHash and BK-trees.

The distinct words of a text vote on a fingerprint of two 64-bit lanes. Two
texts are near-duplicates when the first lanes differ in at most ``radius``
bits and the second in at most ``second_radius``. The second lane has votes of
its own and keeps apart texts whose first lanes are close by chance. Votes of
few words are coarse, so two texts with at most ``SMALL`` distinct words
together must also have a word-set Jaccard of ``least_jaccard``, as estimated
by an odd sketch of 128 bits (the parity of the words that hash to a bit, so
that the exclusive or of two sketches tells how many words only one has).

Search is exact. A first lane is four blocks of 16 bits. Of two lanes within
``radius``, some block differs in at most ``radius // 4`` bits. Fingerprints
are therefore sharded by block and by the block's leading bits, more of them
the more fingerprints there are. A BK-tree over the shard keys, whose size is
bounded by ``2**16`` and does not grow with the data, is broadcast and routes
each fingerprint to the shards within the block radius. In each shard a second
BK-tree over the block values finds, along edges within the radius, the
members to compare in full; where one value has many members, BK-trees over
the values of the other blocks narrow them down first (three blocks that
differ in ``radius`` bits have one within ``radius // 3``). Broadcasting the
shards' own trees would mean broadcasting the corpus; they are built where
their members are instead.

How many fingerprints a shard gets is counted beforehand. A shard with more
than ``group_rows`` is split into a grid of those that ask and those that are
members, so that no task holds more than that, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .common import forget, keep_rows, words_of, written

RADIUS = 11
SECOND_RADIUS = 14
LEAST_JACCARD = 0.6
#: Two texts with so many distinct words in all are also held by their sketches; of larger sets 128 bits say little.
SMALL = 128
GROUP_ROWS = 2_000_000
_BLOCKS, _BLOCK_BITS, _LEAST_BITS = 4, 16, 6
_SLICE = 1 << 18
_MEMBER, _ASKS = 1, 2
_NODE = "f1 long, f2 long, s1 long, s2 long, words int"


def mixed(values: np.ndarray) -> np.ndarray:
    """A second 64-bit hash from the first (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = values + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _votes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes for each run ``values[offsets[i]:offsets[i+1]]``; runs must not be empty.

    A bit is set when more than half of the values have it.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    lanes = []
    for lane in range(2):
        ones = np.zeros((n, 64), dtype=np.int64)
        for lo in range(0, len(values), _SLICE):
            hi = min(lo + _SLICE, len(values))
            first = np.searchsorted(offsets, lo, side="right") - 1
            last = np.searchsorted(offsets, hi, side="left")
            part = np.ascontiguousarray(values[lo:hi])
            starts = np.maximum(offsets[first:last], lo) - lo
            ones[first:last] += _votes(mixed(part) if lane else part, starts)
        set_bits = (2 * ones > sizes[:, None]).astype(np.uint8)
        lanes.append(np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel())
    return lanes[0], lanes[1]


def sketches_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of an odd sketch for each run of distinct values: bit k is the parity of the values that hash to it."""
    bit = mixed(mixed(values)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    halves = []
    for half in range(2):
        own = np.where((bit >> np.uint64(6)) == half, one, np.uint64(0))
        halves.append(np.bitwise_xor.reduceat(own, offsets[:-1]) if len(offsets) > 1 else np.empty(0, np.uint64))
    return halves[0], halves[1]


def sketch_jaccard(odd: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Jaccard of two sets with ``total`` members in all whose sketches differ in ``odd`` bits of 128."""
    apart = np.minimum(-64 * np.log(np.maximum(1 - odd / 64, 1e-9)), total)
    return (total - apart) / (total + apart)


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("w")
        where = np.asarray(lists.offsets, dtype=np.int64)
        flat = np.asarray(lists.values)[where[0] : where[-1]].view(np.uint64)
        offsets = where - where[0]
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes)
        columns = [np.zeros(batch.num_rows, dtype=np.uint64) for _ in range(4)]
        if len(some):
            own = np.r_[offsets[:-1][some], offsets[-1]]
            for column, found in zip(columns, (*fingerprints_of(flat, own), *sketches_of(flat, own))):
                column[some] = found
        none = sizes == 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c.view(np.int64), mask=none) for c in columns), pa.array(sizes.astype(np.int32), mask=none)],
            names=["doc_id", "text_hash", "f1", "f2", "s1", "s2", "words"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, f1, f2, s1, s2, words) of each row; the last five are null without an id or a word."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    some = F.when(F.col("doc_id").isNotNull() & F.col("t").isNotNull(), F.col("t")).otherwise(F.lit(""))
    hashed = src.select("doc_id", F.xxhash64("t").alias("text_hash"), F.transform(F.array_distinct(words_of(some)), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.mapInArrow(_lanes, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, {_NODE}")


class Layout:
    """Where fingerprints meet: the shards of each block, and the grid that a crowded shard is split into."""

    def __init__(self, counts: np.ndarray, radius: int, group_rows: int):
        """``counts``: fingerprints by block and 16-bit value."""
        self.radius, total = radius // _BLOCKS, int(counts[0].sum())
        bits = _LEAST_BITS
        while bits < _BLOCK_BITS and total * (sum(comb(bits, k) for k in range(self.radius + 1)) + 1) / 2 / 2**bits > group_rows:
            bits += 1
        self.bits = bits
        keys = np.arange(1 << bits)
        asked, met = BKTree(keys).within(keys, self.radius)
        met = met.astype(np.int64)
        order = np.lexsort((met, asked))
        self.met, own = met[order], asked[order]
        self.begins = np.r_[0, np.cumsum(np.bincount(own, minlength=len(keys)))]
        half = max(1, group_rows // 2)
        self.members, self.askers = np.ones((_BLOCKS, len(keys)), np.int64), np.ones((_BLOCKS, len(keys)), np.int64)
        for block in range(_BLOCKS):
            held = counts[block].reshape(1 << bits, -1).sum(axis=1)
            ahead = self.met >= own
            asking = np.bincount(self.met[ahead], weights=held[own[ahead]], minlength=len(keys))
            self.members[block] = np.maximum(1, -(-held // half))
            self.askers[block] = np.maximum(1, np.ceil(asking / half).astype(np.int64))


def _router(layout):
    names = ("f1", "f2", "s1", "s2", "words", "node")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Layout = layout.value
        counts, shift = np.diff(plan.begins), np.uint64(_BLOCK_BITS - plan.bits)
        for whole in batches:
            # Slices keep the fan-out of one piece small.
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                f1 = np.asarray(batch.column("f1")).view(np.uint64)
                spread = mixed(np.asarray(batch.column("node")).view(np.uint64))
                shard, cell, role, row = [], [], [], []
                for block in range(_BLOCKS):
                    value = (f1 >> np.uint64(block * _BLOCK_BITS)) & np.uint64(0xFFFF)
                    prefix = (value >> shift).astype(np.int64)
                    each = counts[prefix]
                    rows = np.repeat(np.arange(len(f1)), each)
                    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    target = plan.met[np.repeat(plan.begins[prefix], each) + inside]
                    ahead = target >= prefix[rows]  # of two shards, the later one compares
                    rows, target = rows[ahead], target[ahead]
                    own = target == prefix[rows]
                    m, a = plan.members[block][target], plan.askers[block][target]
                    my_m, my_a = (spread[rows] % m.astype(np.uint64)).astype(np.int64), ((spread[rows] >> np.uint64(32)) % a.astype(np.uint64)).astype(np.int64)
                    # A row asks in all columns of its line of the grid; a member also stands in all lines of its column.
                    at = np.repeat(np.arange(len(rows)), m)
                    column = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                    flags = np.where(own[at] & (column == my_m[at]), _ASKS | _MEMBER, _ASKS)
                    parts = [(at, my_a[at] * m[at] + column, flags)]
                    if (a[own] > 1).any():
                        lines = np.where(own, a, 0)
                        at = np.repeat(np.arange(len(rows)), lines)
                        line = np.arange(len(at)) - np.repeat(np.cumsum(lines) - lines, lines)
                        at, line = at[line != my_a[at]], line[line != my_a[at]]
                        parts.append((at, line * m[at] + my_m[at], np.full(len(at), _MEMBER)))
                    for at, where, flags in parts:
                        shard.append((block << plan.bits) | target[at])
                        cell.append(where)
                        role.append(flags)
                        row.append(rows[at])
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int32)) for x in (shard, cell, role)] + [batch.column(c).take(rows) for c in names],
                    names=["shard", "cell", "role", *names],
                )

    return route, f"shard int, cell int, role int, {_NODE}, node long"


def _roots(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each point's component, for points 0..n-1, edges (a, b) and what is known before."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class _Search:
    """Compares what has met in one cell of a shard: links of each row, and the components."""

    def __init__(self, group: pa.Table, bits: int, radius: int, second_radius: int, least_jaccard: float):
        order = np.argsort(np.asarray(group.column("node")), kind="stable")
        take = lambda c: np.asarray(group.column(c))[order]
        self.node, self.role, self.words = take("node"), take("role"), take("words").astype(np.int64)
        self.f1, self.f2, self.s1, self.s2 = (take(c).view(np.uint64) for c in ("f1", "f2", "s1", "s2"))
        self.block = int(group.column("shard")[0].as_py()) >> bits
        shift = np.uint64(_BLOCK_BITS - bits)
        home = int(group.column("shard")[0].as_py()) & ((1 << bits) - 1)
        self.own = (self.value(self.block) >> shift).astype(np.int64) == home
        self.radius, self.second_radius, self.least = radius, second_radius, least_jaccard
        self.label, self.links = np.arange(len(self.node)), np.zeros(len(self.node), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def value(self, block: int) -> np.ndarray:
        return (self.f1 >> np.uint64(block * _BLOCK_BITS)) & np.uint64(0xFFFF)

    def run(self) -> pa.Table:
        asks, members = np.flatnonzero(self.role & _ASKS), np.flatnonzero(self.role & _MEMBER)
        if len(asks) and len(members):
            self.narrowed(asks, members, [b for b in range(_BLOCKS) if b != self.block], self.block, [(b, self.radius // _BLOCKS) for b in range(self.block)], self.radius // _BLOCKS)
        self.fold()
        some = np.flatnonzero(self.links)
        # One edge to the smallest member says as much about components as all pairs.
        return pa.table({"a": self.node[self.label[some]], "b": self.node[some], "links": self.links[some]})

    def narrowed(self, asks: np.ndarray, members: np.ndarray, rest: list[int], block: int, before: list[tuple[int, int]], radius: int) -> None:
        """Pairs within ``radius`` in a block; those also within it in a block of ``before`` are met there."""
        value = self.value(block)
        members = members[np.argsort(value[members], kind="stable")]
        asks = asks[np.argsort(value[asks], kind="stable")]
        held, first, size = np.unique(value[members], return_index=True, return_counts=True)
        asked, ask_first, ask_size = np.unique(value[asks], return_index=True, return_counts=True)
        at, met = BKTree(held).within(asked, radius)
        slot = np.searchsorted(held, met)
        area = ask_size[at] * size[slot]
        order = np.argsort(area, kind="stable")
        at, slot, area = at[order], slot[order], area[order]
        # Small rectangles of candidate pairs are compared many at a time, large ones are cut by another block first.
        many = int(np.searchsorted(area, 1 << 22)) if rest else len(area)
        done, lo = np.cumsum(area), 0
        while lo < many:
            base = done[lo - 1] if lo else 0
            hi = min(many, max(lo + 1, int(np.searchsorted(done, base + (1 << 20), side="right"))))
            if area[lo] > 1 << 20:
                q0, m0, k = ask_first[at[lo]], first[slot[lo]], size[slot[lo]]
                step = max(1, (1 << 20) // k)
                for c in range(0, ask_size[at[lo]], step):
                    own = asks[q0 + c : q0 + min(c + step, ask_size[at[lo]])]
                    self.compare(np.repeat(own, k), np.tile(members[m0 : m0 + k], len(own)), before)
                lo += 1
                continue
            part = area[lo:hi]
            rect = np.repeat(np.arange(hi - lo), part)
            step = np.arange(len(rect)) - np.repeat(np.cumsum(part) - part, part)
            wide = size[slot[lo:hi]][rect]
            self.compare(asks[ask_first[at[lo:hi]][rect] + step // wide], members[first[slot[lo:hi]][rect] + step % wide], before)
            lo = hi
        for k in range(many, len(area)):
            own, whom = asks[ask_first[at[k]] : ask_first[at[k]] + ask_size[at[k]]], members[first[slot[k]] : first[slot[k]] + size[slot[k]]]
            for n, other in enumerate(rest):
                self.narrowed(own, whom, [], other, before + [(b, self.radius // len(rest)) for b in rest[:n]], self.radius // len(rest))

    def compare(self, q: np.ndarray, m: np.ndarray, before: list[tuple[int, int]]) -> None:
        """Count and keep the near ones among pairs of rows."""
        near = np.bitwise_count(self.f1[q] ^ self.f1[m]) <= self.radius
        q, m = q[near], m[near]
        near = (np.bitwise_count(self.f2[q] ^ self.f2[m]) <= self.second_radius) & ((q < m) | (~self.own[q] & (q != m)))
        q, m = q[near], m[near]
        near = np.ones(len(q), dtype=bool)
        apart = self.f1[q] ^ self.f1[m]
        for block, radius in before:
            near &= np.bitwise_count((apart >> np.uint64(block * _BLOCK_BITS)) & np.uint64(0xFFFF)) > radius
        total = self.words[q] + self.words[m]
        odd = np.bitwise_count(self.s1[q] ^ self.s1[m]).astype(np.int64) + np.bitwise_count(self.s2[q] ^ self.s2[m])
        near &= (total > SMALL) | (sketch_jaccard(odd, total) >= self.least)
        q, m = q[near], m[near]
        if len(q):
            self.links += np.bincount(q, minlength=len(self.node)) + np.bincount(m, minlength=len(self.node))
            self.waiting.append((q, m))
            self.held += len(q)
            if self.held > 1 << 21:
                self.fold()

    def fold(self) -> None:
        if self.waiting:
            self.label = _roots(np.concatenate([q for q, _ in self.waiting]), np.concatenate([m for _, m in self.waiting]), len(self.node), self.label)
            self.waiting, self.held = [], 0


def _components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component with an edge, by large and small stars."""

    def star(links: DataFrame, smaller: bool) -> DataFrame:
        if smaller:
            sided = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            sided = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sided.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = sided.join(low, "u")
        if smaller:
            hung = hung.select("m", "v").unionByName(low.select("m", F.col("u").alias("v")))
        else:
            hung = hung.filter("v > u").select("m", "v")
        return hung.filter("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    def mark(t: DataFrame):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = edges.select("a", "b")
    seen = mark(now)
    while True:
        new = written(star(star(now, False), True), "stars")
        if (found := mark(new)) == seen:
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        forget(now)
        now, seen = new, found


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, second_radius: int = SECOND_RADIUS,
    least_jaccard: float = LEAST_JACCARD, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, text_hash, kept_id, links), one row for each input row."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be in 0..63")
    spark = docs.sparkSession
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    key = ["f1", "f2", "s1", "s2", "words"]
    # A node is a fingerprint, not an id: unlike texts of one id stay apart.
    nodes = written(prints.filter("f1 is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = F.array(*(F.shiftrightunsigned("f1", b * _BLOCK_BITS).bitwiseAND(F.lit(0xFFFF)) for b in range(_BLOCKS)))
    counts = np.zeros((_BLOCKS, 1 << _BLOCK_BITS), dtype=np.int64)
    for r in nodes.select(F.posexplode(each).alias("block", "value")).groupBy("block", "value").count().collect():
        counts[r.block, r.value] = r["count"]
    layout = Layout(counts, radius, group_rows)
    route, shape = _router(spark.sparkContext.broadcast(layout))
    bits = layout.bits

    def search(group: pa.Table) -> pa.Table:
        return _Search(group, bits, radius, second_radius, least_jaccard).run()

    routed = nodes.select(*key, "node").mapInArrow(route, shape)
    found = written(routed.groupBy("shard", "cell").applyInArrow(search, "a long, b long, links long"), "edges")
    roots = _components(found.filter("a <> b").select("a", "b").distinct())
    linked = found.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    own = nodes.join(linked, "node", "left").join(roots, "node", "left").filter("rows > 1 or links is not null")
    placed = written(own.select(*key, "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    forget(found, nodes)
    kept = placed.groupBy("root").agg(F.min("least").alias("kept_id"))
    # Only fingerprints with a link or several rows are looked up.
    classes = placed.join(kept, "root").select(*(F.col(c).alias(f"n_{c}") for c in key), "kept_id", "links")
    met = prints.join(classes, [prints[c] == classes[f"n_{c}"] for c in key], "left")
    return met.select("doc_id", "text_hash", F.coalesce("kept_id", "doc_id").alias("kept_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, second_radius: int = SECOND_RADIUS,
    least_jaccard: float = LEAST_JACCARD, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, kept_id, links, is_copy), one row for each input row.

    ``kept_id`` names the row's class and is its smallest id; a class is a
    connected component of the near-duplicate relation. ``links`` is the number
    of other fingerprints that the row's own is near to; copies, which share a
    fingerprint, are no links. ``is_copy`` is false where the row's id is
    ``kept_id``, so for each of several rows that repeat the kept one. Texts
    with the same words, in any order and number, are at distance 0. Unlike
    texts of one id are in classes of their own, which that id may both name.
    A row with a null id, a null text or a text without any letter or digit is
    not compared: it keeps its own id and is no copy. Very long texts are
    fingerprinted whole. An empty table gives no rows. Ids may be of any type
    with an order. Other columns are not looked at.
    """
    groups = near_groups(docs, id_col, text_col, radius, second_radius, least_jaccard, group_rows)
    return groups.select("doc_id", "kept_id", "links", F.coalesce(F.col("kept_id") != F.col("doc_id"), F.lit(False)).alias("is_copy"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, second_radius: int = SECOND_RADIUS,
    least_jaccard: float = LEAST_JACCARD, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``docs`` with one document of each class, all columns kept (see :func:`near_duplicates`).

    Rows that are not compared stay, repeated rows collapse to one.
    """
    groups = near_groups(docs, id_col, text_col, radius, second_radius, least_jaccard, group_rows)
    kept = groups.filter("doc_id is null or doc_id = kept_id").select("doc_id", "text_hash").distinct()
    return keep_rows(docs, kept, id_col, text_col)
