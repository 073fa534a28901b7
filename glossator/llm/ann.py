"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree has ``branch`` children at each node and is fitted level by level with
Lloyd iterations on a bounded sample of the vectors (at most ``FIT_FLOATS``
numbers, those with the smallest hashes); every vector is then put into its
leaf. A query walks the tree best bin first: a priority queue holds nodes by
the distance of their centre, the nearest is taken, an inner node puts in its
children, whose distances are computed only then, a leaf is visited. How many
leaves are visited is calibrated: for a sample of queries the true neighbours
are found by comparing with everything, and visits widen until the wanted
recall is reached.

The sample bounds the broadcast tree, so its leaves grow with the table. A
leaf of more than ``SPLIT_ROWS`` vectors is searched by a tree of its own,
fitted where its vectors are, and the leaves visited of those widen until the
recall, measured by searching, is reached.

Vectors and queries meet by cell. A cell is one of the parts of a shard, and a
shard is a run of neighbouring leaves of a few thousand vectors, so a query's
vector is sent once to a cell however many of its leaves are visited. Equal
vectors are one vector with owners, of whom the ``k + 1`` smallest are enough:
the others are behind them in every list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, written

BRANCH, LEAF_ROWS, SHARD_ROWS = 16, 256, 4096
FIT_FLOATS, FIT_ROWS_EACH = 1 << 24, 16
SPLIT_ROWS, CELL_ROWS, CELL_QUERIES = 8192, 65_536, 50_000
ITERATIONS, RECALL, CALIBRATION_QUERIES = 4, 0.95, 256
QUERY_EVERY = 100


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to its own row of centres (rows x branch x dim)."""
    d = np.einsum("nbd,nbd->nb", centres - x[:, None], centres - x[:, None])
    return np.where(np.isnan(d), np.inf, d)


class Tree:
    """Centres by level; the children of node i are i*branch .. i*branch+branch-1. An absent child is NaN."""

    def __init__(self, branch: int, dim: int):
        self.branch, self.dim = branch, dim
        self.levels: list[np.ndarray] = []

    @property
    def leaves(self) -> int:
        return self.branch ** len(self.levels)

    def descend(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for centres in self.levels:
            node = self._nearest(x, node, centres)
        return node

    def _nearest(self, x: np.ndarray, node: np.ndarray, centres: np.ndarray) -> np.ndarray:
        blocks = centres.reshape(-1, self.branch, self.dim)
        out = np.empty(len(x), dtype=np.int64)
        for lo in range(0, len(x), 2048):
            own = node[lo : lo + 2048]
            out[lo : lo + 2048] = own * self.branch + _far(x[lo : lo + 2048], blocks[own]).argmin(axis=1)
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """The leaves in the order in which a query visits them."""
        agenda, depth, branch = [(0.0, 0, 0)], len(self.levels), self.branch
        while agenda:
            _, level, node = heapq.heappop(agenda)
            if level == depth:
                yield node
                continue
            children = self.levels[level][node * branch : (node + 1) * branch] - q
            for child, far in enumerate(np.einsum("bd,bd->b", children, children).tolist()):
                if far == far:
                    heapq.heappush(agenda, (far, level + 1, node * branch + child))

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves that each query visits, best bin first; -1 after the last."""
        out = np.full((len(x), min(most, self.leaves)), -1, dtype=np.int64)
        for own, q in zip(out, x):
            for at, leaf in zip(range(len(own)), self.walk(q)):
                own[at] = leaf
        return out


def fit(x: np.ndarray, leaves: int, branch: int = BRANCH, iterations: int = ITERATIONS, each: int = FIT_ROWS_EACH, seed: int = 5) -> Tree:
    """A tree of at least ``leaves`` leaves, or as many as leave ``each`` rows of ``x`` to one."""
    tree = Tree(branch, x.shape[1])
    x = x[np.random.default_rng(seed).permutation(len(x))]
    while tree.leaves < leaves and tree.leaves * branch * each <= len(x):
        node = tree.descend(x)
        order = np.argsort(node, kind="stable")
        held, first, size = np.unique(node[order], return_index=True, return_counts=True)
        rank = np.arange(len(x)) - np.repeat(first, size)
        centres = np.full((tree.leaves * branch, x.shape[1]), np.nan, dtype=np.float32)
        begin = rank < branch
        centres[node[order][begin] * branch + rank[begin]] = x[order[begin]]
        for _ in range(iterations):
            key = tree._nearest(x, node, centres)
            order = np.argsort(key, kind="stable")
            held, first, size = np.unique(key[order], return_index=True, return_counts=True)
            centres[held] = (np.add.reduceat(x[order].astype(np.float64), first, axis=0) / size[:, None]).astype(np.float32)
        tree.levels.append(centres)
    return tree


@dataclass
class Layout:
    """Shards of neighbouring leaves, and how many parts the vectors and the queries of each have."""

    shard: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, shard_rows: int, cell_rows: int) -> Layout:
        shard, at, held = np.zeros(len(counts), dtype=np.int64), 0, 0
        for leaf, n in enumerate(counts.tolist()):
            if held and held + n > shard_rows:
                at, held = at + 1, 0
            shard[leaf] = at
            held += n
        sizes = np.bincount(shard, weights=counts)
        return cls(shard, np.maximum(1, np.ceil(sizes / cell_rows)).astype(np.int64))


_ENTRY = "array<struct<d: double, id: long, rid: long>>"
_ENTRIES = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("rid", pa.int64())]))


def _nearest_rows(x: np.ndarray, v: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, positions), rows x k, of the nearest of ``v``; ties by ``first``, inf where there are fewer."""
    d = (x**2).sum(1)[:, None] - 2 * x @ v.T + (v**2).sum(1)[None]
    few = min(len(v), 3 * k)
    at = np.argpartition(d, few - 1, axis=1)[:, :few] if few < len(v) else np.broadcast_to(np.arange(len(v)), d.shape)
    # The expanded square is inexact where distances are small; the candidates are computed again.
    exact = ((v[at].astype(np.float64) - x[:, None].astype(np.float64)) ** 2).sum(-1)
    pick = np.lexsort((first[at], exact), axis=1)[:, :k]
    return np.take_along_axis(exact, pick, axis=1), np.take_along_axis(at, pick, axis=1)


def _answers(q: np.ndarray, d: list[np.ndarray], at: list[np.ndarray], owners: list, k: int) -> pa.Table:
    """Rows (q, near): the ``k`` first owners of the vectors found for each query."""
    near = []
    for far, where in zip(d, at):
        own = [(float(f), o["id"], o["rid"]) for f, w in zip(far, where) for o in owners[w]]
        near.append([dict(zip(("d", "id", "rid"), x)) for x in heapq.nsmallest(k, own)])
    return pa.table([pa.array(q, pa.int64()), pa.array(near, _ENTRIES)], names=["q", "near"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def exact_neighbours(table: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    """(q, near) of some collected queries (q, v): one pass that compares with every vector of ``table(v, owners)``."""
    held = table.sparkSession.sparkContext.broadcast((np.asarray(queries.column("q")), _matrix(queries.column("v"), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = held.value
        for batch in batches:
            if batch.num_rows:
                owners = batch.column("owners").to_pylist()
                d, at = _nearest_rows(x, _matrix(batch.column("v"), dim), np.array([o[0]["id"] for o in owners]), k)
                yield from _answers(q, list(d), list(at), owners, k).to_batches()

    return _ranked(table.select("v", "owners").mapInArrow(run, f"q long, near {_ENTRY}"), k)


class _Cells:
    """The index: vectors by cell, and the search of queries in them."""

    def __init__(self, table: DataFrame, tree: Tree, layout: Layout, dim: int, k: int, split_rows: int):
        self.table, self.dim, self.k, self.split_rows, self.branch = table, dim, k, split_rows, tree.branch
        self.held = table.sparkSession.sparkContext.broadcast((tree, layout))

    def asked(self, queries: DataFrame, most: int) -> DataFrame:
        """(shard, part, q, v, leaves): what each cell is asked."""
        held, dim = self.held, self.dim

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, layout = held.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    batch = whole.slice(lo, 1024)
                    visits = tree.visits(_matrix(batch.column("v"), dim), most)
                    visits.sort(axis=1)
                    row, at = np.nonzero(visits >= 0)
                    leaf = visits[row, at]
                    shard = layout.shard[leaf]
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]) if len(row) else np.empty(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)), pa.array(leaf))
                    copies = layout.parts[shard[new]]
                    each = np.repeat(np.arange(len(new)), copies)
                    part = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
                    rows = pa.array(row[new][each])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[new][each]), pa.array(part), batch.column("q").take(rows), batch.column("v").take(rows), lists.take(pa.array(each))], names=["shard", "part", "q", "v", "leaves"]
                    )

        return queries.select("q", "v").mapInArrow(ask, "shard long, part long, q long, v array<float>, leaves array<long>")

    def members(self, only: list[int] | None = None) -> DataFrame:
        """(shard, part, leaf, vid, v, owners) of the vectors, of some shards or all."""
        held, dim = self.held, self.dim
        wanted = None if only is None else np.array(sorted(only), dtype=np.int64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, layout = held.value
            for batch in batches:
                leaf = tree.descend(_matrix(batch.column("v"), dim))
                shard = layout.shard[leaf]
                part = np.asarray(batch.column("vid")) * 0x9E3779B1 % 4294967291 % layout.parts[shard]
                out = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), pa.array(leaf), *batch.columns], names=["shard", "part", "leaf", *batch.schema.names])
                yield out if wanted is None else out.filter(pa.array(np.isin(shard, wanted)))

        return self.table.select("vid", "v", "owners").mapInArrow(place, "shard long, part long, leaf long, vid long, v array<float>, owners array<struct<id: long, rid: long>>")

    def search(self, asked: DataFrame, members: DataFrame, inner: int) -> DataFrame:
        """(q, near) of ``asked``; ``inner``: leaves visited of the own tree of a large leaf."""
        dim, k, split_rows, branch = self.dim, self.k, self.split_rows, self.branch
        counts = asked.groupBy("shard").count().filter(F.col("count") > CELL_QUERIES).collect()
        # A crowded shard's queries are split, and its members stand in each of the splits.
        crowded = {r.shard: -(-r["count"] // CELL_QUERIES) for r in counts}
        splits = F.lit(1)
        for shard, n in crowded.items():
            splits = F.when(F.col("shard") == shard, F.lit(n)).otherwise(splits)
        left = asked.withColumn("split", F.pmod(F.xxhash64("q"), splits).cast("long"))
        right = members.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), splits.cast("long") - 1))) if crowded else members.withColumn("split", F.lit(0).cast("long"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], _ENTRIES)], names=["q", "near"])
            q, x = np.asarray(a.column("q")), _matrix(a.column("v"), dim)
            leaf = np.asarray(b.column("leaf"))
            order = np.lexsort((np.asarray(b.column("vid")), leaf))
            leaf, v = leaf[order], _matrix(b.column("v"), dim)[order]
            owners = [o for o in b.column("owners").combine_chunks().take(pa.array(order)).to_pylist()]
            first = np.array([o[0]["id"] for o in owners])
            lists = a.column("leaves").combine_chunks()
            want, who = np.asarray(lists.flatten()), np.repeat(np.arange(len(q)), np.asarray(lists.value_lengths()))
            best_d, best_at = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64)

            def look(rows: np.ndarray, lo: int, hi: int) -> None:
                for c in range(0, len(rows), 1024):
                    own = rows[c : c + 1024]
                    d, at = _nearest_rows(x[own], v[lo:hi], first[lo:hi], k)
                    both, both_at = np.concatenate([best_d[own], d], axis=1), np.concatenate([best_at[own], at + lo], axis=1)
                    pick = np.lexsort((first[both_at], both), axis=1)[:, :k]
                    best_d[own], best_at[own] = np.take_along_axis(both, pick, axis=1), np.take_along_axis(both_at, pick, axis=1)

            by = np.argsort(want, kind="stable")
            want, who = want[by], who[by]
            for key in np.unique(leaf):
                lo, hi = np.searchsorted(leaf, [key, key + 1])
                c, d = np.searchsorted(want, [key, key + 1])
                rows = who[c:d]
                if not len(rows):
                    continue
                if hi - lo <= split_rows:
                    look(rows, lo, hi)
                    continue
                own = fit(v[lo:hi][:: max(1, (hi - lo) // split_rows)], -(-(hi - lo) // LEAF_ROWS), branch)
                sub = own.descend(v[lo:hi])
                inside = np.argsort(sub, kind="stable")
                v[lo:hi], first[lo:hi], sub = v[lo:hi][inside], first[lo:hi][inside], sub[inside]
                owners[lo:hi] = [owners[lo + i] for i in inside.tolist()]
                visits = own.visits(x[rows], inner)
                for small in np.unique(sub):
                    e, f = np.searchsorted(sub, [small, small + 1])
                    some = rows[(visits == small).any(axis=1)]
                    if len(some):
                        look(some, lo + e, lo + f)
            good = np.isfinite(best_d)
            return _answers(q, [d[g] for d, g in zip(best_d, good)], [t[g] for t, g in zip(best_at, good)], owners, k)

        keys = ["shard", "part", "split"]
        return _ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"q long, near {_ENTRY}"), k)


def _recall(found: dict, truth: dict) -> float:
    """Mean share of the true neighbours' places that were reached: owners found at most as far as the farthest true one."""
    return float(np.mean([len({n.rid for n in near} & {n.rid for n in found.get(q, ())}) / len(near) for q, near in truth.items()])) if truth else 1.0


def calibrated(cells: _Cells, tree: Tree, layout: Layout, queries: pa.Table, dim: int, k: int, recall: float, large: bool) -> tuple[int, int]:
    """(leaves to visit, leaves to visit of a large leaf's own tree) so that the queries' mean recall reaches ``recall``."""
    truth = {r.q: r.near for r in exact_neighbours(cells.table, queries, dim, k).collect()}
    spark = cells.table.sparkSession
    wanted = sorted({n.rid for near in truth.values() for n in near})
    ids = spark.createDataFrame([(n,) for n in wanted], "rid long")
    held = cells.table.select("vid", "v", F.explode("owners.rid").alias("rid")).join(F.broadcast(ids), "rid").toArrow()
    leaf = dict(zip(held.column("rid").to_pylist(), tree.descend(_matrix(held.column("v"), dim)).tolist()))
    found = np.zeros(tree.leaves + 1)
    for q, x in zip(queries.column("q").to_pylist(), _matrix(queries.column("v"), dim)):
        near = [leaf[n.rid] for n in truth.get(q, ())]
        left = set(near)
        for at, met in enumerate(tree.walk(x)):
            if met in left:
                found[at + 1] += near.count(met) / (len(near) * max(1, len(truth)))
                left.discard(met)
            if not left:
                break
    reached = np.flatnonzero(np.cumsum(found) >= recall - 1e-12)
    most, inner = int(reached[0]) if len(reached) else tree.leaves, 1
    if large:
        # What the large leaves' own trees lose is only seen by searching.
        own = spark.createDataFrame(queries)
        inner, widest = 4, -(-CELL_ROWS // LEAF_ROWS) * cells.branch
        while True:
            asked = written(cells.asked(own, most), "calibration")
            shards = [r.shard for r in asked.select("shard").distinct().collect()]
            got = {r.q: r.near for r in cells.search(asked, cells.members(shards), inner).collect()}
            forget(asked)
            if _recall(got, truth) >= recall or (inner >= widest and most >= tree.leaves):
                break
            inner, most = min(2 * inner, widest), min(tree.leaves, most + max(1, most // 4))
    return max(1, most), inner


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL, asks: Column | None = None, branch: int = BRANCH,
    leaf_rows: int = LEAF_ROWS, iterations: int = ITERATIONS, shard_rows: int = SHARD_ROWS, queries: int = CALIBRATION_QUERIES, fit_floats: int = FIT_FLOATS, split_rows: int = SPLIT_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others of each query, by Euclidean distance.

    ``asks`` says which rows are queries; without it those whose id is
    divisible by ``QUERY_EVERY``. Every row is searched. A row with a null id,
    a null or empty vector, a vector with a null, NaN or infinite element, or
    one of another length than most have (of equally frequent lengths the
    longest), takes no part. Ties go to the smaller id. Repeated rows are each
    a query and each a neighbour, at distance 0. With fewer than k others all
    are returned, with none there are no rows; an empty table gives none.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    id_ = F.col(id_col).cast("long")
    asking = F.coalesce(id_ % QUERY_EVERY == 0 if asks is None else asks, F.lit(False))
    src = vectors.select(id_.alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asking.alias("asks"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = src.filter("id is not null and v is not null and size(v) > 0").filter(whole)
    sizes = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    dim = sizes.dim
    # -0.0 and 0.0 are one number, here as in a comparison.
    same = F.transform("v", lambda x: x + F.lit(0.0).cast("float"))
    base = written(usable.filter(F.size("v") == dim).withColumn("v", same).withColumns({"rid": F.monotonically_increasing_id(), "h": F.xxhash64("v")}), "vectors")
    order = Window.partitionBy("h", "v").orderBy("id", "rid")
    few = base.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    owned = few.groupBy("h", "v").agg(F.sort_array(F.collect_list(F.struct("id", "rid"))).alias("owners"))
    table = written(owned.select(F.col("owners")[0]["rid"].alias("vid"), "v", "owners"), "distinct-vectors")
    rows = table.count()
    room = max(1, fit_floats // dim)
    chosen = table if rows <= room else table.filter(F.pmod(F.xxhash64("vid", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * room / rows)))
    tree = fit(_matrix(chosen.select("vid", "v").orderBy(F.xxhash64("vid", F.lit(2)), "vid").limit(room).toArrow().column("v"), dim), -(-rows // leaf_rows), branch, iterations)
    held = spark.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, n = np.unique(held.value.descend(_matrix(batch.column("v"), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in table.select("v").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.leaf] = r.n
    layout = Layout.of(counts, shard_rows, cell_rows)
    cells = _Cells(table, tree, layout, dim, k + 1, split_rows)
    own = base.filter("asks").select("rid", "id", "h", "v")
    distinct = written(own.groupBy("h", "v").agg(F.min("rid").alias("q")), "query-vectors")
    sample = distinct.select("q", "v").orderBy(F.xxhash64("q", F.lit(1)), "q").limit(queries).toArrow()
    most, inner = calibrated(cells, tree, layout, sample, dim, k + 1, recall, bool(counts.max() > split_rows)) if sample.num_rows else (1, 1)
    asked = written(cells.asked(distinct, most), "asked")
    found = cells.search(asked, cells.members(), inner)
    # A query is not its own neighbour; the list has one more than k for that.
    near = own.join(distinct.select("h", "v", "q"), ["h", "v"]).select("rid", F.col("id").alias("vec_id"), "q").join(found, "q")
    others = near.select("vec_id", F.posexplode(F.slice(F.filter("near", lambda n: n["rid"] != F.col("rid")), 1, k)).alias("rank", "n"))
    return others.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.sqrt("n.d").alias("distance"))
