import numpy as np
import pyarrow as pa
import pytest

from glossator.llm import exact_dedup, simhash_dedup
from glossator.llm.bktree import BKTree
from glossator.llm.common import written

EXTRA = "doc_id long, text string, lang string, name string, rid long, block string, node string, f1 long, root int"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    long = "ab" * 9000
    rows = [
        (1, "same text"), (2, "same text"), (2, "same text"), (3, None), (4, None), (5, ""), (6, ""), (7, long), (8, long),
        (9, long + "x"), (None, "same text"), (None, "alone"), (10, "é" * 5000), (11, "é" * 5000), (12, "é" * 4999 + "e"),
    ]
    return spark.createDataFrame([(i, t, None, "n", 1, "b", "c", 1, 2) for i, t in rows], EXTRA)


@pytest.mark.parametrize("block", [1, 700, 4096])
def test_exact_against_brute_force(odd, block):
    if block == 1:
        odd = odd.filter("length(text) < 20 or text is null")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected = []
    for k, (i, t) in enumerate(rows):
        if t is None:
            expected.append((i, i, False))
            continue
        same = sorted((j is None, j if j is not None else 0, n) for n, (j, u) in enumerate(rows) if u == t)
        first = same[0]
        expected.append((i, rows[first[2]][0], None))
    got = exact_dedup.exact_duplicates(odd, block_bytes=block)
    assert sorted(((r.doc_id, r.kept_id) for r in got.collect()), key=repr) == sorted(((i, k) for i, k, _ in expected), key=repr)
    texts = len({t for _, t in rows if t is not None})
    assert got.filter("not is_copy").count() == texts + sum(t is None for _, t in rows)


def test_exact_drop_keeps_columns_and_one_row_each(odd):
    kept = exact_dedup.drop_exact_duplicates(odd, block_bytes=1600)
    assert kept.columns == odd.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(set(found)) == 2 + len({r.text for r in odd.collect() if r.text is not None})
    assert (1, "same text") in found and (3, None) in found and (4, None) in found


def test_exact_empty_table(spark, odd):
    none = odd.limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def test_exact_digest_that_collides_is_replaced(odd, monkeypatch):
    from pyspark.sql import functions as F

    good = exact_dedup._digest
    monkeypatch.setattr(exact_dedup, "_digest", lambda b, seed: (F.length(b).cast("long"), F.lit(0).cast("long")) if seed == 0 else good(b, seed))
    texts = [r.text for r in odd.collect()]
    kept = exact_dedup.exact_duplicates(odd, block_bytes=4000).filter("not is_copy").count()
    assert kept == len({t for t in texts if t is not None}) + texts.count(None)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 9])
def test_bk_tree_finds_exactly_the_pairs_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    held, asked = rng.integers(0, 1 << 16, 900), rng.integers(0, 1 << 16, 300)
    at, met = BKTree(held).within(asked, radius)
    got = sorted(zip(at.tolist(), met.tolist()))
    want = sorted((i, int(v)) for i, q in enumerate(asked) for v in np.unique(held) if (int(q) ^ int(v)).bit_count() <= radius)
    assert got == want


def test_bk_tree_without_values():
    assert len(BKTree(np.array([], dtype=np.uint64)).within(np.arange(3), 2)[0]) == 0


def _brute_groups(prints, radius, second, least=0.6):
    ids = sorted({p[0] for p in prints})
    root, links = {i: i for i in ids}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def near(a, b):
        if (a[1] ^ b[1]).bit_count() > radius or (a[2] ^ b[2]).bit_count() > second:
            return False
        total, odd = a[5] + b[5], (a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count()
        return total > simhash_dedup.SMALL or float(simhash_dedup.sketch_jaccard(np.array([odd]), np.array([total]))[0]) >= least

    for a in prints:
        links[a[0]] = len({b[1:] for b in prints if b[1:] != a[1:] and near(a, b)})
        for b in prints:
            if near(a, b):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def _prints(docs):
    return [(r.doc_id, *(r[c] % 2**64 for c in ("f1", "f2", "s1", "s2")), r.words) for r in simhash_dedup.fingerprints(docs).collect()]


@pytest.mark.parametrize("radius,group_rows", [(11, 2_000_000), (3, 2_000_000), (11, 12), (11, 60), (7, 1)])
def test_near_groups_against_brute_force(spark, radius, group_rows):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, at = [], 0
    for _ in range(40):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 300))))
        for _ in range(int(rng.integers(1, 7))):
            some = list(words)
            for k in rng.integers(0, len(some), len(some) // 25):
                some[k] = str(rng.choice(vocabulary))
            rows.append((at, " ".join(some), "en"))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(3)
    want = _brute_groups(_prints(docs), radius, 14)
    got = {r.doc_id: (r.kept_id, r.links) for r in simhash_dedup.near_duplicates(docs, radius=radius, group_rows=group_rows).collect()}
    assert got == want
    kept = simhash_dedup.drop_near_duplicates(docs, radius=radius, group_rows=group_rows)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in want.values()}
    assert kept.columns == docs.columns


def _planted(rng, n, flips):
    """Random lanes with clusters, and their columns."""
    f1 = rng.integers(0, 2**64, n, dtype=np.uint64)
    f2 = rng.integers(0, 2**64, n, dtype=np.uint64)
    for k in range(1, n):
        if rng.random() < 0.6:
            at = int(rng.integers(0, k))
            f1[k], f2[k] = f1[at], f2[at]
            for bit in rng.integers(0, 64, int(rng.integers(0, flips))):
                f1[k] ^= np.uint64(1) << np.uint64(bit)
    return f1, f2


@pytest.mark.parametrize("total,group_rows,cut", [(300, 40, False), (300, 2, False), (400, 1_000_000, True)])
def test_cells_of_a_shard_find_each_pair_once(total, group_rows, cut, monkeypatch):
    rng = np.random.default_rng(total + group_rows)
    f1, f2 = _planted(rng, total, 9)
    if cut:
        # One value of the first block holds all rows, and large rectangles are those of more than one pair.
        f1 = (f1 & ~np.uint64(0xFFFF)) | np.uint64(5)
        f1, keep = np.unique(f1, return_index=True)
        f2 = f2[keep]
        monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left", _of=np.searchsorted: _of(a, 1 if np.isscalar(v) and v == 1 << 22 else v, side=side))
    n = len(f1)
    each = np.stack([(f1 >> np.uint64(16 * b)) & np.uint64(0xFFFF) for b in range(4)]).astype(np.int64)
    layout = simhash_dedup.Layout(np.stack([np.bincount(e, minlength=1 << 16) for e in each]), 11, group_rows)
    route, _ = simhash_dedup._router(type("Held", (), {"value": layout}))
    signed = lambda a: pa.array(a.view(np.int64))
    zero = np.zeros(n, np.uint64)
    batch = pa.RecordBatch.from_arrays([signed(f1), signed(f2), signed(zero), signed(zero), pa.array(np.full(n, 1000, np.int32)), pa.array(np.arange(n))], names=["f1", "f2", "s1", "s2", "words", "node"])
    routed = pa.Table.from_batches(list(route(iter([batch]))))
    links, edges = np.zeros(n, np.int64), []
    for (shard, cell), own in routed.to_pandas().groupby(["shard", "cell"]):
        assert len(own) <= max(group_rows, 2) * 3
        found = simhash_dedup._Search(pa.Table.from_pandas(own, preserve_index=False), layout.bits, 11, 14, 0.6).run()
        links[np.asarray(found.column("b"))] += np.asarray(found.column("links"))
        edges += zip(found.column("a").to_pylist(), found.column("b").to_pylist())
    near = (np.bitwise_count(f1[:, None] ^ f1) <= 11) & (np.bitwise_count(f2[:, None] ^ f2) <= 14)
    assert links.tolist() == (near.sum(1) - 1).tolist()
    at = np.nonzero(near)
    a, b = np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64)
    assert simhash_dedup._roots(a, b, n).tolist() == simhash_dedup._roots(*at, n).tolist()


def test_sketches_tell_small_sets_apart():
    rng = np.random.default_rng(3)
    for shared, alone in ((16, 2), (16, 8), (40, 10)):
        own = [rng.integers(0, 2**64, shared + 2 * alone, dtype=np.uint64) for _ in range(60)]
        got = []
        for v in own:
            flat = np.r_[v[: shared + alone], v[:shared], v[shared + alone :]]
            s1, s2 = simhash_dedup.sketches_of(flat, np.array([0, shared + alone, len(flat)]))
            odd = int(s1[0] ^ s1[1]).bit_count() + int(s2[0] ^ s2[1]).bit_count()
            got.append(float(simhash_dedup.sketch_jaccard(np.array([odd]), np.array([2 * (shared + alone)]))[0]))
        assert abs(np.mean(got) - shared / (shared + 2 * alone)) < 0.03


def test_unlike_texts_of_one_id_stay_apart(spark):
    a, b = (" ".join(f"{p}{k}" for k in range(300)) for p in "ab")
    docs = spark.createDataFrame([("x", a), ("x", b), ("y", b + " more"), ("z", "c d e")], "doc_id string, text string")
    got = {(r.doc_id, r.text) for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    assert got == {("x", a), ("x", b), ("z", "c d e")}


def test_fingerprints_are_the_majority_of_word_bits():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 700_000, dtype=np.uint64)
    offsets = np.array([0, 1, 5, 600_005, 700_000])
    f1, f2 = simhash_dedup.fingerprints_of(values, offsets)
    for i in range(4):
        for lane, own in ((f1, values), (f2, simhash_dedup.mixed(values))):
            run = own[offsets[i] : offsets[i + 1]]
            want = sum(1 << k for k in range(64) if 2 * int(((run >> np.uint64(k)) & np.uint64(1)).sum()) > len(run))
            assert int(lane[i]) == want


def test_near_edge_cases(spark, odd):
    got = _rows(simhash_dedup.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {(i, k) for i, k, *_ in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (8, 7), (None, None), (11, 10)} <= by
    kept = simhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6} <= set(ids) and ids.count(None) == 2
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0
    assert simhash_dedup.drop_near_duplicates(odd.limit(0)).count() == 0


def test_a_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup._components(written(edges, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
