import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import ann


def _brute(x, k):
    d = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("kind,options", [("random", {}), ("clustered", {}), ("clustered", {"fit_floats": 24 * 260, "split_rows": 60, "cell_rows": 200})])
def test_recall_against_brute_force(spark, kind, options):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    if kind == "clustered":
        x = x * 0.1 + rng.standard_normal((12, 24)).astype(np.float32)[rng.integers(0, 12, len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = ann.nearest_neighbours(df, k=10, branch=8, leaf_rows=32, shard_rows=300, queries=128, asks=F.col("vec_id") % 2 == 0, **options).collect()
    want, far = _brute(x, 10)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour_id, r.distance)
    assert set(got) == set(range(0, len(x), 2)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({n for n, _ in got[i].values()} & set(want[i].tolist())) / 10 for i in got])
    assert recall >= 0.93
    for i in range(0, len(x), 50):
        for n, d in got[i].values():
            assert d == pytest.approx(float(np.linalg.norm(x[i].astype(float) - x[n])), abs=1e-9)


def test_the_registered_query_against_brute_force(spark):
    from glossator.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32)
    got = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    want, _ = _brute(x, 10)
    assert np.mean([len(set(got[i].values()) & set(ids[want[np.flatnonzero(ids == i)[0]]].tolist())) / 10 for i in got]) >= 0.9


def test_a_hot_vector_is_one_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, k=4, asks=F.lit(True)).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert len(got) == 300
    for i in range(0, 300, 3):
        assert sorted(got[i]) == [(n + 1, j, 0.0) for n, j in enumerate([j for j in range(0, 15, 3) if j != i][:4])]


def test_a_tree_visits_leaves_in_order_of_the_queue():
    rng = np.random.default_rng(0)
    tree = ann.Tree(3, 4)
    tree.levels = [rng.standard_normal((3, 4)).astype(np.float32), rng.standard_normal((9, 4)).astype(np.float32)]
    tree.levels[1][4] = np.nan
    x = rng.standard_normal((20, 4)).astype(np.float32)
    order = tree.visits(x, 9)
    for q, visits in zip(x, order):
        assert visits[-1] == -1 and sorted(visits[:-1]) == [0, 1, 2, 3, 5, 6, 7, 8]
        agenda, want = [(0.0, 0, 0)], []
        while agenda:
            best = min(agenda)
            agenda.remove(best)
            _, level, node = best
            if level == 2:
                want.append(node)
                continue
            for child in range(3 * node, 3 * node + 3):
                far = float(((tree.levels[level][child].astype(np.float64) - q) ** 2).sum())
                if far == far:
                    agenda.append((far, level + 1, child))
        assert visits[:-1].tolist() == want


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (None, [1.0, 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rid int, leaf string")
    got = {}
    for r in ann.nearest_neighbours(df, k=2, asks=F.lit(True)).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, round(r.distance, 5)))
    assert set(got) == {1, 2, 3}
    assert sorted(got[1]) == [(1, 2, 0.0), (2, 2, 0.0)]
    assert sorted(got[2]) == [(1, 1, 0.0), (1, 1, 0.0), (2, 2, 0.0), (2, 2, 0.0)]
    assert sorted(got[3]) == [(1, 1, 1.41421), (2, 2, 1.41421)]
    assert ann.nearest_neighbours(df.filter("vec_id = 3"), asks=F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id = 4")).count() == 0
