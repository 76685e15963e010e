from collections import defaultdict

import numpy as np
import pytest

from tabulant.llm import neighbours, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, key string, vector int, node int, rows int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, "k", 1, 2, 3, 4) for k, v in rows], SCHEMA).repartition(3)


def plain(rows, every=20, k=20):
    kept = {(key, tuple(v)) for key, v in rows if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = len(min(kept)[1])
    kept = sorted(x for x in kept if len(x[1]) == width)
    cells = np.array([v for _, v in kept], np.float32).astype(np.float64)
    keys = np.array([key for key, _ in kept])
    found = {}
    for q in sorted({key for key in keys.tolist() if key % every == 0}):
        best = {}
        for i in np.flatnonzero(keys == q):
            for key, s in zip(keys.tolist(), (cells @ cells[i]).tolist()):
                if key != q:
                    best[key] = max(s, best.get(key, -np.inf))
        found[q] = sorted(((round(-s, 9), key) for key, s in best.items()))[:k]
    return found


def answers(df):
    got = defaultdict(list)
    for q, rank, key, score in sorted(map(tuple, df.collect())):
        got[q].append((round(-score, 9), key))
        assert rank == len(got[q])
    return got


def recall(got, want):
    return np.mean([len({k for _, k in got[q]} & {k for _, k in w}) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = plain(rows), answers(queries.op12_nearest_neighbours(spark, folder))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.95
    cells = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for s, k in found:
            exact = -np.dot(np.array(cells[q], np.float64), np.array(cells[k], np.float64))
            assert abs(s - exact) < 1e-8


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=6), 1).astype(np.float32).tolist()) for i in range(18)]
    rows += [(i, rows[3][1]) for i in range(100, 150)]  # copies, of which the least ids count
    rows += [(20, rows[3][1]), (40, rows[5][1]), (20, rows[3][1]), (60, rows[6][1]), (60, rows[7][1])]
    rows += [(None, rows[1][1]), (80, None), (80, [0.0] * 6), (100000, [float("nan")] * 6), (200000, [1.0] * 5), (-20, [9.0] * 6)]
    assert dict(answers(neighbours.nearest(frame(spark, rows)))) == plain(rows)


def test_hot_vector_and_near_copies(spark):
    """A third of all rows are one vector, another third are near copies of one."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)]
    rows += [(2000 + i, (base[9] + rng.normal(size=16) * 0.01).astype(np.float32).tolist()) for i in range(400)]
    want, got = plain(rows), answers(neighbours.nearest(frame(spark, rows)))
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert got[1000] == want[1000]


def test_nothing_to_search(spark):
    assert neighbours.nearest(frame(spark, [])).collect() == []
    assert neighbours.nearest(frame(spark, [(20, [1.0, 0.0])])).collect() == []
    assert neighbours.nearest(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []
    assert neighbours.nearest(frame(spark, [])).columns == ["query_id", "rank", "vec_id", "score"]


def test_received_rows_are_bounded(spark):
    """Every node's list holds one hub, yet few rows reach it, and the graph still finds the neighbours."""
    rng = np.random.default_rng(3)
    cells = rng.normal(size=(600, 8))
    cells[0] *= 30  # the nearest of about half of all by inner product
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(cells)]
    want, got = plain(rows), answers(neighbours.nearest(frame(spark, rows), received=20))
    assert recall(got, want) >= 0.9
