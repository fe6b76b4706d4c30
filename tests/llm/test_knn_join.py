import random

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tidewatch.llm import knn_join, queries


def brute(rows, queries_of, k):
    out = []
    for q, u in {q: u for q, u in rows if queries_of(q)}.items():
        scores = sorted(((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in rows if i != q))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", 4)
    rng = random.Random(seed)
    centres = [[rng.randrange(-300, 300) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(300):
        v = centres[0] if i % 3 == 0 else [x + rng.randrange(-4, 5) for x in rng.choice(centres)]
        rows.append((i, v))
    rows += [(10**15, [2**31] * 6), (-7, [0] * 6)]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    found = sorted(tuple(r) for r in knn_join.top_k(frame, frame.filter("id % 10 = 0 OR id < 0")).collect())
    assert found == brute(rows, lambda q: q % 10 == 0 or q < 0, knn_join.K)


def test_far_cells_are_left_out():
    import numpy as np

    pivots = np.array([[100.0, 0], [-100.0, 0], [0, 1.0]])
    cells = {0: (1.0, 50), 1: (1.0, 50), 2: (1.0, 50)}
    assert knn_join.needed_cells(pivots, cells, {0: 1.0}, 5) == [(0, 0)]
    assert len(knn_join.needed_cells(pivots, {c: (1.0, 2) for c in range(3)}, {0: 1.0}, 5)) == 3


def test_odd_vectors_and_tables(spark):
    nan = float("nan")
    schema = "vec_id long, embedding array<float>, id string, v int"
    data = [(0, [1.0, -0.001], "a", 1), (50, [0.5, 0.5], "a", 1), (1, None, "a", 1), (2, [nan, 1.0], "a", 1), (3, [None, 1.0], "a", 1), (4, [float("inf"), 1.0], "a", 1), (None, [1.0, 1.0], "a", 1), (7, [1.0, -0.001], None, None), (7, [1.0, -0.001], None, None), (6, [], "a", 1)]
    vectors = knn_join.whole_vectors(spark.createDataFrame(data, schema))
    assert sorted((r["id"], tuple(r["v"])) for r in vectors.collect()) == [(0, (256, -1)), (7, (256, -1)), (7, (256, -1)), (50, (128, 128))]
    found = sorted(tuple(r) for r in knn_join.top_k(vectors, vectors.filter("id % 50 = 0")).collect())
    same = 256 * 256 + 1
    assert found == [(0, 1, 7, same), (0, 2, 7, same), (0, 3, 50, 128 * 255), (50, 1, 0, 128 * 255), (50, 2, 7, 128 * 255), (50, 3, 7, 128 * 255)]
    assert knn_join.top_k(vectors.limit(0), vectors).collect() == []
    assert knn_join.top_k(vectors, vectors.filter(F.lit(False))).collect() == []


def test_query_against_sql(spark):
    name, folder = "op9_knn_join", "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder).toPandas()
    assert differences(found, connect(folder).execute(queries.ORACLES[name]).fetchdf()) == []
