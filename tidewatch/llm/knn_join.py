"""Exact top-k by inner product with a Voronoi join.

Vectors are dealt to the nearest of a fixed number of pivots. Each cell is summarised by its
size, radius and the spread of its inner products with the pivots; each query group by its
radius. From these alone follows, per pair of a query group and a cell, the least and the largest
inner product that any query of the group can have with any vector of the cell. The least values
give each group a floor that k vectors reach for certain; cells whose largest value stays below
the floor are not needed. Only needed cells are replicated to a group, as blocks of vectors, and
the blocks are solved with integer matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

K = 5
SCALE = 256
#: Pivots; drawn from this many vectors of least hash, a bounded sample that only shapes cells.
PIVOTS = 32
PIVOT_SAMPLE = 2_000
#: Vectors of a block that is replicated, and queries of a block.
DATA_BLOCK = 1_024
QUERY_BLOCK = 256


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)``: each component ``x`` as ``floor(scale * x)``, ``x`` as double.

    NULL keys and vectors, empty vectors and those with NULL or non-finite components are left
    out. Repeated rows stay; they are told apart by nothing and tie with each other.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("x"))
    rows = rows.filter("id IS NOT NULL AND x IS NOT NULL").filter((F.size("x") > 0) & sound)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def choose_pivots(rows: DataFrame, number: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Far-apart vectors of a bounded sample in hash order: each the farthest from those before."""
    drawn = rows.orderBy(F.xxhash64(F.col("id")), "id").limit(sample).select("v").toPandas()["v"]
    points = np.array([np.asarray(v, dtype=np.float64) for v in drawn])
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(number, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """``(cell, ids, vectors, radius, count)``: vectors of one cell packed, ``size`` at most."""
    width = pivots.shape[1]

    def pack(cell: int, ids: np.ndarray, data: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([float(far.max())]), pa.array([len(ids)])],
            names=["cell", "ids", "vectors", "radius", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), dtype=np.int64)
            cells = batch.column("v")
            flat = np.asarray(cells.flatten(), dtype=np.int64)
            if len(flat) != len(ids) * width:
                raise ValueError(f"vectors must all have {width} components")
            data = flat.reshape(len(ids), width)
            real = data.astype(np.float64)
            square = (real**2).sum(axis=1)[:, None] - 2 * real @ pivots.T + (pivots**2).sum(axis=1)
            nearest = square.argmin(axis=1)
            far = np.sqrt(((real - pivots[nearest]) ** 2).sum(axis=1))
            for cell in np.unique(nearest):
                own = nearest == cell
                held = waiting.setdefault(int(cell), [ids[:0], data[:0], far[:0]])
                held = [np.concatenate([h, x[own]]) for h, x in zip(held, (ids, data, far), strict=True)]
                while len(held[0]) >= size:
                    yield pack(int(cell), *[h[:size] for h in held])
                    held = [h[size:] for h in held]
                waiting[int(cell)] = held
        for cell, held in waiting.items():
            if len(held[0]):
                yield pack(cell, *held)

    return rows.mapInArrow(run, "cell int, ids binary, vectors binary, radius double, count long")


def needed_cells(pivots: np.ndarray, data: dict[int, tuple[float, int]], queries: dict[int, float], k: int) -> list[tuple[int, int]]:
    """Pairs (query group, cell) that may hold one of a query's ``k`` highest scores.

    With query ``p + u`` and vector ``c + r``: ``(p+u)(c+r)`` lies within ``|p||r| + |u||c| +
    |u||r|`` of ``pc``. A group's floor is the largest value that cells with more than ``k``
    vectors (a query may be one of them) reach for certain.
    """
    out = []
    for group, radius in sorted(queries.items()):
        p = pivots[group]
        low, high, sizes, cells = [], [], [], sorted(data)
        for cell in cells:
            c, (r, count) = pivots[cell], data[cell]
            middle = float(p @ c)
            slack = float(np.linalg.norm(p) * r + radius * np.linalg.norm(c) + radius * r) + 1e-6 * (1 + abs(middle))
            low.append(middle - slack)
            high.append(middle + slack)
            sizes.append(count)
        floor, seen = -np.inf, 0
        for i in np.argsort(low)[::-1]:
            seen += sizes[i]
            if seen > k:
                floor = low[i]
                break
        out += [(group, cell) for cell, top in zip(cells, high, strict=True) if top >= floor]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest integer inner products.

    Both sides are ``(id, v)`` as ``whole_vectors`` gives them. A query meets every row but those
    with its own id; fewer than ``k`` others give fewer rows. Ties go to the smaller id. Repeated
    query ids are answered once per distinct id if their vectors are equal. Empty sides give no
    rows. The queries are a stated set that meets all needed rows in blocks; the summaries that
    reach the driver have one row per pivot.
    """
    session = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    if vectors.isEmpty() or queries.isEmpty():
        return session.createDataFrame([], schema)
    pivots = choose_pivots(vectors)
    data = cut_lineage(_blocks(vectors, pivots, DATA_BLOCK))
    asked = cut_lineage(_blocks(queries.dropDuplicates(["id"]), pivots, QUERY_BLOCK))
    cells = {r["cell"]: (r["radius"], r["count"]) for r in data.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("count").alias("count")).collect()}
    groups = {r["cell"]: r["radius"] for r in asked.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    # At most PIVOTS^2 pairs.
    needed = session.createDataFrame(needed_cells(pivots, cells, groups, k), "group int, cell int")
    sent = data.join(F.broadcast(needed), "cell").select("group", F.col("ids").alias("data_ids"), F.col("vectors").alias("data"))
    asked = asked.select(F.col("cell").alias("group"), F.col("ids").alias("query_ids"), F.col("vectors").alias("asked"))
    # Blocks of a group are spread: the pair of blocks is the unit of work.
    met = sent.join(asked, "group")
    width = pivots.shape[1]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["data_ids"], dtype=np.int64)
                names = np.frombuffer(row["query_ids"], dtype=np.int64)
                x = np.frombuffer(row["data"], dtype=np.int64).reshape(-1, width)
                q = np.frombuffer(row["asked"], dtype=np.int64).reshape(-1, width)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                if max(np.abs(x).max(), 1) * max(np.abs(q).max(), 1) * width < 2**52:
                    scores = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
                else:
                    scores = q @ x.T
                own = names[:, None] == ids[None, :]
                ranks = np.argsort(np.where(own, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(names)), ranks.shape[1])
                cols = ranks.ravel()
                kept = ~own[rows, cols]
                rows, cols = rows[kept], cols[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[rows]), pa.array(ids[cols]), pa.array(scores[rows, cols])], names=["query_id", "vec_id", "score"]
                )

    found = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
