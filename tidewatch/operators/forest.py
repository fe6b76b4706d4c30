"""Random forest on binned rows: histograms per node are summed by Spark, the driver sees splits only.

Numbers are cut into at most BINS bins and rows that are then equal are counted once. The
bootstrap draws a Poisson number for every row and tree, and the sum of n such draws is a Poisson
number of mean n, so a counted row is drawn for exactly as its n rows would be.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

# Ship these functions with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Bytes of histograms that a task may hold; trees beyond that are grown in a further pass.
HISTOGRAM_BYTES = 64 << 20


def bin_bounds(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Lower bounds of all bins but the first, per column: all values where they are few, else quantiles."""
    if not columns:
        return []
    shares = [i / BINS for i in range(1, BINS)]
    values = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    facts = [
        f
        for i, c in enumerate(columns)
        for f in (
            F.approx_count_distinct(values[c]).alias(f"kinds_{i}"),
            F.min(values[c]).alias(f"least_{i}"),
            F.percentile_approx(values[c], shares).alias(f"cuts_{i}"),
        )
    ]
    found = df.agg(*facts).first()
    # The count of values is an estimate, so those of somewhat larger counts are looked at as well.
    few = [i for i in range(len(columns)) if found[f"kinds_{i}"] <= 2 * BINS]
    sets = df.agg(*[F.collect_set(values[columns[i]]).alias(f"all_{i}") for i in few]).first() if few else {}
    bounds = []
    for i in range(len(columns)):
        cuts = found[f"cuts_{i}"] or []
        if i in few and len(sets[f"all_{i}"]) <= BINS:
            cuts = sets[f"all_{i}"]
        bounds.append(sorted({x for x in cuts if math.isfinite(x) and x > found[f"least_{i}"]}))
    return bounds


@dataclass
class Forest:
    """Trees in heap order. A row goes right where the code of the node's column is from ``low`` to ``high``."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    probability: np.ndarray

    def nodes(self, tree: int, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after ``levels`` steps; ``codes`` has one line per column."""
        rows, node = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64)
        column, low, high, child = self.column[tree], self.low[tree], self.high[tree], self.child[tree]
        for _ in range(levels):
            code = codes[column[node], rows]
            node = child[2 * node + ((code >= low[node]) & (code <= high[node]))]
        return node

    def predict(self, codes: list[Column]) -> Column:
        """A struct of ``prediction``, the likeliest label's index, and ``second``, the second label's probability."""
        depth = int(math.log2(self.column.shape[1] + 1)) - 1

        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for part in parts:
                matrix = np.array([p.to_numpy(np.int32) for p in part])
                votes = np.zeros((matrix.shape[1], self.probability.shape[2]))
                for tree in range(len(self.column)):
                    votes += self.probability[tree][self.nodes(tree, matrix, depth)]
                yield pd.DataFrame({"prediction": votes.argmax(axis=1), "second": votes[:, 1] / len(self.column)})

        score.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(score, "prediction long, second double")(*codes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted rows packed by the batch: codes by column, labels and counts. A block's number seeds its draws."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        *codes, label, n = (np.asarray(c) for c in batch.columns)
        yield pa.RecordBatch.from_pydict(
            {
                "block": [part << 32 | number],
                "codes": [np.array(codes, np.int32).tobytes()],
                "label": [label.astype(np.int32).tobytes()],
                "n": [n.astype(np.int64).tobytes()],
            }
        )


def _best_split(found: np.ndarray, weights: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Place, first bin on the right, and the counts per class of both sides of the split with the most gain.

    ``found`` has drawn rows by place, bin and class. None if no split lowers the Gini impurity.
    """
    left = found.cumsum(axis=1)[:, :-1]
    right = found.sum(axis=1, keepdims=True) - left

    def impure(counts):
        weighed = counts * weights
        whole = weighed.sum(axis=-1)
        return whole - (weighed**2).sum(axis=-1) / np.where(whole > 0, whole, 1)

    gain = impure(found[:1].sum(axis=1)) - impure(left) - impure(right)
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -1.0)
    place, cut = np.unravel_index(gain.argmax(), gain.shape)
    if gain[place, cut] <= 1e-9 * (found[0].sum(axis=0) * weights).sum():
        return None
    return int(place), int(cut) + 1, left[place, cut], right[place, cut]


def grow_forest(
    rows: DataFrame, columns: list[str], label: str, kinds: list[int], bins: int, weights: list[float], trees: int, depth: int, seed: int
) -> Forest:
    """``columns`` hold codes from 0: bins in order where ``kinds`` is 0, else so many kinds, each a feature of its own.

    ``label`` holds the index of a class in ``weights``. Each node tries a random choice of as many
    features as the root of their number; a single tree tries all.
    """
    features = [(c, -1) if not k else (c, v) for c, k in enumerate(kinds) for v in range(k or 1)]
    at, value = (np.array([f[i] for f in features], np.int32) for i in (0, 1))
    tried, width = (math.ceil(math.sqrt(len(features))) if trees > 1 else len(features)), max(bins, 2)
    weight, classes, size = np.array(weights), len(weights), 2 ** (depth + 1) - 1
    counted = rows.groupBy(*columns, label).agg(F.count(F.lit(1)).alias("n"))
    blocks = cut_lineage(counted.mapInArrow(_blocks, "block long, codes binary, label binary, n binary"))
    itself = np.tile(np.arange(size).repeat(2), (trees, 1))
    forest = Forest(*[np.zeros((trees, size), np.int32) for _ in range(3)], itself, np.full((trees, size, classes), 1 / classes))
    rng = np.random.default_rng(seed)
    open_nodes = [(tree, 0) for tree in range(trees)]
    for level in range(depth):
        chosen = {pair: np.sort(rng.permutation(len(features))[:tried]) for pair in open_nodes}
        most = max(1, HISTOGRAM_BYTES // (tried * width * classes * 8))
        following = []
        for start in range(0, len(open_nodes), most):
            these = open_nodes[start : start + most]
            sums = _histograms(blocks, forest, these, chosen, level, at, value, len(columns), width, classes, seed)
            for tree, node, place, cut, *sides in _splits(sums, tried, width, weight):
                left, right = (np.frombuffer(s, np.float64) for s in sides)
                if node == 0 and (left + right).sum() > 0:
                    forest.probability[tree, 0] = _shares(left + right, weight)
                if place < 0:
                    continue
                feature = chosen[tree, node][place]
                forest.column[tree, node] = at[feature]
                own = value[feature]
                forest.low[tree, node], forest.high[tree, node] = (cut, 2**31 - 1) if own < 0 else (own, own)
                for side, counts in ((1, left), (2, right)):
                    below = 2 * node + side
                    forest.child[tree, 2 * node + side - 1] = below
                    forest.probability[tree, below] = _shares(counts, weight)
                    if (counts > 0).sum() > 1:
                        following.append((tree, below))
        open_nodes = sorted(following)
    return forest


def _shares(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return counts * weight / (counts * weight).sum()


def _histograms(blocks, forest, wanted, chosen, level, at, value, lines, width, classes, seed) -> DataFrame:
    """``(tree, node, found)`` per task and wanted node: drawn rows by tried feature, bin and class."""
    size = forest.column.shape[1]
    places = {tree: [node for t, node in wanted if t == tree] for tree in dict.fromkeys(t for t, _ in wanted)}
    tried = len(chosen[wanted[0]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {tree: np.zeros(len(nodes) * tried * width * classes) for tree, nodes in places.items()}
        for block, codes, label, n in (row.values() for b in batches for row in b.to_pylist()):
            codes = np.frombuffer(codes, np.int32).reshape(lines, -1)
            label, n = np.frombuffer(label, np.int32), np.frombuffer(n, np.int64)
            for tree, nodes in places.items():
                slots = np.full(size, -1)
                slots[nodes] = np.arange(len(nodes))
                subset = np.array([chosen[tree, node] for node in nodes])
                drawn = np.random.default_rng([seed, tree, block]).poisson(n)
                slot = slots[forest.nodes(tree, codes, level)]
                held = np.flatnonzero((slot >= 0) & (drawn > 0))
                slot, weight, own = slot[held], drawn[held], label[held]
                for i in range(tried):
                    feature = subset[slot, i]
                    code, kind = codes[at[feature], held], value[feature]
                    code = np.where(kind < 0, code, code == kind)
                    sums[tree] += np.bincount(((slot * tried + i) * width + code) * classes + own, weight, len(sums[tree]))
        found = [(t, node, part.tobytes()) for t, nodes in places.items() for node, part in zip(nodes, sums[t].reshape(len(nodes), -1))]
        yield pa.RecordBatch.from_pydict(dict(zip(("tree", "node", "found"), map(list, zip(*found)))))

    return blocks.mapInArrow(count, "tree long, node long, found binary")


def _splits(sums: DataFrame, tried: int, width: int, weight: np.ndarray) -> list:
    """Rows ``(tree, node, place, cut, left, right)``; place is -1 where a node stays a leaf."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(tried * width * len(weight))
        for blob in part["found"]:
            found += np.frombuffer(blob, np.float64)
        found = found.reshape(tried, width, len(weight))
        none = (-1, 0, found[0].sum(axis=0), np.zeros(len(weight)))
        place, cut, left, right = _best_split(found, weight) or none
        names = ("tree", "node", "place", "cut", "left", "right")
        first = part.iloc[0]
        return pd.DataFrame([(first["tree"], first["node"], place, cut, left.tobytes(), right.tobytes())], columns=names)

    schema = "tree long, node long, place long, cut long, left binary, right binary"
    return sums.groupBy("tree", "node").applyInPandas(choose, schema).collect()
