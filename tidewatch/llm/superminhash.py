"""Near-duplicate classes: SuperMinHash signatures, banding, verification, union-find.

1. Every text becomes a set of hashed word shingles; equal sets are one *node*. A set's signature has
   PLACES places. In step ``j`` every element draws a place from those it has not had (a step
   of its own random permutation) and offers ``j`` plus a random fraction; a place keeps the least
   offer. Steps end for a text as soon as no place can be improved: every later offer is greater.
2. Places make bands, of the most places with which two sets at the threshold share no band with a
   chance of at most MISSED (at 0.85: 32 bands of 6 places, 3e-7). In a bucket of equal bands every
   node is compared, on full sets, with one *leader* of the bucket, the node with the largest buckets.
3. Two nodes of a bucket that both link to its leader are in one class. For the others the full sets
   were taken apart by the leader: ``dev(x)`` are the shingles in which ``x`` and the leader differ, and
   ``x`` and ``y`` differ by ``|dev(x)| + |dev(y)| - 2 |dev(x) & dev(y)|``. A link thus needs a number of
   common deviations, at least one; nodes that share one among the first of an order (rare ones
   first), early enough to reach that number, are compared on full sets. So the pairs of a large bucket
   are never listed, and no link inside a bucket is lost.
4. Union-find over the links, in each task and then across tasks, gives the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import grams
from tidewatch.llm.common import small_batches, staged, thinned
from tidewatch.llm.components import components
from tidewatch.session import cut_lineage

PLACES = 192
#: Largest chance that two sets at the threshold share no band.
MISSED = 1e-6
#: Elements and texts whose places are drawn together.
ELEMENTS, TEXTS = 1 << 17, 2048
#: Links that a task holds in its union-find at a time.
LINKS = 1 << 18
#: A deviation is frequent that so large a share of a leader's nodes has, and so many of them at least.
#: Only the order of deviations depends on it.
FREQUENT_SHARE, FREQUENT_LEAST = 1 / 16, 4
#: Stands for a NULL key inside.
NO_KEY = -(2**63)

U = grams.U
STEP = U(56)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of the texts of a block, one text after another, and their numbers."""
    for _, data, offsets in grams.blocks(column):
        made, counts = grams.shingles(*grams.words(data, offsets), k)
        text = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((made, text))
        made, text = made[order], text[order]
        new = np.ones(len(made), dtype=bool)
        new[1:] = (made[1:] != made[:-1]) | (text[1:] != text[:-1])
        yield made[new], np.bincount(text[new], minlength=len(counts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of each text's values, modulo 2^64."""
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


def _marks(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that identify each set together with its size."""
    size = np.repeat(counts, counts).astype(np.uint64)
    first = _sums(grams.mix(tokens * U(0x9FB21C651E98DF25) + size), counts)
    return first.view(np.int64), _sums(grams.mix(tokens ^ U(0xD1342543DE82EF95)), counts).view(np.int64)


def signatures(tokens: np.ndarray, counts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` values per set; a value's top byte is the step that offered it."""
    out = np.full(len(counts) * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    owners = np.repeat(np.arange(len(counts)), counts)
    for begin in range(0, len(tokens), ELEMENTS):
        element, owner = tokens[begin : begin + ELEMENTS], owners[begin : begin + ELEMENTS]
        row = np.arange(len(element)) * places
        permutation = np.tile(np.arange(places, dtype=np.uint8), len(element))
        for step in range(places):
            draw = grams.mix(element + U((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            other = row + step + ((grams.mix(draw) >> U(40)) * U(places - step) >> U(24)).astype(np.int64)
            place = permutation[other]
            permutation[other] = permutation[row + step]
            permutation[row + step] = place
            np.minimum.at(out, owner * places + place, (U(step) << STEP) | (draw >> U(8)))
            # An element matters while its text has a place that a later step may still improve.
            first, last = int(owner[0]), int(owner[-1]) + 1
            worst = out[first * places : last * places].reshape(-1, places).max(axis=1)
            goes_on = (worst >= U(step + 1) << STEP)[owner - first]
            if not goes_on.all():
                element, owner, row = element[goes_on], owner[goes_on], row[goes_on]
            if not len(element):
                break
    return out.reshape(len(counts), places)


def band_places(percent: int) -> int:
    """Places of a band: the most that divide PLACES and keep the chance of a missed link low."""
    fits = [r for r in range(1, 33) if PLACES % r == 0 and (1 - (percent / 100) ** r) ** (PLACES // r) <= MISSED]
    return max(fits, default=1)


def _bands(signature: np.ndarray, places: int) -> np.ndarray:
    parts = signature.reshape(len(signature), PLACES // places, places)
    out = np.arange(1, PLACES // places + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    out = np.tile(out, (len(signature), 1))
    for i in range(places):
        out = grams.mix(out * U(0x2545F4914F6CDD1D) + parts[:, :, i])
    return out.view(np.int64)


def least_size(percent: int) -> int:
    """Size below which a set can only be within the threshold of an equal one."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def sketches(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc, n, s1, s2, bands)`` of ``(doc, text)``; sets too small for links have no bands."""
    smallest, places = least_size(percent), band_places(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, done = batch.slice(at, TEXTS), 0
                for tokens, counts in _sets(part.column("text"), k):
                    s1, s2 = _marks(tokens, counts)
                    large = counts >= smallest
                    bands = _bands(signatures(tokens[np.repeat(large, counts)], counts[large]), places)
                    ends = np.concatenate(([0], np.cumsum(large * (PLACES // places))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc").slice(done, len(counts)),
                            *[pa.array(v, pa.int64()) for v in (counts, s1, s2)],
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.reshape(-1), pa.int64())),
                        ],
                        names=["doc", "n", "s1", "s2", "bands"],
                    )
                    done += len(counts)

    return rows.mapInArrow(run, "doc long, n long, s1 long, s2 long, bands array<long>")


def _sets_of(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(node, tokens)``: the set of each of ``nodes (node, doc, n, s1, s2)`` as sorted 64-bit integers.

    A key may occur with several texts; sizes and sums pick the node's own.
    """
    texts = thinned(rows, "doc", nodes.select("doc")).join(nodes, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, done = batch.slice(at, 500), 0
                for tokens, counts in _sets(part.column("text"), k):
                    own = part.slice(done, len(counts))
                    done += len(counts)
                    made = zip(counts, *_marks(tokens, counts), strict=True)
                    wanted = zip(*(own.column(c).to_pylist() for c in ("n", "s1", "s2")), strict=True)
                    fits = [tuple(map(int, m)) == w for m, w in zip(made, wanted, strict=True)]
                    ends = np.cumsum(counts)
                    cells = [tokens[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                    found = pa.RecordBatch.from_arrays([own.column("node"), pa.array(cells, pa.binary())], names=["node", "tokens"])
                    yield found.filter(pa.array(fits))

    found = texts.select("text", "node", "n", "s1", "s2").mapInArrow(run, "node long, tokens binary")
    return found.dropDuplicates(["node"])


def _compared(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, percent: int, deviations: bool) -> DataFrame:
    """``(a, b, n, near, dev)`` for pairs ``(a, b)`` of nodes, from their full sets.

    ``n`` is the size of ``a`` and ``dev``, if asked for, the shingles in which the sets differ: those
    that only ``a`` has, then those that only ``b`` has.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, near, dev = [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                hit = b[at] == a
                shared = int(hit.sum())
                sizes.append(len(a))
                near.append(100 * shared >= percent * (len(a) + len(b) - shared))
                if deviations:
                    missing = np.ones(len(b), dtype=bool)
                    missing[at[hit]] = False
                    dev.append(np.concatenate([a[~hit], b[missing]]).view(np.int64))
            made = [pa.array(sizes, pa.int64()), pa.array(near, pa.bool_()), pa.array(dev or [None] * len(sizes), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *made], names=["a", "b", "n", "near", "dev"])

    pairs = cut_lineage(pairs)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = nodes.select("node", "doc", "n", "s1", "s2").join(wanted, "node")
    with small_batches(rows.sparkSession):
        sets = staged(_sets_of(rows, wanted, k), "sets")
        # Both inputs of each join are plain shuffles, so adaptive execution splits those of a hot leader.
        first = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("set_a")), "a")
        both = first.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("set_b")), "b")
        compared = both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long, n long, near boolean, dev array<long>")
        return staged(compared, "compared")


def _led(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: every node of a bucket with the bucket's leader.

    The leader is the node whose buckets hold most nodes in all, the most central one of its like.
    """
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    sizes = cut_lineage(buckets.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = cut_lineage(buckets.join(sizes, "band"))
    scores = cut_lineage(shared.groupBy("node").agg(F.sum("members").alias("score")))
    order = F.struct("score", F.xxhash64("node"), "node")
    leaders = cut_lineage(shared.join(scores, "node").groupBy("band").agg(F.max(order)["node"].alias("leader")))
    met = shared.select("node", "band").join(leaders, "band").filter("leader != node")
    return met.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def _beside(compared: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of nodes with one leader that may link though one of them does not link to it.

    Let ``d`` be the number of a node's deviations from the leader. Sets that link differ in at most
    ``most = (100 - percent) (n + n') / (100 + percent)`` shingles, so they share at least
    ``(d + d' - most) / 2`` deviations. If that is not above 0, both link to the leader. Of the node
    with more deviations the first ``most + 1`` are looked up, of the other one the first
    ``most / 2 + 1``, with ``most`` for the largest partner; and from the first one they share on, both
    have as many left as they need.
    """
    several = compared.groupBy("b").agg(F.count("*").alias("members"), F.count_if(~F.col("near")).alias("apart"))
    several = cut_lineage(several.filter("members > 1 AND apart > 0").select("b", "members"))
    rows = staged(compared.join(several, "b"), "beside")
    uses = rows.select("b", "members", F.explode("dev").alias("token")).groupBy("b", "token").agg(F.count("*").alias("uses"), F.max("members").alias("members"))
    often = uses.filter(F.col("uses") >= F.greatest(F.lit(FREQUENT_LEAST), FREQUENT_SHARE * F.col("members")))
    often = cut_lineage(often.groupBy("b").agg(F.collect_set("token").alias("often")))
    most = F.expr(f"({100 - percent} * (n + (100 * n) div {percent})) div {100 + percent}")
    rare_first = F.when(F.col("often").isNull(), F.col("dev")).otherwise(
        F.concat(F.array_except("dev", "often"), F.array_intersect("dev", "often"))
    )
    rows = rows.join(often, "b", "left").select("a", "b", "n", "near", F.size("dev").alias("d"), most.alias("most"), rare_first.alias("dev"))
    first = F.slice("dev", F.lit(1), (F.col("most") + 1).cast("int"))
    rows = staged(rows.select("a", "b", "n", "near", "d", "most", F.posexplode(first).alias("at", "token")), "deviations")
    heavy = rows.select("b", "token", *[F.col(c).alias(f"{c}1") for c in ("a", "n", "near", "d", "at")])
    light = rows.filter("at <= most div 2").select("b", "token", *[F.col(c).alias(f"{c}2") for c in ("a", "n", "near", "d", "at")])
    apart = f"({100 - percent} * (n1 + n2)) div {100 + percent}"
    fits = F.expr(
        f"(d1 > d2 OR d1 = d2 AND a1 > a2) AND NOT (near1 AND near2) AND 100 * least(n1, n2) >= {percent} * greatest(n1, n2)"
        f" AND 2 * least(d1 - at1, d2 - at2) >= d1 + d2 - {apart}"
    )
    return heavy.join(light, ["b", "token"]).filter(fits).select(F.col("a1").alias("a"), F.col("a2").alias("b")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: each node with the root of its tree."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def trees() -> pa.RecordBatch:
        ends = [root(x) for x in list(above)]
        return pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array(ends, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
        if len(above) >= LINKS:
            yield trees()
            above.clear()
    if above:
        yield trees()


def classes(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``documents``.

    Two texts link when ``100 * shared >= percent * union`` of their distinct ``k``-word shingles
    (A-Z lower-cased, words between white space; a text of fewer words is one shingle), confirmed on
    full sets of 64-bit hashes. A link is lost only if the two signatures share no band.
    ``component_id`` is the least key reachable by links, itself included, and ``kept`` says that it is
    the row's own. Texts that are NULL, empty or without words have no shingles and link with nothing.
    Repeated rows are rows of the result each; rows of NULL key get the least key of their class, and
    are kept where it has none. Other columns are ignored. Keys must be whole numbers.
    """
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("percent must be 1 to 100 and k at least 1")
    rows = documents.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("doc"), F.col(f"`{text}`").alias("text"))
    with small_batches(documents.sparkSession, 2_000):
        sketched = staged(sketches(rows, k, percent).withColumn("node", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2"))), "sketches")
    nodes = staged(sketched.filter("size(bands) > 0").dropDuplicates(["node"]), "nodes")
    compared = _compared(_led(nodes), rows, nodes, k, percent, deviations=True)
    beside = _compared(_beside(compared, percent), rows, nodes, k, percent, deviations=False)
    links = compared.unionByName(beside).filter("near").select("a", "b")
    found = components(links.mapInArrow(_forest, "a long, b long"))

    # One row per node: its least key, and that of its class.
    shown = F.when(F.col("doc") != NO_KEY, F.col("doc"))
    least = cut_lineage(sketched.filter("node IS NOT NULL").groupBy("node").agg(F.min(shown).alias("first")))
    rooted = cut_lineage(least.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    firsts = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut_lineage(rooted.select("node", "root").join(firsts, "root").select("node", "component_id"))
    out = sketched.select(shown.alias("doc_id"), F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
