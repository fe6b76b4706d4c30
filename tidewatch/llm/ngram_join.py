"""Near-duplicate classes by exact Jaccard similarity of word n-grams, with a token-group matrix.

1. Every text becomes a set of hashed shingles. Equal sets are one *node*.
2. Tokens have one order: rare ones by hash, then those in many texts by hash. A node's *prefix*
   holds its first tokens, enough that two sets within the threshold share some of them
   (``shared_least``).
3. Nodes with the same min-hash are compared with the node of fewest rare tokens among them.
   Links found so merge nodes into *groups* of similar texts.
4. The matrix stores the union of the prefixes of each group, one row per token and group, with
   the least and largest set size and the most tokens a member has from there on. Joined with the
   prefixes of the other nodes it bounds the overlap of a node with any member of a group: tokens
   before the first shared one are lost to both.
5. Only where the bound reaches the threshold in both directions are the members compared, again
   by prefixes first and then exactly. The links of steps 3 and 5 give the classes.

A large cluster thus costs one comparison per node (step 3) instead of all pairs; every pair of
different groups that could hold a link is compared, so no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import grams
from tidewatch.llm.common import fresh, release, small_batches, staged, thinned, tidy
from tidewatch.llm.components import components
from tidewatch.session import cut_lineage

#: Prefix tokens that two linked sets share at least, where small sets have as many in common.
SHARED = 3
#: Independent min-hashes that bring similar texts together.
SEEDS = 3
#: A token is frequent from this number of texts on, or from the least power of GRADES-th roots of 2
#: above which there are no more than FREQUENT_MOST. Only the token order depends on it, not the
#: result. A number that grew with the corpus would let the rare tokens' pairs grow with its square.
FREQUENT_LEAST = 10
FREQUENT_MOST = 1 << 20
GRADES = 8
#: Stands for a NULL key inside.
NO_KEY = -(2**63)
#: Shingles counted at a time, and local repeats from which a token is reported.
COUNT_BLOCK = 1 << 22
COUNT_LEAST = 2


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, data, offsets in grams.blocks(column):
        hashes, counts = grams.words(data, offsets)
        made, numbers = grams.shingles(hashes, counts, k)
        ends = np.cumsum(numbers)
        for begin, end in zip(ends - numbers, ends, strict=True):
            yield np.unique(made[begin:end])


def frequent_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles in many texts, sorted; found from counts over every text.

    Each task reports the tokens that repeat among the texts it holds at a time; reports are
    summed by token, so a token's sum is a lower bound of its number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            tokens, uses = np.unique(np.concatenate(held), return_counts=True)
            often = uses >= COUNT_LEAST
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(uses[often].astype(np.int64))], names=["token", "uses"]
            )

        for batch in batches:
            for tokens in _sets(batch.column(0), k):
                held.append(tokens)
                size += len(tokens)
                if size >= COUNT_BLOCK:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    summed = texts.mapInArrow(tidy(count), "token long, uses long").groupBy("token").agg(F.sum("uses").alias("uses"))
    summed = summed.filter(F.col("uses") >= FREQUENT_LEAST).select("token", F.floor(GRADES * F.log2("uses")).alias("grade"))
    summed = cut_lineage(summed)
    held, least = 0, 1 << 30
    for row in sorted(summed.groupBy("grade").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += row["n"]
        if held > FREQUENT_MOST:
            break
        least = row["grade"]
    often = summed.filter(F.col("grade") >= least).select("token").toPandas()
    return np.sort(often["token"].to_numpy(dtype=np.int64).view(np.uint64))


def least_size(percent: int) -> int:
    """Size below which a set can only be within the threshold of an equal one."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def shared_least(percent: int) -> int:
    """Prefix tokens that linked different sets share: SHARED, or all that the smallest must."""
    return min(SHARED, -(-percent * least_size(percent) // 100))


def signature(tokens: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that identify a set of shingles."""
    u, n = grams.U, len(tokens)
    if not n:
        return 0, 0, 0
    s1 = int(grams.mix(tokens * u(0x9FB21C651E98DF25) + u(n)).sum(dtype=np.uint64).astype(np.int64))
    return n, s1, int(grams.mix(tokens ^ u(0xD1342543DE82EF95)).sum(dtype=np.uint64).astype(np.int64))


def sketches(rows: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """``(doc, n, s1, s2, rare, homes, prefix)`` of ``(doc, text)``.

    ``s1`` and ``s2`` identify a set, ``rare`` counts its tokens that are not frequent, ``homes``
    are its min-hashes; sets too small to link to a different one have no homes and no prefix.
    """
    smallest, shared = least_size(percent), shared_least(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = grams.U
        for batch in batches:
            out: list[tuple] = []
            for tokens in _sets(batch.column("text"), k):
                n = len(tokens)
                _, s1, s2 = signature(tokens)
                if n < smallest:
                    out.append((n, s1, s2, n, None, None))
                    continue
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    known = frequent[at] == tokens
                    order = np.concatenate([tokens[~known], tokens[known]])
                    rare = n - int(known.sum())
                else:
                    order, rare = tokens, n
                length = min(n - -(-percent * n // 100) + shared, n)
                homes = [int(grams.mix(tokens + u(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min().astype(np.int64)) for j in range(SEEDS)]
                out.append((n, s1, s2, rare, homes, order[:length].view(np.int64)))
            n, s1, s2, rare, homes, prefix = zip(*out, strict=True) if out else ((),) * 6
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(x, pa.int64()) for x in (n, s1, s2, rare)], pa.array(homes, longs), pa.array(prefix, longs)],
                names=["doc", "n", "s1", "s2", "rare", "homes", "prefix"],
            )

    return rows.mapInArrow(tidy(run), "doc long, n long, s1 long, s2 long, rare long, homes array<long>, prefix array<long>")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of ``n`` and ``m`` tokens within the threshold."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are within the threshold, compared exactly.

    Only the texts of nodes in ``pairs`` are read again and turned into sets.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    spark = rows.sparkSession
    pairs = cut_lineage(pairs)
    release(spark)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    with small_batches(spark):
        sets = cut_lineage(_node_sets(rows, nodes.select("node", "doc", "n", "s1").join(wanted, "node"), k))
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("set_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("set_b")), "b")
    compared = both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(compare), "a long, b long, near boolean")
    with small_batches(spark):
        return cut_lineage(compared.filter("near").select("a", "b"))


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b, n_a, n_b, prefix_a, prefix_b)`` that prefixes do not rule out.

    Tokens before the first shared one are lost to both. Of the node whose prefix ends first in
    the common order, only tokens behind the prefix can be shared beyond the shared prefix.
    """
    pairs = pairs.withColumn("common", F.array_intersect("prefix_a", "prefix_b")).filter(F.size("common") >= shared_least(percent))
    first = F.element_at("common", 1)
    left_a = F.col("n_a") - F.array_position("prefix_a", first) + 1
    left_b = F.col("n_b") - F.array_position("prefix_b", first) + 1
    behind = F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
    most = F.least(left_a, left_b, F.size("common") + behind)
    return pairs.filter(most >= _needed(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()


def classes(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``documents``.

    Two texts link when ``100 * shared >= percent * union`` of their distinct ``k``-word shingles
    (A-Z lower-cased, words between white space; a text of fewer words is one shingle).
    ``component_id`` is the least key reachable by links, itself included. Texts that are NULL,
    empty or without words have no shingles and link with nothing, so their id is their own.
    Repeated rows are rows of the result each; NULL keys get the least key of their class. Other
    columns are ignored. Keys must be whole numbers.
    """
    named = _classed(documents, k, percent, key, text)
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("component_id"))
    return named.join(least, "root", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
    )


def _classed(documents: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """``(node, doc, n, root)`` of each row: its set, key, size and class; NULL without words."""
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("percent must be 1 to 100 and k at least 1")
    rows = documents.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("doc"), F.col(f"`{text}`").alias("text"))
    with small_batches(documents.sparkSession):
        sketched = staged(
            sketches(rows, frequent_tokens(rows.select("text"), k), k, percent).withColumn(
                "node", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2"))
            ),
            "sketches",
        )
    links = _links(rows, sketched, k, percent)
    found = components(links)
    light = sketched.select(F.when(F.col("doc") != NO_KEY, F.col("doc")).alias("doc"), "n", "node")
    return light.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _links(rows: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified pairs ``(a, b)`` of nodes that connect every class."""
    # One row per node that may link to a different one; a key stands for its text.
    nodes = staged(sketched.filter("prefix IS NOT NULL").dropDuplicates(["node"]), "nodes")
    release(rows.sparkSession)
    tails = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("prefix").alias("prefix_a"))
    heads = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("prefix").alias("prefix_b"))

    # Groups: each node against the node of fewest rare tokens with the same min-hash.
    homes = nodes.select("node", "n", "rare", F.posexplode("homes").alias("seed", "home"))
    leaders = homes.groupBy("seed", "home").agg(F.min(F.struct("rare", "n", "node"))["node"].alias("leader"), F.count("*").alias("members"))
    led = homes.join(leaders.filter("members > 1"), ["seed", "home"]).filter("leader != node")
    led = led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = _verified(_promising(led.join(tails, "a").join(heads, "b"), percent), rows, nodes, k, percent)
    grouped = nodes.join(components(near), "node", "left").withColumn("group", F.coalesce("root", "node"))
    grouped = staged(grouped.select("node", "n", "prefix", "group"), "groups")
    release(rows.sparkSession)

    # The matrix, and the bound of each node against the groups that hold tokens of its prefix.
    # All of it happens within the partitions of one shuffle by token; the matrix keeps a member,
    # so that both sides of the join read the same columns of that shuffle.
    tokens = grouped.select("node", "n", "group", F.posexplode("prefix").alias("place", "token")).repartition("token")
    matrix = tokens.groupBy("token", "group").agg(
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.max(F.col("n") - F.col("place")).alias("reach"),
        F.min("node").alias("member"),
    )
    matrix = matrix.withColumnRenamed("group", "other")
    # The first token that two linked sets share leaves each of them enough tokens from there on.
    smallest = F.greatest(F.col("least"), F.ceil(F.lit(percent) * F.col("n") / 100))
    fits = (
        (F.col("most") * 100 >= F.col("n") * percent)
        & (F.col("n") * 100 >= F.col("least") * percent)
        & (F.least(F.col("n") - F.col("place"), F.col("reach")) >= _needed(F.col("n"), smallest, percent))
    )
    met = tokens.join(matrix, "token").filter(F.expr("group != other AND node != member") & fits)
    opened = cut_lineage(met.select("node", "group", "other").distinct())
    del met
    release(rows.sparkSession)
    ours = opened.filter(F.col("group") < F.col("other")).select(F.col("node").alias("a"), "group", "other")
    theirs = opened.filter(F.col("group") > F.col("other")).select(
        F.col("node").alias("b"), F.col("other").alias("group"), F.col("group").alias("other")
    )
    pairs = ours.join(theirs, ["group", "other"]).select("a", "b")
    crossing = _verified(_promising(pairs.join(tails, "a").join(heads, "b"), percent), rows, nodes, k, percent)
    return near.union(crossing)


def _node_sets(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(node, tokens)``: the set of each node as sorted unsigned 64-bit integers.

    A key that stands for a node may occur with several texts; the node's own signature picks
    the right one.
    """
    texts = thinned(rows, "doc", nodes.select("doc")).join(nodes, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made, fits = [], []
                for tokens, n, s1 in zip(_sets(part.column("text"), k), part.column("n").to_pylist(), part.column("s1").to_pylist(), strict=True):
                    sign = int(grams.mix(tokens * grams.U(0x9FB21C651E98DF25) + grams.U(len(tokens))).sum(dtype=np.uint64).astype(np.int64)) if len(tokens) else 0
                    fits.append(len(tokens) == n and sign == s1)
                    made.append(tokens.tobytes())
                found = pa.RecordBatch.from_arrays([part.column("node"), pa.array(made, pa.binary())], names=["node", "tokens"])
                yield found.filter(pa.array(fits))

    return texts.select("text", "node", "n", "s1").mapInArrow(tidy(run), "node long, tokens binary").dropDuplicates(["node"])


def one_per_class(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each class: the one with the least key.

    Rows without words are all kept. No key stands for a NULL one, so a class keeps one row of
    NULL key besides. Of rows with the same least key the least set signature stays, and of equal
    sets the row whose columns, the text first, come first as JSON. Only the rows of such a key
    and set are shuffled whole for it.
    """
    mark, order = fresh(documents, "mark", "order")
    named = cut_lineage(_classed(documents, k, percent, key, text).filter("node IS NOT NULL").select("doc", "node", "root"))
    held = named.groupBy("root", "doc", "node").agg(F.count("*").alias("copies")).withColumn("unnamed", F.expr("doc IS NULL"))
    best = held.groupBy("root", "unnamed").agg(F.min(F.struct("doc", "node")).alias("best"))
    held = held.join(best, ["root", "unnamed"]).withColumn("stays", F.expr("node = best.node AND doc <=> best.doc"))
    # Rows that go, and those of which one goes on: both by key and set.
    turns = held.filter("NOT stays OR copies > 1").select("doc", "node", "stays")
    signed = _signed(documents, k, text, mark)
    met = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("doc")) & (F.col(mark) == F.col("node"))
    sole = signed.join(turns, met, "left_anti").drop(mark)
    several = signed.join(turns.filter("stays").drop("stays"), met, "left_semi")
    first = Window.partitionBy(mark).orderBy(F.col(f"`{text}`"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])))
    one = several.withColumn(order, F.row_number().over(first)).filter(F.col(order) == 1).drop(mark, order)
    return sole.unionByName(one)


def _signed(documents: DataFrame, k: int, text: str, name: str) -> DataFrame:
    """``documents`` with the node of each row's set, NULL without words."""
    added = fresh(documents, "n", "s1", "s2")
    schema = T.StructType([*documents.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(tokens) for tokens in _sets(batch.column(text), k)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*signs, strict=True) if signs else ((),) * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    size = F.col(added[0])
    return documents.mapInArrow(tidy(run), schema).withColumn(name, F.when(size > 0, F.xxhash64(*added))).drop(*added)
