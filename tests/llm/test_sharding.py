import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def brute(rows, shards, seed):
    """(source, doc_id) rows to (shard, slot) by the definition; keys must be distinct."""
    by_source = defaultdict(list)
    for source, doc in rows:
        dice = hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        by_source[source].append((dice, doc))
    ranked = []
    for source, own in by_source.items():
        for rank, (dice, doc) in enumerate(sorted(own), 1):
            ranked.append(((2 * rank - 1) / (2 * len(own)), dice, doc))
    out, filled = {}, defaultdict(int)
    for place, (_, _, doc) in enumerate(sorted(ranked)):
        shard = place * shards // len(ranked)
        out[doc] = (shard, filled[shard])
        filled[shard] += 1
    return out


def test_query_against_brute_force(spark):
    found = queries.QUERIES["op6_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = brute([(s, d) for d, (_, s) in texts.items()], 24, sharding.SEED)
    assert len(found) == len(texts)
    for row in found:
        body = texts[row["doc_id"]][0].encode()
        assert (row["shard"], row["slot"]) == expected[row["doc_id"]]
        assert row["size"] == len(body) + 8 and row["text_crc32"] == zlib.crc32(body)
        assert row["law"] == "rows" and row["grown_shard"] is None


def test_every_shard_has_the_mixture(spark):
    rows = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 8)).alias("source"))
    placed = sharding.interleave(rows).toPandas()
    counts = placed.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert set(placed.groupby("shard").size()) == {100}
    assert (counts.max() - counts.min()).max() <= 2


def test_nulls_repeats_clashes_and_empty(spark):
    schema = "doc_id long, source string, shard string, kept string, one int"
    data = [(1, "a", "x", "k", 1), (1, "a", "x", "k", 1), (None, None, None, None, None), (2, None, "", "", 0), (1, "a", "y", "k", 1)]
    placed = sharding.interleave(spark.createDataFrame(data, schema), shards=2).collect()
    assert len(placed) == 5 and {r["shard"] for r in placed} == {0, 1}
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert set(placed[0].asDict()) == {"doc_id", "source", "kept", "one", "shard", "slot"}
    assert sharding.interleave(spark.createDataFrame([], schema)).count() == 0
    sizes = sharding.measured(spark.createDataFrame([(1, None, "a"), (2, "é", None)], "doc_id long, text string, source string"))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sizes.collect()} == {(1, 8, 0), (2, 10, zlib.crc32("é".encode()))}
