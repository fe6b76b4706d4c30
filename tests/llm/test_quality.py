import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewatch.llm import grams, quality, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", low)


def test_features_are_unigrams_and_bigrams(spark):
    texts = ["the cat!! sat", "", None, "the cat!! sat", "the", "é\tthe\n\nthe the"]
    for _, data, offsets in grams.blocks(pa.array(texts)):
        found, counts = quality.features(data, offsets)
    ends = np.cumsum(counts)
    bags = [Counter(found[e - c : e].tolist()) for c, e in zip(counts, ends, strict=True)]
    assert bags[0] == bags[3]
    for text, bag in zip(texts, bags, strict=True):
        words = tokens(text or "")
        grams_of = Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))
        assert sorted(bag.values()) == sorted(grams_of.values())


def test_weights_against_brute_force(spark):
    model = quality.Model(np.linspace(-1, 1, quality.BUCKETS), 0.25)
    texts = [None, "", "a b c", "a b c", "x " * 3000, "  "]
    rows = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)], "doc_id long, text string, log_weight double")
    found = {r["doc_id"]: r for r in quality.weigh(rows, model).collect()}
    for i, text in enumerate(texts):
        for _, data, offsets in grams.blocks(pa.array([text], pa.string())):
            one, _ = quality.features(data, offsets)
        assert found[i]["features"] == len(one) == max(2 * len(tokens(text or "")) - 1, 0)
        assert math.isclose(found[i]["log_weight"], (model.ratio[one] - 0.25).sum(), abs_tol=1e-5)


def test_selection_keeps_good_and_drops_bad(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in queries.QUERIES["op3_quality"](spark, SF).collect()}
    good = [d in kept for d, q in labels.items() if q == 1]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_top_k_is_the_k_highest_keys(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = quality.select(rows, labels, k=50).collect()
    every = quality.keyed(rows, quality.fit(rows, labels)).collect()
    edge = sorted((r["sort_key"] for r in every), reverse=True)[49]
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in every if r["sort_key"] >= edge}


def test_odd_tables(spark):
    schema = "doc_id long, text string, good int, key string, one int"
    empty = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.select(empty, labels).collect() == []
    rows = spark.createDataFrame([(1, "a b", 1, "k", 1), (1, "a b", 1, "k", 1), (None, None, None, None, None), (2, "", 0, "", 0)], schema)
    kept = quality.select(rows, labels)
    assert kept.count() == 4 and {"good", "key", "one"} < set(kept.columns)
    assert quality.select(rows, labels, k=0).count() == 0


def test_ranking_sends_no_text_back_and_blocks_are_small(spark, monkeypatch):
    """Memory of a Python worker: few texts at a time, and the ranking has no use for them."""
    docs = spark.createDataFrame([(i, f"word{i} other{i % 7} text") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    plain = quality.running_totals
    monkeypatch.setattr(quality, "running_totals", lambda df, *a, **b: (seen.append(quality_conf(df)), plain(df, *a, **b))[1])
    kept = quality.select(docs, labels)
    rows, fields = seen[0]
    assert rows <= 1_000 and "text" not in fields
    model = quality.fit(docs, labels)
    whole, thin = (quality.keyed(docs, model, whole=w) for w in (True, False))
    assert thin.columns == [c for c in whole.columns if c != "text"]
    assert sorted(whole.drop("text").collect()) == sorted(thin.collect())
    assert kept.columns == whole.columns and quality.BLOCK < quality.grams.BLOCK


def quality_conf(df):
    """Rows of an Arrow batch now, and the columns that Python gives back."""
    plan = df._jdf.queryExecution().analyzed().toString()
    returned = next(line for line in plan.splitlines() if "MapInArrow" in line).split("[", 1)[1]
    return int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), returned


def test_workers_give_free_memory_back():
    """What a task allocated and freed is not kept for the worker's later tasks."""
    from pathlib import Path

    from tidewatch.llm.common import tidy

    def own():
        found = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        return int(found[0]) / 1024

    def run(batches):
        for batch in batches:
            held = [bytes(50_000) for _ in range(2_000)]
            # The last piece lies above the others, so the heap cannot shrink by itself.
            top = bytes(50_000)
            del held
            kept.append(top)
            yield batch

    kept, before = [], own()
    assert list(tidy(run)(iter(["a", "b"]))) == ["a", "b"] and run.__name__ == tidy(run).__name__
    assert own() - before < 60
