import random
import re

import pytest

from tidewatch.llm import ngram_join, queries
from tidewatch.llm.components import components


def shingles(text, k):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = re.findall(rb"[^\x20\x09-\x0d]+", low)
    if len(found) < k:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))


def brute(rows, k, percent):
    sets = [(key, shingles(text, k)) for key, text in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i), key) if s else key) for i, (key, s) in enumerate(sets)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice((1, 2, 5, 9, 14, 40, 90)))] for _ in range(10)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "é É", "long " * 5000]
    for _ in range(110):
        text = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            text[rng.randrange(len(text))] = word()
        texts.append(" ".join(text))
    for _ in range(25):  # unlike texts that share a passage
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]))
    rng.shuffle(texts)
    rows = [(i * 7 % 1009 - 20, t) for i, t in enumerate(texts)]
    return rows + [(rows[3][0], rows[3][1]), (rows[5][0], rows[60][1]), (None, rows[20][1]), (None, "quite alone here")]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (3, 100, 4)])
def test_against_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, n int")
    found = ngram_join.classes(frame, k, percent).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, k, percent)


@pytest.mark.parametrize("leader", ["frequent", "none"])
def test_a_large_cluster(spark, monkeypatch, leader):
    if leader == "none":
        monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 10**9)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for key in range(400):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((key, " ".join(text)))
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, 3, 90)


def test_one_per_class_and_empty(spark):
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (9, ""), (8, None), (None, "a b c d e f"), (5, "other words stand here now")]
    frame = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, mark string")
    kept = ngram_join.one_per_class(frame)
    assert kept.columns == ["doc_id", "text", "mark"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 5, 8, 9, None]
    assert ngram_join.one_per_class(frame.limit(0)).collect() == []


def test_query_runs_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.QUERIES["op5_ngram_join"](spark, folder).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, 3, 90)


def test_components(spark):
    rng = random.Random(2)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1001), (1002, 1000), (5000, 5000), (None, 3), (7, None), (1001, 1000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(300), 0), **dict.fromkeys((1000, 1001, 1002), 1000), 5000: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_per_class_of_clashing_and_repeated_rows(spark):
    x, y, z, w = ("".join(f"{c}{i} " for i in range(30)) for c in "xyzw")
    rows = [(3, x), (3, x), (5, x + "more"), (5, y), (None, z), (None, z), (None, x), (7, z + "more"), (None, w), (None, w), (8, ""), (8, ""), (None, None)]
    rows += [(9, "a b c d e f A B"), (9, "A B C D E F A B")]
    kept = ngram_join.one_per_class(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = [(3, x), (5, y), (7, z + "more"), (None, x), (None, z), (None, w), (8, ""), (8, ""), (None, None), (9, "A B C D E F A B")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(expected, key=repr)


def test_frequent_tokens_in_few_texts_of_each_task(spark, monkeypatch):
    texts = [(f"a b c {i} {i + 1} x y z" if i % 2 else f"a b c w{i} v{i}",) for i in range(24)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(texts, 12), "text string")
    found = ngram_join.frequent_tokens(frame, 3)
    assert len(found) == 1
    # x y z is in twelve texts, one of each task, and a b c in two of each.
    monkeypatch.setattr(ngram_join, "FREQUENT_MOST", 0)
    assert len(ngram_join.frequent_tokens(frame, 3)) == 0
    assert len(ngram_join.frequent_tokens(frame.limit(0), 3)) == 0


def test_most_frequent_tokens_are_taken(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_MOST", 2)
    texts = [("a b c d",)] * 64 + [("e f g h i",)] * 16
    found = ngram_join.frequent_tokens(spark.createDataFrame(texts, "text string").coalesce(1), 3)
    assert len(found) == 2
