import random

import numpy as np
import pytest

from tests.llm.test_ngram_join import brute, corpus
from tidewatch.llm import queries, superminhash


def with_kept(rows):
    return sorted(((*r, r[0] == r[2]) for r in rows), key=repr)


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_against_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, n int")
    found = superminhash.classes(frame, k, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == with_kept(brute(rows, k, percent))


def cluster(seed, size):
    """Copies of one text with up to 14 changed words, so that only some of them link."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(150)], []
    for key in range(size):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((key, " ".join(text)))
        if rng.random() < 0.3:  # a copy of a copy, often far from the base
            text[rng.randrange(150)] = "once"
            rows.append((1000 + key, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_a_large_cluster_loses_no_link(spark, monkeypatch, seed):
    rows = cluster(seed, 500)
    pairs = []
    kept = superminhash._beside
    monkeypatch.setattr(superminhash, "_beside", lambda *a: pairs.append(kept(*a)) or pairs[-1])
    found = superminhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    expected = with_kept(brute(rows, 3, 85))
    assert 20 < sum(r[3] for r in expected) < len(rows) - 20
    assert sorted((tuple(r) for r in found), key=repr) == expected
    assert pairs[0].count() < 3 * len(rows)  # of some 200,000 pairs


def plain_signature(tokens, places):
    """The same draws, one element and one step at a time, without stopping early."""
    u, mask = np.uint64, (1 << 64) - 1
    mix = lambda x: int(superminhash.grams.mix(np.array([x & mask], dtype=u))[0])
    out = [mask] * places
    for token in map(int, tokens):
        order = list(range(places))
        for step in range(places):
            draw = mix(token + (step + 1) * 0x9E3779B97F4A7C15)
            other = step + ((mix(draw) >> 40) * (places - step) >> 24)
            order[step], order[other] = order[other], order[step]
            out[order[step]] = min(out[order[step]], step << 56 | draw >> 8)
    return out


@pytest.mark.parametrize("elements", [3, 1 << 17])
def test_signatures_against_plain_loops(monkeypatch, elements):
    monkeypatch.setattr(superminhash, "ELEMENTS", elements)
    rng = np.random.default_rng(elements)
    counts = np.array([1, 2, 0, 7, 30, 90, 1])
    tokens = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    found = superminhash.signatures(tokens, counts, places=24)
    parts = np.split(tokens, np.cumsum(counts)[:-1])
    assert [row.tolist() for row in found] == [plain_signature(p, 24) for p in parts]


def test_signatures_estimate_similarity_with_less_variance():
    """Small sets: the share of equal places is unbiased and closer to the truth than independent draws."""
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(400):
        shared = rng.integers(0, 1 << 64, 16, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 64, 4, dtype=np.uint64)]) for _ in range(2))
        x, y = superminhash.signatures(np.concatenate([a, b]), np.array([20, 20]))
        errors.append((x == y).mean() - 16 / 24)
    independent = (16 / 24) * (8 / 24) / superminhash.PLACES
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * independent


def test_bands_for_a_threshold():
    assert [superminhash.band_places(p) for p in (50, 80, 85, 95)] == [2, 4, 6, 8]


def test_empty_and_null_keys(spark):
    x, z = ("".join(f"{c}{i} " for i in range(40)) for c in "xz")
    rows = [(3, x), (3, x), (None, x), (5, x + "more"), (None, z), (None, z), (None, None), (8, ""), (8, " \n"), (None, "a"), (9, "A"), (7, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in superminhash.classes(frame, 3, 85).collect()), key=repr)
    expected = [(3, 38, 3, True)] * 2 + [(None, 38, 3, False), (5, 39, 3, False)] + [(None, 38, None, True)] * 2
    expected += [(None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True), (None, 1, 7, False), (9, 1, 7, False), (7, 1, 7, True)]
    assert found == sorted(expected, key=repr)
    assert superminhash.classes(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        superminhash.classes(frame, 0)


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.QUERIES["op13_superminhash"](spark, folder).collect()
    assert sorted((tuple(r) for r in found), key=repr) == with_kept(brute(rows, 3, 85))
