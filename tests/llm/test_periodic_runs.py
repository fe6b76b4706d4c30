import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    """Every run, by all periods from the smallest on."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_text(rng):
    words, kinds = [], rng.choice((1, 2, 3, 5, 50))
    for _ in range(rng.randrange(0, 8)):
        if rng.random() < 0.5:
            words += [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
        else:
            period = [rng.randrange(kinds) for _ in range(rng.choice((1, 2, 3, 4, 7, 13, 16, 17, 20, 31, 64)))]
            words += (period * rng.randrange(1, 9))[: rng.choice((None, -1, -2))] * rng.choice((1, 1, 2, 3))
    return words


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("tried", [7, 1 << 16])
def test_runs_against_brute_force(monkeypatch, seed, tried):
    monkeypatch.setattr(periodic_runs, "TRIED", tried)
    rng = random.Random(seed)
    texts = [periodic_text(rng) for _ in range(25)] + [[], [1], [4] * 5, [4] * 6, [4] * 1200, fibonacci(400)]
    texts.append([bin(i).count("1") % 2 for i in range(600)])
    words = np.array([w for t in texts for w in t], dtype=np.int64)
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    expected, at = [], 0
    for t in texts:
        expected += [(s + at, s + at + length, q) for s, length, q in brute(t)]
        at += len(t)
    assert list(zip(*(v.tolist() for v in periodic_runs.runs_of(words, counts)), strict=True)) == expected


def test_without_hashes(monkeypatch):
    """Where stretches of one hash differ, words are compared instead."""
    monkeypatch.setattr(periodic_runs, "_exact", lambda words, start, end, q: np.zeros(1, dtype=bool))
    rng = random.Random(5)
    for _ in range(20):
        text = periodic_text(rng)[:200]
        found = periodic_runs.runs_of(np.array(text, dtype=np.int64), np.array([len(text)]))
        assert [(s, e - s, q) for s, e, q in zip(*(v.tolist() for v in found), strict=True)] == brute(text)


def test_the_grammar():
    rng = random.Random(3)
    for _ in range(30):
        text = np.array(periodic_text(rng), dtype=np.int64)
        made = periodic_runs.Grammar(text, np.zeros(len(text), dtype=np.int64))
        uses = np.bincount(made.rule, minlength=len(made.low))
        assert (uses >= 2).all()
        for rule, place in zip(made.rule, made.place, strict=True):
            size = made.high[rule] - made.low[rule]
            assert (text[place : place + size] == text[made.low[rule] : made.high[rule]]).all()
        assert set(made.tops) <= set(range(len(text))) and (not len(text) or made.tops[0] == 0)
    for period in (1, 3, 10):  # a periodic text takes few symbols
        text = np.tile(np.arange(period), 4096 // period)
        made = periodic_runs.Grammar(text, np.zeros(len(text), dtype=np.int64))
        assert len(made.low) <= period + 12 and len(made.tops) <= 12


def test_texts_keys_and_columns(spark):
    long = "".join(f"w{i % 9000} " for i in range(40_000)) + "x\u00e9 " * 30_000
    texts = [None, "", " \n\t", "one", "a b " * 9, "A a A a A a A a", "\u00e9\x0b\u00e9\x0c\u00e9 \u00e9\r\u00e9\t\u00e9", long, "a b " * 9]
    rows = [(i if i % 3 else None, t, "r", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    out = periodic_runs.collapse(frame)
    assert out.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    found = {r["start"]: r for r in out.collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = split(text)
        expected = [(0, 40_000, 9000), (40_000, 30_000, 1)] if text == long else brute(words)
        assert [tuple(r) for r in found[i]["runs"]] == expected, i
        assert found[i]["collapsed"] == collapsed(words, expected), i
    assert periodic_runs.collapse(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.collapse(frame, text="runs")


def expected_row(key, text):
    words = split(text)
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *row, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = queries.QUERIES["op11_periodic_runs"](spark, SF)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted(expected_row(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 12_000)
    short = {e[0] for e in expected}
    assert sum(e[1] > 0 for e in expected) > 5
    assert sorted(tuple(r) for r in found.collect() if r["doc_id"] in short) == expected


def test_query_of_null_and_empty_texts(spark, tmp_path):
    keys = [10, 3, 5, None, 7, 7] + [k for k in range(200, 400) if zlib.crc32(str(k).encode()) % 10 == 0]
    texts = [None, "", " ", "a b c", "x", "x"] + [None, " \n", "\u00e9", "a b"] + ["p q r s t u v w " * 4] * len(keys)
    rows = [(k, t, "s") for k, t in zip(keys, texts, strict=False)]
    spark.createDataFrame(rows, "doc_id long, text string, n string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((expected_row(k, t) for k, t, _ in rows), key=repr)
