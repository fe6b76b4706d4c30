import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import decontaminate, grams, queries

SF = "/root/testdata/sf0.01"
FOLD = bytes(32 if grams.SPACE[c] else grams.LOWER[c] for c in range(256))


def distance(window, text):
    """Least edits between the window and any stretch of the text (whole table)."""
    row = np.zeros(len(text) + 1, dtype=int)
    for sign in window:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, other in enumerate(text, 1):
            new[j] = min(row[j - 1] + (other != sign), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def brute(text, index):
    body = (text or "").encode().translate(FOLD)
    return {index.items[i] for i, w, k in zip(index.window_item, index.windows, index.edits, strict=True) if distance(w, body) <= k}


def found_in(texts, index):
    finder, out = decontaminate.Finder(index), {}
    for first, data, offsets in grams.blocks(pa.array(texts, pa.string())):
        out |= {first + row: leaks for row, leaks in finder.block(data, offsets).items()}
    return out


def edited(text, edits, rng):
    signs = list(text)
    for _ in range(edits):
        at = rng.randrange(len(signs))
        kind = rng.randrange(3)
        if kind == 0:
            signs[at] = rng.choice("abcdefgh")
        elif kind == 1:
            signs.insert(at, rng.choice("xyz"))
        else:
            del signs[at]
    return "".join(signs)


def test_against_the_whole_alignment_table():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (6, 12, 25, 40)]
    index = decontaminate.index_of([(str(i), t) for i, t in enumerate(items)])
    texts = [None, "", "a"]
    for item in items:
        for share in (0.0, 0.03, 0.05, 0.07, 0.12):
            filler = [" ".join(word() for _ in range(12)) for _ in range(2)]
            texts.append(f"{filler[0]} {edited(item, int(share * len(item)), rng)}\n{filler[1]}")
    texts += [items[2][:90], items[3].upper(), items[1].replace(" ", "\t")]
    found = found_in(texts, index)
    for row, text in enumerate(texts):
        assert {x[0] for x in found.get(row, [])} == brute(text, index), row


def test_spans_of_exact_copies(spark):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_decontamination"](spark, SF).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    for row in rows:
        if row["edits"] == 0:
            part = docs[row["doc_id"]][row["start"] : row["start"] + row["length"]]
            assert part.translate(FOLD) in bench[row["item_id"]].encode().translate(FOLD)
    exact = {(d, i) for d, text in docs.items() for i, item in bench.items() if item.encode() in text}
    assert exact and exact <= found and len(found - exact) <= 0.05 * len(exact)


def test_long_texts_and_many_hits():
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix bold potions at dawn today"
    index = decontaminate.index_of([("1", item)])
    texts = ["the " * 30_000 + item, (item + " ") * 600, "zz " * 50_000]
    found = found_in(texts, index)
    assert set(found) == {0, 1} and found[0][0][:2] == ("1", 0) and found[0][0][2] >= 120_000


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_odd_tables_and_passes(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", max(size, 60))
    text = "an unusual sentence that serves as the benchmark passage of this very test"
    bench = spark.createDataFrame([(1, text), (2, None), (None, text), (3, ""), (4, text), (5, "short")], "item_id long, text string")
    schema = "doc_id long, text string, leaks int, item string, size int"
    rows = spark.createDataFrame([(1, f"x {text} y", 1, "i", 1), (1, f"x {text} y", 1, "i", 1), (None, None, None, None, None), (2, "", 0, "", 0)], schema)
    out = decontaminate.flag(rows, bench).collect()
    assert sorted(len(r["leaks"]) for r in out) == [0, 0, 2, 2]
    assert {x["item"] for r in out for x in r["leaks"]} == {"1", "4"}
    assert decontaminate.clean(rows, bench).count() == 2 and decontaminate.clean(rows, bench).columns == rows.columns
    assert decontaminate.flag(rows.limit(0), bench).collect() == []
    assert decontaminate.clean(rows, bench.limit(0)).count() == 4


def benchmark_items(spark):
    return [(str(r["item_id"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]


def share_found(items, change):
    index = decontaminate.index_of(items)
    made = [f"unlike words before. {change(text)} and unlike words behind" for _, text in items]
    found = found_in(made, index)
    return sum(any(x[0] == name for x in found.get(row, [])) for row, (name, _) in enumerate(items)) / len(items)


def replaced(text, every, rng):
    words = text.split(" ")
    chosen = [max(range(len(words)), key=lambda i: len(words[i]))] if not every else range(every // 2, len(words), every)
    for i in chosen:
        words[i] = "".join(rng.choice("bcdfgklmuvwxz") for _ in words[i])
    return " ".join(words)


def test_planted_changes(spark):
    # Plants are made from the items' words alone, without the operator's windows.
    items, rng = benchmark_items(spark), random.Random(6)
    assert share_found(items, lambda t: t.replace(" ", "  ")) == 1.0
    assert share_found(items, lambda t: t.replace(" ", " \n\t ")) == 1.0
    assert share_found(items, lambda t: replaced(t, 10, rng)) >= 0.95
    short = [x for x in items if len(x[1]) <= 130]
    assert share_found(short, lambda t: replaced(t, 0, rng)) >= 0.9
    assert share_found(items, lambda t: t.encode()[7:71].decode(errors="ignore")) == 1.0


def test_spans_in_respaced_text_and_short_items():
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix potions"
    text = f"é  x   {item.replace(' ', '  ')}  y cat"
    index = decontaminate.index_of([("1", item), ("2", "cat"), ("3", "c"), ("4", " "), ("5", "dogs")])
    found = {x[0]: x[1:] for x in found_in(["", text, "ca", "t"], index)[1]}
    raw = text.encode()
    assert set(found) == {"1", "2", "3"} and found["1"][0] == 0
    assert raw[found["1"][1] :][: found["1"][2]].decode() == item.replace(" ", "  ")
    assert raw[found["2"][1] :][: found["2"][2]] == b"cat"


def test_slabs_of_a_block_are_aligned_together(monkeypatch):
    # Each call of ``distances`` takes some 200 steps however few its pairs are, so slabs share them.
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    texts = [edited(" ".join(rng.choice(words) for _ in range(30)) + f" {items[i][1]}", 8, rng) for i in range(20)]
    index = decontaminate.index_of(items)
    whole = found_in(texts, index)
    calls, distances = [], decontaminate.distances
    monkeypatch.setattr(decontaminate, "distances", lambda *x: calls.append(1) or distances(*x))
    monkeypatch.setattr(decontaminate, "SLAB", 1 << 12)
    assert found_in(texts, index) == whole and len(whole) == 20
    assert len(calls) <= 2


def test_hashes_with_the_same_first_bits(monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 3)
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix bold potions at dawn today"
    found = found_in([f"well {item} so", "nothing of the kind", item[:60]], decontaminate.index_of([("1", item)]))
    assert set(found) == {0, 2} and found[0][0][1] == 0


def test_few_bands_of_texts_that_only_share_words(monkeypatch):
    """Q-grams farther apart than a window reaches do not count together, so few are sorted per window."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(60)]
    items = [(str(i), " ".join(r.choices(words, k=40))) for i in range(30)]
    text = " ".join(r.choices(words, k=20_000)).encode()
    keys, plain = [], decontaminate.distinct
    monkeypatch.setattr(decontaminate, "distinct", lambda values: (keys.append(len(values)), plain(values))[1])
    finder = decontaminate.Finder(decontaminate.index_of(items))
    assert not finder.block(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert sum(keys) < 20 * len(text)
