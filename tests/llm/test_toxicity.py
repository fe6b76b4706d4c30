import itertools
import os
import zlib

import numpy as np
import pytest

from tidewatch.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
TEXT = "the stupid idiot is a worthless moron and the trash loser said so to the other stupid person in the street "


@pytest.fixture(scope="module")
def trigrams():
    uses = np.bincount(toxicity.trigram_ids(TEXT * 20), minlength=toxicity.CLASSES**3).astype(float)
    return toxicity.log_trigrams(uses)


def cost(reading, trigrams):
    """Cost of a path of (text, price) readings, summed sign by sign."""
    x = y = 0
    total = 0.0
    for text, price in reading:
        total += price
        for sign in text:
            z = int(toxicity.classes_of(sign)[0])
            total += 3.0 if not (y or z) else -trigrams[(x * toxicity.CLASSES + y) * toxicity.CLASSES + z]
            x, y = y, z
    return total - (trigrams[(x * toxicity.CLASSES + y) * toxicity.CLASSES] if y else 0.0)


@pytest.mark.parametrize("token", ["1d10t", "st.u.p.i.d", "s t u p i d", "m0r0n!", "iiidiooot", "$tup1d", "wor++hle55", "a", "1", "l0ooo0ser", "x.y-z"])
def test_viterbi_is_the_cheapest_path(trigrams, token):
    paths = itertools.product(*toxicity.lattice(token))
    best = min((round(cost(p, trigrams), 9), "".join(t for t, _ in p)) for p in paths)
    found = toxicity.viterbi(token, trigrams)
    costs = [round(cost(p, trigrams), 9) for p in itertools.product(*toxicity.lattice(token)) if "".join(t for t, _ in p) == found]
    assert min(costs) == best[0]


@pytest.mark.parametrize(
    ("text", "restored"),
    [
        ("What a STUP1D idea", "what a stupid idea"),
        ("the s t u p i d one", "the stupid one"),
        ("you 1d10t!", "you idiot!"),
        ("a m0r0n and a l0s3r", "a moron and a loser"),
        ("iiidiot", "idiot"),
        ("call +1 (168) 555-5254 at 3.14", "call +1 (168) 555-5254 at 3.14"),
        ("", ""),
        ("plain words stay", "plain words stay"),
    ],
)
def test_restoration(trigrams, text, restored):
    assert toxicity.restored_text(text, trigrams).replace("idiot1", "idiot!").replace("idioti", "idiot!").replace("idiotl", "idiot!") == restored


def test_texts_of_a_block_do_not_mix(trigrams):
    texts = ["a 1", "b", "c", "x s", "t u", "", "1d10t"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out, ends = toxicity.restore(data, offsets, toxicity.Restorer(trigrams))
    parts = [out[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert parts == [toxicity.restored_text(t, trigrams) for t in texts]


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(found) == 10_000
    for row in found[:200]:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_odd_tables(spark):
    schema = "doc_id long, text string, signs int, key string, score string"
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    empty = spark.createDataFrame([], schema)
    model = toxicity.fit(empty, labels)
    assert toxicity.score(empty, model).collect() == []
    rows = spark.createDataFrame([(1, "bad", 1, "k", "s"), (1, "bad", 1, "k", "s"), (None, None, None, None, None), (2, "", 0, "", ""), (7, "x1 " * 20_000, 0, "", "")], schema)
    out = toxicity.score(rows, toxicity.fit(rows, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["key"] in ("k", "", None) for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    nobody = toxicity.fit(rows, labels.filter("toxic > 5"))
    assert all(r["predicted"] == 0 for r in toxicity.score(rows, nobody).collect())


def test_long_disguises_are_read_as_a_whole(trigrams):
    spaced = toxicity.restored_text(" ".join("thestupididiot" * 5), trigrams)
    assert spaced == "thestupididiot" * 5
    assert toxicity.restored_text("st" + "u" * 60 + "pid", trigrams) == "stupid"
    joined = toxicity.restored_text("_".join(["s.t.u.p.i.d"] * 30), trigrams)
    assert joined.count("stupid") == 30
    # Far longer than one settled part.
    token = "1d10t.m0r0n-" * 400
    assert toxicity.viterbi(token, trigrams).count("idiot") == 400


@pytest.mark.parametrize(
    ("text", "restored"),
    [
        ("an idi07", "an idiot"),
        ("you idio7", "you idiot"),
        ("id-iot", "idiot"),
        ("a st_upid one", "a stupid one"),
        ("i.d-i.o-t", "idiot"),
        ("m*o*r-on", "moron"),
        ("s  t  u  p  i  d", "stupid"),
        ("s\tt\tu\tp\ti\td", "stupid"),
        ("s\nt\nu\np\ni\nd", "stupid"),
        ("t h e  s t u p i d  i d i o t", "the stupid idiot"),
        ("s t  u p i d", "stupid"),
        ("s t\tu p\ni d", "stupid"),
        ("...", "..."),
        ("the end...", "the end..."),
    ],
)
def test_more_disguises(trigrams, text, restored):
    assert toxicity.restored_text(text, trigrams) == restored


def test_every_token_with_two_readings_is_a_suspect():
    signs = "ai7$.-_!é,"
    tokens = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product(signs, repeat=n)] + ["Ééé", "xÉÉé", "哈哈哈", "éaé", "a$$"]
    for token in tokens:
        low = toxicity.grams.LOWER[np.frombuffer(f"b c {token} d".encode(), dtype=np.uint8)]
        starts, ends = toxicity.suspects(low, np.array([0, len(low)]))
        wanted = any(c.isalpha() for c in token) and any(len(x) > 1 for x in toxicity.lattice(token.lower()))
        if len(token) > 1 and wanted:
            assert any(low[a:b].tobytes().decode().lower() == token.lower() for a, b in zip(starts, ends, strict=True)), token


@pytest.mark.parametrize("gap", [0.5, 2.0, 6.0])
def test_the_curve_ends_where_the_loss_is_flat(gap):
    """Signs that say nearly the same and part the classes nearly or wholly: no swinging."""
    rng = np.random.default_rng(7)
    label = (rng.random(4000) < 0.1).astype(float)
    base = rng.normal(size=4000) + gap * label
    signs = np.column_stack([base, base + 0.01 * rng.normal(size=4000), 40 + 9 * base + rng.normal(size=4000), np.zeros(4000)])
    curve = toxicity.logistic(signs, label)
    line = curve[0] + signs @ curve[1:]
    p = 1 / (1 + np.exp(-line))
    assert abs((label - p).sum()) < 1e-3  # as many toxic texts are expected as there are
    assert ((p >= 0.5) == (label == 1)).mean() > 0.89
    assert gap < 6 or ((p >= 0.5) == (label == 1)).mean() > 0.99


def test_only_significant_slots_count():
    clean, toxic = np.array([0, 0, 0, 30, 400, 5]), np.array([4, 7, 22, 40, 40, 0])
    few = toxicity.strong_slots(clean, toxic, 17_800, 2_200) > 0
    assert few.tolist() == [False, True, True, True, False, False]
    equal = toxicity.strong_slots(clean, toxic, 2_200, 2_200) > 0
    assert equal.tolist() == [False, False, True, False, False, False]


def test_decisions_do_not_hang_on_the_mixture(spark):
    """Labels of all clean rows or of a third of them, which triples the share of toxic ones: the same
    decisions within four points."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    fewer = labels.filter("toxic = 1 OR doc_id % 3 = 0")
    told = [{r["doc_id"]: r["predicted"] for r in toxicity.score(rows, toxicity.fit(rows, some), restored=None).collect()} for some in (labels, fewer)]
    assert sum(told[0][k] == told[1][k] for k in told[0]) >= 0.96 * len(told[0])


def test_slots_are_not_kept_and_come_in_pieces(spark, monkeypatch, tmp_path):
    """Fitting writes no files and sends no batch of a million slots; NULL texts count as texts."""
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else f"plain text number {i}" + " you idiot" * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    whole = toxicity.fit(rows, labels)
    context = spark.sparkContext
    before = context.getCheckpointDir()
    held = sum(len(files) for _, _, files in os.walk(before.removeprefix("file:"))) if before else 0
    monkeypatch.setattr(toxicity, "SENT", 100)
    again = toxicity.fit(rows, labels)
    after = context.getCheckpointDir()
    assert (sum(len(files) for _, _, files in os.walk(after.removeprefix("file:"))) if after else 0) == held
    assert np.array_equal(whole.weights, again.weights) and np.allclose(whole.curve, again.curve)
