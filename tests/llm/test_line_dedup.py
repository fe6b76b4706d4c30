import random

import pytest

from tests.compare import connect, differences
from tidewatch.llm import line_dedup, queries


def words(line):
    for blank in "\t\x0b\f\r":
        line = line.replace(blank, " ")
    return frozenset(w for w in line.lower().split(" ") if w)


def brute(rows, percent):
    """(key, text) to the numbers of repeated lines; keys must be distinct."""
    seen, out = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for number, line in enumerate((text or "").split("\n")):
            own = words(line)
            if own and any(100 * len(own & w) >= percent * len(own | w) for w in seen):
                gone.append(number)
            if own:
                seen.append(own)
        out[key] = gone
    return out


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_against_brute_force(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.randrange(1, 25)) for _ in range(12)]
    rows = [(None, "W1 w2\n\nw2 w1"), (-5, None), (0, ""), (1, "\n \t\n"), (2, "x " * 9000 + "\nX")]
    for key in range(3, 60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((key, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.repeated_lines(frame, percent).collect()
    expected = brute(rows, percent)
    assert {(None if r["doc"] == -(2**63) else r["doc"]): r["gone"] for r in found} == expected
    assert sum(r["lines"] for r in found) == sum(len((t or "").split("\n")) for _, t in rows)


def test_query_against_sql(spark):
    name, folder = "op4_line_dedup", "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder).toPandas()
    assert differences(found, connect(folder).execute(queries.ORACLES[name]).fetchdf()) == []


def test_dedup_rewrites_texts(spark):
    schema = "doc_id long, text string, gone string, doc int, line int, unit int"
    rows = [
        (1, "one two three\nkeep this\none two three", "g", 1, 1, 1),
        (2, "One  Two three\nfresh words here", "g", 1, 1, 1),
        (3, "keep this", "g", 1, 1, 1),
        (4, None, None, None, None, None),
        (5, "", "", 0, 0, 0),
        (6, "same row", "g", 1, 1, 1),
        (6, "same row", "g", 1, 1, 1),
    ]
    out = line_dedup.dedup(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "gone", "doc", "line", "unit"]
    found = sorted((r["doc_id"], r["text"], r["gone"]) for r in out.collect() if r["text"] is not None)
    assert found == [(1, "one two three\nkeep this", "g"), (2, "fresh words here", "g"), (5, "", ""), (6, "same row", "g"), (6, "same row", "g")]
    assert out.count() == 6
    assert line_dedup.dedup(spark.createDataFrame([], schema)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a b c d e\na b c d f")], "doc_id long, text string")
    plan = line_dedup.repeated_lines(frame)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("percent", [67, 75, 80, 90])
def test_prefix_outlasts_every_allowed_difference(percent):
    for n in range(1, 150):
        allowed = [(lost, 100 * (n - lost) // percent - n) for lost in range(n + 1) if 100 * (n - lost) >= percent * n]
        assert line_dedup._prefix_words(n, percent) - 1 > max(2 * lost + added for lost, added in allowed)


def test_chance_neighbours_are_not_staged(spark, monkeypatch):
    """Lines of a small vocabulary share words with all others, but few are like another one."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.sample(vocabulary, 40)) for _ in range(800)]
    lines += [line.replace(" ", " again ", 1) for line in lines[:50]]
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(85)]
    counts, staged = {}, line_dedup.staged

    def watched(df, name):
        out = staged(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", watched)
    monkeypatch.setattr(line_dedup, "SLICED", 100, raising=False)
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc"]: r["gone"] for r in found} == brute(rows, 80)
    assert sum(len(r["gone"]) for r in found) == 50
    assert counts["units"] == 850 and counts["placed"] < 100 and counts["more"] < 100
