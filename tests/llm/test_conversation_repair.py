import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tidewatch.llm import conversation_repair, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        if not signs:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(initials, marks):
    """Cost and least audit by a walk over what may come next; no table of targets."""
    n = len(initials)

    @cache
    def best(i, state, inserts):
        # States: n nothing yet, s after the system turn, u and a the role that comes next.
        ways = [(0, "")] if i == n and state in "nu" else []
        due = "a" if state == "a" else "u"
        then = {"u": "a", "a": "u"}
        if inserts < 3:
            cost, audit = best(i, then[due], inserts + 1)
            ways.append((cost + 3, "I" + audit))
        if i < n:
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            if marks[i] not in ("blank", "duplicate"):
                short = 3 if marks[i] == "truncated" else 0
                if initials[i] == due:
                    cost, audit = best(i + 1, then[due], 0)
                    ways.append((cost + short, "K" + audit))
                if initials[i] == "s" and state == "n":
                    cost, audit = best(i + 1, "s", 0)
                    ways.append((cost + short, "K" + audit))
                cost, audit = best(i + 1, then[due], 0)
                ways.append((cost + short + 3, "R" + audit))
        return min(ways, default=(10**6, "~"))

    return best(0, "n", 0)


def repaired(audit, rows):
    out, i = [], 0
    for edit in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((due, ""))
            continue
        if edit != "D":
            out.append((rows[i][1] if edit == "K" else due, rows[i][2]))
        i += 1
    return out


def expected(key, rows):
    """The row of a conversation whose rows (turn, role, text) are in order."""
    marks = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(tuple(initials), tuple(marks)) if rows else (0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in repaired(audit, rows))
    counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
    return (key, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    """Rows (turn, role, text): NULL turns first, NULL cells as a space."""
    cells = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(cells, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def some_code(rng, n):
    return bytes(rng.choice((0, 1, 0, 1, 0, 1, 2, 3, 4, 5, 8, 9, 10, 11)) for _ in range(n))


def told(code):
    initials = tuple("uasx"[c & 3] for c in code)
    return initials, tuple("blank" if c & 4 else "truncated" if c & 8 else None for c in code)


def test_alignment_against_a_walk():
    rng = random.Random(1)
    for _ in range(1500):
        code = some_code(rng, rng.randrange(0, 13))
        assert conversation_repair.align(code) == cheapest(*told(code)), code
    alternating = bytes(c for _ in range(40) for c in (0, 1) if rng.random() < 0.9)
    assert conversation_repair.align(b"\x02" + alternating) == cheapest(*told(b"\x02" + alternating))


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_pieces_chain_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(300):
        code = some_code(rng, rng.randrange(1, 12))
        cuts = [code[i : i + size] for i in range(0, len(code), size)]
        best = {s: (3 * len(c), c) for s, c in conversation_repair.CLOSING.items()}
        for part in reversed(cuts):
            costs, audits = conversation_repair.piece_options(part)
            best = {
                s: min((costs[o] + best[t][0], audits[o] + best[t][1]) for o, t in ways if audits[o] is not None)
                for s, ways in conversation_repair.STEPS.items()
            }
        assert best[0] == cheapest(*told(code)), code


def conversations(rng):
    rows = []
    for key in [*range(60), None]:
        for turn in range(rng.choice((1, 2, 3, 8, 8, 20))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(("yes.", "no", "", " \t", None, f"t{rng.randrange(9)}!", "\u00e9? \n", "a.b"))
            for _ in range(rng.choice((0, 1, 1, 1, 1, 2))):
                rows.append((key, rng.choice((turn, turn, turn, None)), role, text, "x", 1))
    rows += [(99, i, ("user", "assistant")[i * 7 % 3 % 2], f"word {i % 61}" + ".!x"[i % 3], "x", 1) for i in range(150)]
    return rows


@pytest.mark.parametrize(("piece", "partitions"), [(1024, "4"), (3, "7"), (16, "1")])
def test_against_brute_force(spark, piece, partitions):
    rng = random.Random(piece)
    rows = conversations(rng)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, part int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        audits, turns = conversation_repair.repair(frame, piece=piece)
        found = audits.collect()
        made = turns.orderBy("conv_id", "position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert audits.columns == COLUMNS
    groups = {}
    for key, *row, _, _ in rows:
        groups.setdefault(key, []).append(tuple(row))
    wanted = {key: expected(key, in_order(group)) for key, group in groups.items()}
    assert sorted(map(tuple, found), key=repr) == sorted(wanted.values(), key=repr)
    for key, group in groups.items():
        assert [(r["role"], r["text"]) for r in made if r["conv_id"] == key] == repaired(wanted[key][7], in_order(group))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    audits, turns = conversation_repair.repair(empty)
    assert audits.collect() == [] and turns.collect() == []


def damaged(key, turn, role, text):
    cell = lambda c: " " if c is None else c
    act = zlib.crc32(f"{cell(key)}:{cell(turn)}".encode()) % 20
    if act == 0:
        return []
    text = "" if act == 1 else re.sub("[.!?]", "", cell(text)) if act == 2 else cell(text)
    return [(turn, "user" if act == 4 else cell(role), text)] * (2 if act == 3 else 1)


def expected_table(rows):
    groups = {}
    for key, turn, role, text in rows:
        groups.setdefault(key, []).extend(damaged(key, turn, role, text))
    return sorted((expected(key, in_order(group)) for key, group in groups.items()), key=repr)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op12_conversation_repair"](spark, SF)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == expected_table(rows)


def test_query_of_nulls_and_dropped_conversations(spark, tmp_path):
    rows = [(None, 3, "user", "a."), (None, None, None, None), (4, None, "user", "b"), (4, None, "user", None)]
    rows += [(k, 0, "user", "only.") for k in range(100, 160)]
    rows += [(k, t, r, x) for k in range(160, 180) for t, r, x in ((0, "system", "s."), (2, "user", "q?"), (2, "user", "q?"), (3, "assistant", "\u00e9"))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert any(r["audit"] == "" and r["cost"] == 0 for r in found)
    assert sorted(map(tuple, found), key=repr) == expected_table(rows)
