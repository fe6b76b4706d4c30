"""Repair of conversations by aligning their turns to an alternating target.

A repaired conversation has the role initials ``(s?(ua)+)?``. Turns are aligned to the targets of all
feasible lengths by Wagner and Fischer's table. Read from their ends, all targets are beginnings of one
string (… u a u a), so one table holds a column for each length; a leading system turn is put before
it. Only the diagonals are filled on which an alignment can still cost no more than the incumbent, the
cost of a first repair (Ukkonen). Each length of least cost is traced back to its least audit, and the
least of those is the result.

Turns are range-partitioned by conversation and order, so a conversation of any size is spread over
many tasks. A conversation that ends inside a task is repaired there. One that reaches the edge of a
partition, or is longer than PIECE, is handled as pieces: each piece is aligned for every state (what
role comes next) it may begin and end in, the pieces' costs are chained from the last to the first,
and every piece takes the audit that the chain chose. An audit puts insertions before a turn, or at the
very end, so no piece's audit begins another one of the same piece and the least audits of the pieces
give the least audit of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import staged
from tidewatch.session import cut_lineage

#: Fixed costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that one table aligns at most.
PIECE = 1024
#: Conversations that are handed on together.
BATCH = 512
BLANKS = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")

#: A turn as an integer: its initial (0 u, 1 a, 2 s, 3 other), 4 if it must go, 8 if it is truncated.
MUST, SHORT = 4, 8
INITIALS = {"u": 0, "a": 1, "s": 2}
FAR = np.int32(1 << 29)

#: What may be next: 0 anything (nothing was put out), 1 u after s, 2 u after a, 3 a.
#: Options of a piece: which state they lead from and to.
OPTIONS = ("none", "U2", "U3", "A2", "A3", "S1", "S2", "S3")
STEPS = {
    0: ((0, 0), (1, 2), (2, 3), (5, 1), (6, 2), (7, 3)),
    1: ((0, 1), (1, 2), (2, 3)),
    2: ((0, 2), (1, 2), (2, 3)),
    3: ((0, 3), (3, 2), (4, 3)),
}
#: Insertions that end a conversation in each state.
CLOSING = {0: "", 1: "II", 2: "", 3: "I"}


def _fit(code: int, role: int) -> int:
    """Cost of a turn in the place of ``role`` (0 u, 1 a)."""
    if code & MUST:
        return int(FAR)
    return (0 if code & 3 == role else REROLE) + (TRUNCATED if code & SHORT else 0)


def _incumbent(codes: bytes) -> int:
    """No stretch up to the end of ``codes`` needs more than this to be repaired, whatever comes next."""
    user = assistant = most = 0
    for code in reversed(codes):
        u, a = _fit(code, 0), _fit(code, 1)
        go_u = min(DELETE + user, u + assistant, INSERT + a + user)
        go_a = min(DELETE + assistant, a + user, INSERT + u + assistant)
        user, assistant = min(go_u, INSERT + go_a), min(go_a, INSERT + go_u)
        most = max(most, user, assistant)
    # Ending in a given state takes an insertion and a new role more, ending with the target closed two.
    return most + 4 * INSERT


class Table:
    """Least costs of aligning the turns from ``i`` on to the last ``r`` roles of the target.

    ``last`` is the target's last role. With ``closing``, roles may be inserted behind all turns.
    """

    def __init__(self, codes: bytes, last: int, closing: bool, incumbent: int):
        n = len(codes)
        self.codes, self.last, self.closing = codes, last, closing
        self.low = incumbent // DELETE
        self.width = self.low + incumbent // INSERT + 1
        self.cells = np.full((n + 1, self.width + 1), FAR, dtype=np.int32)
        step = np.arange(self.width, dtype=np.int32) * INSERT
        column = np.arange(self.width)
        first = max(0, self.low)
        if closing:
            self.cells[n, first : self.width] = step[: self.width - first]
        else:
            self.cells[n, first] = 0
        for i in range(n - 1, -1, -1):
            r = column + (n - i - self.low)
            odd = (r & 1).astype(bool)
            under = self.cells[i + 1]
            fit = np.where(odd, np.int32(_fit(codes[i], last)), np.int32(_fit(codes[i], 1 - last)))
            best = np.minimum(under[1:] + DELETE, np.where(r > 0, under[:-1] + fit, FAR))
            best[r < 0] = FAR
            best = np.minimum.accumulate(best - step) + step
            best[r < 0] = FAR
            self.cells[i, : self.width] = np.minimum(best, FAR)

    def role(self, r: int) -> int:
        return self.last if r & 1 else 1 - self.last

    def at(self, i: int, r: int) -> int:
        place = r - (len(self.codes) - i) + self.low
        return int(self.cells[i, place]) if r >= 0 and 0 <= place < self.width else int(FAR)

    def lengths(self, i: int, role: int, least: int) -> tuple[int, list[int]]:
        """The least cost from turn ``i`` on over all targets of ``least`` or more roles that begin with
        ``role``, and their lengths."""
        start = len(self.codes) - i - self.low
        r = np.arange(self.width) + start
        fits = (r >= least) & (np.where(r & 1, self.last, 1 - self.last) == role)
        costs = np.where(fits, self.cells[i, : self.width], FAR)
        best = int(costs.min()) if len(costs) else int(FAR)
        return best, (r[costs == best].tolist() if best < FAR else [])

    def trace(self, i: int, r: int) -> str:
        """The least audit of the cheapest alignments from ``i``, ``r`` on."""
        out, n = [], len(self.codes)
        while i < n or r > 0:
            here = self.at(i, r)
            if i < n and self.at(i + 1, r) + DELETE == here:
                out.append("D")
                i += 1
            elif r > 0 and (i < n or self.closing) and self.at(i, r - 1) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.codes[i] & 3 == self.role(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _after_system(table: Table, least: int) -> tuple[int, str | None]:
    """The cheapest way to keep a system turn, delete those before it and align the rest."""
    best, chosen = int(FAR), None
    for i, code in enumerate(table.codes):
        if code & 3 == 2 and not code & MUST:
            cost, lengths = table.lengths(i + 1, 0, least)
            cost += DELETE * i + (TRUNCATED if code & SHORT else 0)
            if lengths and cost <= best:  # of equal ones the last: deletions come first
                best, chosen = cost, (i, lengths)
    if chosen is None:
        return int(FAR), None
    i, lengths = chosen
    return best, "D" * i + "K" + min(table.trace(i + 1, r) for r in lengths)


@lru_cache(maxsize=1 << 14)
def align(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    table = Table(codes, 1, True, _incumbent(codes))
    cost, lengths = table.lengths(0, 0, 2)
    empty = table.at(0, 0)
    found = [(cost, table.trace(0, r)) for r in lengths] + [_after_system(table, 2)]
    if empty < FAR:
        found.append((empty, table.trace(0, 0)))
    least = min(c for c, _ in found)
    return least, min(a for c, a in found if c == least)


def piece_options(codes: bytes) -> tuple[list[int], list[str | None]]:
    """Cost and audit of each of OPTIONS for a piece that other pieces may follow."""
    n, incumbent = len(codes), _incumbent(codes)
    options: dict[str, tuple[int, str | None]] = {"none": (DELETE * n, "D" * n), "S1": (int(FAR), None)}
    for state, last in ((2, 1), (3, 0)):
        table = Table(codes, last, False, incumbent)
        for name, role in (("U", 0), ("A", 1)):
            cost, lengths = table.lengths(0, role, 1)
            options[f"{name}{state}"] = (cost, min((table.trace(0, r) for r in lengths), default=None))
        options[f"S{state}"] = _after_system(table, 1)
    for i, code in enumerate(codes):
        cost = DELETE * (n - 1) + (TRUNCATED if code & SHORT else 0)
        if code & 3 == 2 and not code & MUST and cost <= options["S1"][0]:
            options["S1"] = (cost, "D" * i + "K" + "D" * (n - 1 - i))
    return [options[o][0] for o in OPTIONS], [options[o][1] for o in OPTIONS]


def apply(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], list[str]]:
    """The roles and texts that an audit makes of turns, from a state on."""
    out_roles, out_texts, i = [], [], 0
    due = 1 if state == 3 else 0
    for edit in audit:
        if edit == "I":
            out_roles.append(ROLES[due])
            out_texts.append("")
            due = 1 - due
            continue
        if edit != "D":
            out_roles.append(ROLES[due] if edit == "R" else roles[i])
            out_texts.append(texts[i])
            due = 0 if edit == "K" and roles[i].startswith("s") else 1 - due
        i += 1
    return out_roles, out_texts


def _lines(roles: list[str], texts: list[str]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))


class _Segment:
    """Turns of one conversation that lie in one partition, in order."""

    def __init__(self, conv):
        self.conv, self.pieces = conv, 0
        self.clear()

    def clear(self) -> None:
        self.codes, self.roles, self.texts, self.turns = bytearray(), [], [], []
        self.counts = [0, 0, 0]

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if fault:
            self.counts[fault - 1] += 1
        code = INITIALS.get(role[:1], 3)
        self.codes.append(code | (MUST if fault in (1, 2) else SHORT if fault == 3 else 0))
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)

    def row(self, part: int, whole: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        numbered = [t for t in self.turns if t is not None]
        out = {
            "conv": self.conv,
            "part": part,
            "piece": self.pieces,
            "whole": whole,
            "counts": [*self.counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))],
            "ends": [initials[0], initials[-1]] if initials else None,
            "turns": [min(numbered), max(numbered), len(set(numbered))] if numbered else None,
        }
        if whole:
            cost, audit = align(bytes(self.codes))
            roles, texts = apply(audit, self.roles, self.texts)
            return out | {"costs": [cost], "audits": [audit], "roles": roles, "texts": texts, "sha": _sha(_lines(roles, texts))}
        costs, audits = piece_options(bytes(self.codes))
        return out | {"costs": costs, "audits": audits, "roles": self.roles, "texts": self.texts}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(frame: DataFrame) -> T.StructType:
    strings, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    conv = frame.schema["conv"].dataType
    schema = T.StructType().add("conv", conv).add("part", "long").add("piece", "long").add("whole", "boolean")
    schema = schema.add("counts", longs).add("ends", strings).add("turns", longs).add("costs", longs)
    return schema.add("audits", strings).add("roles", strings).add("texts", strings).add("sha", "string")


def _aligned(piece: int):
    """A function for sorted partitions: a row for each conversation that ends inside, and for pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: _Segment | None = None
        first, previous, out, conv_type = True, None, [], None

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            text, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            kinds = {"conv": conv_type, "part": pa.int64(), "piece": pa.int64(), "whole": pa.bool_(), "counts": longs, "ends": text}
            kinds |= {"turns": longs, "costs": longs, "audits": text, "roles": text, "texts": text, "sha": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, turn, role, text, blank, repeated, short = row
                if held is None or conv != held.conv:
                    if held is not None:
                        # The first conversation of a partition may have begun in the one before.
                        out.append(held.row(part, not first and not held.pieces))
                        first = False
                    held, previous = _Segment(conv), None
                elif len(held.codes) >= piece:
                    out.append(held.row(part, False))
                    held.pieces += 1
                    held.clear()
                # Of equal rows at the turn where they first occur, all but one are duplicates.
                same = previous == (turn, role, text)
                fault = 1 if blank else 2 if repeated == "later" or (repeated == "first" and same) else 3 if short else 0
                held.add(turn, role, text, fault)
                previous = (turn, role, text)
                if len(out) >= BATCH:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out.append(held.row(part, False))
        if out:
            yield batch_of(out)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The option and the state of each piece, from pieces sorted from the last to the first."""

    def chosen(conv, steps: list) -> Iterator[dict]:
        state = 0
        for part, piece, choice in reversed(steps):
            option, then = choice[state]
            yield {"conv": conv, "part": part, "piece": piece, "option": option, "state": state, "after": then}
            state = then

    conv_type, held, steps, best, out = None, None, [], None, []

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        names = ("part", "piece", "option", "state", "after")
        columns = [pa.array([r["conv"] for r in rows], conv_type), *[pa.array([r[n] for r in rows], pa.int64()) for n in names]]
        return pa.RecordBatch.from_arrays(columns, names=["conv", *names])

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for conv, part, piece, costs, audits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not steps or conv != held:
                out.extend(chosen(held, steps))
                held, steps = conv, []
                best = {s: INSERT * len(CLOSING[s]) for s in STEPS}
            after, best, choice = best, {}, {}
            for state, ways in STEPS.items():
                cost, _, option, then = min((costs[o] + after[t], audits[o] or "", o, t) for o, t in ways if audits[o] is not None)
                best[state], choice[state] = cost, (option, then)
            steps.append((part, piece, choice))
        if len(out) >= BATCH:
            yield batch_of(out)
            out = []
    out.extend(chosen(held, steps))
    if out:
        yield batch_of(out)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired turns of each piece; the last of a conversation is closed."""
    for batch in batches:
        rows = batch.to_pylist()
        cost, audit, roles, texts = [], [], [], []
        for row in rows:
            closing = CLOSING[row["after"]] if row["closes"] else ""
            audit.append(row["audits"][row["option"]] + closing)
            cost.append(row["costs"][row["option"]] + INSERT * len(closing))
            made = apply(audit[-1], row["roles"], row["texts"], row["state"])
            roles.append(made[0])
            texts.append(made[1])
        strings = pa.list_(pa.string())
        named = {n: batch.column(n) for n in ("conv", "part", "piece", "counts", "ends", "turns")}
        named |= {"cost": pa.array(cost, pa.int64()), "audit": pa.array(audit, pa.string())}
        named |= {"roles": pa.array(roles, strings), "texts": pa.array(texts, strings)}
        yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its repaired pieces in order, its hash taken on the way."""
    held, conv_type = None, None
    names = ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "cost")

    def batch_of(row: dict) -> pa.RecordBatch:
        columns = [pa.array([row["conv"]], conv_type), *[pa.array([row[n]], pa.int64()) for n in names]]
        columns += [pa.array(["".join(row["audit"])], pa.string()), pa.array([row["sha"].hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv", *names, "audit", "sha"])

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for r in batch.to_pylist():
            if held is None or held["conv"] != r["conv"]:
                if held is not None:
                    yield batch_of(held)
                held = dict.fromkeys(names, 0) | {"conv": r["conv"], "audit": [], "sha": hashlib.sha256(), "ends": None, "any": False}
                held |= {"low": None, "high": None}
            for name, count in zip(("blank", "duplicate", "truncated", "illegal"), r["counts"], strict=True):
                held[name] += count
            if r["ends"]:
                held["illegal"] += held["ends"] is not None and held["ends"] + r["ends"][0] not in ("su", "ua", "au")
                held["ends"] = r["ends"][1]
            if r["turns"]:
                low, high, distinct = r["turns"]
                held["distinct"] += distinct - (held["high"] == low)
                held["low"] = low if held["low"] is None else held["low"]
                held["high"] = high
            held["cost"] += r["cost"]
            held["audit"].append(r["audit"])
            if r["roles"]:
                held["sha"].update((("\n" if held["any"] else "") + _lines(r["roles"], r["texts"])).encode())
                held["any"] = True
    if held is not None:
        yield batch_of(held)


def _marked(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text`` with ``blank``, ``short`` and whether a row repeats an earlier one.

    Rows are told to be equal by 128 bits of hashes of role and text. Only those that occur more than
    once in a conversation are joined back.
    """
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), cell(role).alias("role"), cell(text).alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    known = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.select("conv", "turn", *known).groupBy("conv", "h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("uses"))
    first = first.filter("uses > 1").select(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    met: Column = F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    joined = rows.select("*", *known).join(first, met, "left")
    repeated = F.when(F.col("first").isNull(), "no").when(F.col("first") == order, "first").otherwise("later")
    return joined.select(
        "conv", "turn", "role", "text", (end == "").alias("blank"), repeated.alias("repeated"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("short")
    )


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE
) -> tuple[DataFrame, DataFrame]:
    """``(audits, repaired)``: one row per conversation, and one per repaired turn.

    ``audits`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``; ``repaired`` has ``conv_id, position, role, text`` with positions that grow
    along a conversation. Turns are taken by number, NULL ones first, equal numbers by role and text;
    NULL roles and texts count as one space; rows of NULL ``conv_id`` are one conversation. The first
    fault of a row counts: blank, duplicate (its role and text occurred before), truncated (it does not
    end in ``.!?``). Keeping costs 0, a new role 3, deleting 4 (a must for blank and duplicate rows),
    inserting an empty turn 3, a truncated turn that stays 3 more. ``audit`` holds the initials of the
    cheapest edits, the least of several. Repeated rows are duplicates, other columns are ignored, an
    empty table gives empty tables. Turn numbers must be whole.
    """
    marked = staged(_marked(turns, conv, turn, role, text), "turns")
    ordered = marked.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    aligned = staged(ordered.mapInArrow(_aligned(piece), _rows(marked)), "aligned")
    conv_type = marked.schema["conv"].dataType

    whole = aligned.filter("whole").select(
        "conv",
        *[F.col("turns")[i].alias(n) for i, n in enumerate(("low", "high", "distinct"))],
        *[F.col("counts")[i].alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))],
        F.col("costs")[0].alias("cost"),
        F.col("audits")[0].alias("audit"),
        "sha",
    )
    parts = aligned.filter("NOT whole")
    steps = T.StructType().add("conv", conv_type)
    for name in ("part", "piece", "option", "state", "after"):
        steps = steps.add(name, "long")
    backwards = parts.select("conv", "part", "piece", "costs", "audits").repartition("conv")
    chain = cut_lineage(backwards.sortWithinPartitions("conv", F.desc("part"), F.desc("piece")).mapInArrow(_chain, steps))
    ends = chain.groupBy("conv").agg(F.max(F.struct("part", "piece")).alias("end"))
    chain = chain.alias("s").join(ends.alias("e"), F.expr("s.conv <=> e.conv"))
    chain = chain.selectExpr("s.*", "end = struct(part, piece) AS closes").alias("c")
    met = F.expr("c.conv <=> p.conv AND c.part = p.part AND c.piece = p.piece")
    chosen = parts.alias("p").join(chain, met).select("p.*", "c.option", "c.state", "c.after", "c.closes")
    pieces = T.StructType([f for f in aligned.schema.fields if f.name in ("conv", "part", "piece", "counts", "ends", "turns")])
    pieces = pieces.add("cost", "long").add("audit", "string")
    pieces = pieces.add("roles", T.ArrayType(T.StringType())).add("texts", T.ArrayType(T.StringType()))
    made = staged(chosen.mapInArrow(_applied, pieces), "repaired")
    result = T.StructType([f for f in whole.schema.fields])
    forwards = made.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    audits = whole.unionByName(forwards.mapInArrow(_joined, result)).select(
        F.col("conv").alias("conv_id"),
        F.coalesce(F.expr("high - low + 1 - distinct"), F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        F.col("sha").alias("repaired_sha256"),
    )
    both = aligned.filter("whole").select("conv", "part", "piece", "roles", "texts").unionByName(made.select("conv", "part", "piece", "roles", "texts"))
    rows = both.select("conv", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    repaired = rows.select(
        F.col("conv").alias("conv_id"),
        F.struct("part", "piece", "at").alias("position"),
        F.col("row.roles").alias("role"),
        F.col("row.texts").alias("text"),
    )
    return audits, repaired
