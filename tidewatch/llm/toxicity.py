"""Toxicity of texts whose words may be disguised: restore by a noisy channel, then score.

A token that may be disguised (letters with look-alike signs or with separators between, letters
repeated three times or more, single letters set apart by white space) becomes a lattice of
readings: a sign may stand for a letter, a run of one letter for one or two of it, a separator for
nothing. The Viterbi path under a character trigram model of the whole corpus and the channel's
costs is the restored token. Any other token has one path only and stays as it is. Restored texts are scored by character n-grams
whose share of toxic documents was learned from labels, through a logistic curve. The labelled rows
keep their mixture of toxic and clean ones, n-grams must be significant, and the curve is fitted on
rows that the n-grams were not learned from, so that 0.5 means what it says.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import grams
from tidewatch.llm.common import without

#: Letters that a sign may stand for. Fixed values.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "(": "c",
}
SEPARATORS = " .-_*~"
#: Stands for white space between single letters that is wider than most of it there: as likely
#: the end of a word as not.
WIDE = "\n"
#: Costs in nats: reading a sign as a letter, keeping it as it is, dropping a separator, keeping
#: one between letters, and taking a run of three or more for one letter or two.
SIGN_COST = 1.0
KEEP_COST = 3.0
GAP_COST = 0.2
GAP_KEPT_COST = 2.0
RUN_COST = 0.5
#: Tokens of at most this many characters are remembered.
REMEMBERED = 48
#: Steps after which the part of a reading that is settled is put aside.
SETTLE = 32
#: Classes of characters in the model: 0 is the edge of a word.
CLASSES = 64
#: Labelled rows used at most, of both classes as they are mixed, in order of a hash of their key.
SAMPLE = 20_000
#: Parts of the sample; the curve sees each part through n-grams learned from the others.
FOLDS = 3
#: Slots of the hashed n-grams and their lengths in bytes.
SLOTS = 1 << 20
LENGTHS = (4, 5, 6, 8)
#: Rows of slot counts that a task sends at a time.
SENT = 1 << 16
#: An n-gram counts from this log odds on, and if the likelihood ratio speaks against chance: about
#: one slot in a million reaches it if its documents are toxic as often as any others.
STRONG = 2.0
SURE = 24.0


@dataclass(frozen=True)
class Model:
    """Log probabilities of trigrams, weights of n-gram slots, and the logistic curve."""

    trigrams: np.ndarray
    weights: np.ndarray
    curve: np.ndarray


def classes_of(text: str) -> np.ndarray:
    """Character classes of a lower-cased text: a-z, other letters by code, 0 for the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = np.where(codes >= 0xC0, 27 + codes % (CLASSES - 27), 0)
    plain = (codes >= 97) & (codes <= 122)
    return np.where(plain, codes - 96, out)


def trigram_ids(text: str) -> np.ndarray:
    """Ids of the trigrams of words, each word with edges around it."""
    marks = np.concatenate([[0, 0], classes_of(text), [0]])
    ids = (marks[:-2] * CLASSES + marks[1:-1]) * CLASSES + marks[2:]
    return ids[(marks[1:-1] > 0) | (marks[2:] > 0)]


def count_trigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(trigram, uses)`` over every text, counted where the texts lie, then summed by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for cell in batch.column(0).to_pylist():
                held.append(cell or "")
                size += len(held[-1])
                if size > grams.BLOCK:
                    uses += np.bincount(trigram_ids("\n".join(held).lower()), minlength=CLASSES**3)
                    held, size = [], 0
            uses += np.bincount(trigram_ids("\n".join(held).lower()), minlength=CLASSES**3)
        hit = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(uses[hit])], names=["trigram", "uses"])

    counted = texts.select(F.col(f"`{text}`")).mapInArrow(count, "trigram long, uses long")
    return counted.groupBy("trigram").agg(F.sum("uses").alias("uses"))


def log_trigrams(uses: np.ndarray) -> np.ndarray:
    """Log probability of the third class after two, mixed with bigram and unigram shares."""
    three = uses.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    shares = [
        three / np.maximum(three.sum(axis=2, keepdims=True), 1),
        np.broadcast_to(two / np.maximum(two.sum(axis=1, keepdims=True), 1), three.shape),
        np.broadcast_to(one / one.sum(), three.shape),
    ]
    return np.log(0.7 * shares[0] + 0.25 * shares[1] + 0.05 * shares[2]).reshape(-1)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings with costs for each run of equal characters of a lower-cased token."""
    out: list[list[tuple[str, float]]] = []
    gaps = set(token[1::2]) - {WIDE}
    spaced = len(token) > 2 and len(gaps) == 1 and gaps <= set(SEPARATORS)
    at = 0
    while at < len(token):
        sign, end = token[at], at
        while end < len(token) and token[end] == sign:
            end += 1
        length, inside, at = end - at, 0 < at and end < len(token), end
        if sign in LOOKALIKE:
            readings = [(sign * length, KEEP_COST * length)]
            for letter in LOOKALIKE[sign]:
                readings.append((letter, SIGN_COST))
                if length > 1:
                    readings.append((letter * 2, SIGN_COST))
        elif sign.isalpha() and length > 2:
            readings = [(sign, RUN_COST), (sign * 2, RUN_COST)]
        elif sign == WIDE:
            readings = [(" ", GAP_COST), ("", GAP_COST)]
        elif sign in SEPARATORS and inside:
            readings = [("", GAP_COST)] if spaced else [(sign * length, GAP_KEPT_COST), ("", GAP_COST)]
        else:
            readings = [(sign * length, 0.0)]
        out.append(readings)
    return out


@lru_cache(maxsize=8192)
def _class_of(sign: str) -> int:
    return int(classes_of(sign)[0])


def viterbi(token: str, trigrams: np.ndarray) -> str:
    """The reading of a lower-cased token with the least cost (then the alphabetically first).

    States are pairs of classes; what the readings of all of them begin with is settled, so that
    only the rest is carried through a long token.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    settled = []
    for step, readings in enumerate(lattice(token)):
        if step % SETTLE == SETTLE - 1:
            settled.append(commonprefix([text for _, text in states.values()]))
            states = {pair: (cost, text[len(settled[-1]) :]) for pair, (cost, text) in states.items()}
        found: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for reading, price in readings:
                x, y, total = a, b, cost + price
                for sign in reading:
                    z = _class_of(sign)
                    if y or z:
                        total -= trigrams[(x * CLASSES + y) * CLASSES + z]
                    else:
                        total += 3.0  # a sign after a sign, which the model does not know
                    x, y = y, z
                known = found.get((x, y))
                if known is None or (total, text + reading) < known:
                    found[(x, y)] = (total, text + reading)
        states = found
    ends = [(cost - (trigrams[(a * CLASSES + b) * CLASSES] if b else 0.0), text) for (a, b), (cost, text) in states.items()]
    return "".join([*settled, min(ends)[1]])


class Restorer:
    """Restores texts; remembers the tokens it has read, up to a bounded number."""

    def __init__(self, trigrams: np.ndarray, remembered: int = 100_000):
        self.trigrams = trigrams
        self.known: dict[str, str] = {}
        self.remembered = remembered

    def token(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            found = viterbi(token, self.trigrams)
            if len(token) <= REMEMBERED and len(self.known) < self.remembered:
                self.known[token] = found
        return found


#: Bytes that stand for letters in a lattice, ASCII and other letters, separators inside a token.
SIGN = np.zeros(256, dtype=bool)
SIGN[[ord(c) for c in LOOKALIKE]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True
GAP = np.zeros(256, dtype=bool)
GAP[[ord(c) for c in SEPARATORS if c != " "]] = True


def suspects(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what may be disguised in lower-cased texts, in order.

    Tokens whose lattice has more than one reading: letters with a sign, a separator inside, or a
    letter three times or more in a row; and runs of three or more single characters.
    """
    starts, ends, counts = grams.split((~grams.SPACE[low]).astype(np.uint8), offsets)
    if not len(starts):
        return starts, ends

    def tokens_of(at: np.ndarray, span: int = 1) -> np.ndarray:
        """The tokens that hold all ``span`` bytes from each place on."""
        token = np.searchsorted(starts, at, side="right") - 1
        held = np.zeros(len(starts), dtype=bool)
        held[token[(token >= 0) & (at + span <= ends[token])]] = True
        return held

    letters = np.concatenate([[0], np.cumsum(LETTER[low])])
    worded = letters[ends] > letters[starts]
    flagged = tokens_of(np.flatnonzero(SIGN[low]))
    if len(low) > 2:
        # A run of one separator begins behind another byte of the token and ends before one.
        changes = np.flatnonzero(low[1:] != low[:-1])
        begins = tokens_of(changes[GAP[low[changes + 1]]], 2)
        flagged |= begins & tokens_of(changes[GAP[low[changes]]], 2)
    # Letters of one to four bytes; capitals of the Latin-1 block equal their small letters.
    even = low.copy()
    even[1:][low[:-1] == 0xC3] |= 0x20
    for width, least, most in ((1, 97, 122), (2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        at = np.flatnonzero((low >= least) & (low <= most))
        at = at[at + 3 * width <= len(low)]
        for i in range(width):
            at = at[(even[at + i] == even[at + i + width]) & (even[at + i] == even[at + i + 2 * width])]
        flagged |= tokens_of(at, 3 * width)
    flagged &= worded
    # Runs of single characters with white space between, inside one text.
    owner = np.repeat(np.arange(len(counts)), counts)
    heads = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    solid = LETTER[low[starts]] | SIGN[low[starts]]
    single = (heads[ends] - heads[starts] == 1) & solid
    joined = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    long = last - first >= 2
    first, last = first[long], last[long]
    for a, b in zip(first, last, strict=True):
        flagged[a : b + 1] = False
    token = np.flatnonzero(flagged)
    span_start = np.concatenate([starts[token], starts[first]])
    span_end = np.concatenate([ends[token], ends[last]])
    order = np.argsort(span_start, kind="stable")
    return span_start[order], span_end[order]


BLANKS = re.compile("[ \t\n\v\f\r]+")


def evenly_spaced(token: str) -> str:
    """A run of single characters with white space as one space, or WIDE if wider than the commonest."""
    gaps = BLANKS.findall(token)
    if not gaps:
        return token
    uses = Counter(gaps)
    usual = min(uses, key=lambda gap: (-uses[gap], len(gap), gap))
    return BLANKS.sub(lambda found: " " if len(found[0]) <= len(usual) else WIDE, token)


def restore(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, A-Z lower-cased, with what may be disguised restored."""
    low = grams.LOWER[data]
    starts, ends = suspects(low, offsets)
    parts, gains, done = [], [], 0
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        token = evenly_spaced(low[start:end].tobytes().decode("utf-8").lower())
        found = restorer.token(token).encode() if any(c.isalpha() for c in token) else None
        if found is None:
            gains.append(0)
            continue
        parts += [low[done:start].tobytes(), found]
        gains.append(len(found) - (end - start))
        done = end
    parts.append(low[done:].tobytes())
    total = np.concatenate([[0], np.cumsum(np.array(gains, dtype=np.int64))])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets + total[np.searchsorted(ends, offsets, side="right")]


def restored_text(text: str, trigrams: np.ndarray) -> str:
    """One text restored."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return restore(data, np.array([0, len(data)]), Restorer(trigrams))[0].tobytes().decode()


def slots(sums: np.ndarray, length: int) -> np.ndarray:
    """Slots of the byte n-grams of one length, from running hash sums."""
    n = max(len(sums) - length, 0)
    hashes = (sums[length:] - sums[:n]) * grams.powers(grams.UNBASE, n)
    return ((hashes * grams.U(0xD1342543DE82EF95 + 2 * length)) >> grams.U(44)).astype(np.int64)


def evidence(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Per text: logs of one plus its hits' weight, its hits, and hits per 1,000 bytes; the largest weight.

    With ``fold``, ``weights`` has a row per fold and each text is seen through its own.
    """
    n = len(offsets) - 1
    total, most, hits = np.zeros(n), np.zeros(n), np.zeros(n)
    sums = grams.running(data)
    for length in LENGTHS:
        slot = slots(sums, length)
        weight = weights[slot] if fold is None else weights[np.repeat(fold, np.diff(offsets))[: len(slot)], slot]
        at = np.flatnonzero(weight)
        owner = np.searchsorted(offsets, at, side="right") - 1
        inside = at + length <= offsets[owner + 1]
        at, owner = at[inside], owner[inside]
        total += np.bincount(owner, weights=weight[at], minlength=n)
        hits += np.bincount(owner, minlength=n)
        np.maximum.at(most, owner, weight[at])
    rate = 1000.0 * hits / np.maximum(np.diff(offsets), 50)
    return np.stack([np.log1p(total), np.log1p(hits), np.log1p(rate), most], axis=1)


def labelled_sample(labels: DataFrame, limit: int = SAMPLE, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``(key, toxic, fold)`` of at most ``limit`` labelled keys, by hash order whatever their class.

    Keys that are held out, NULL or labelled both ways are left out.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    named = named.filter(~held_out(F.col("key"))).filter("toxic IN (0, 1)")
    sure = named.groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    text = F.col("key").cast("string")
    fold = F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(FOLDS)).cast("int").alias("fold")
    return sure.orderBy(F.xxhash64(text), "key").limit(limit).select("key", "toxic", fold)


def strong_slots(clean: np.ndarray, toxic: np.ndarray, clean_texts: int, toxic_texts: int) -> np.ndarray:
    """The log odds of each slot that speaks for toxicity beyond chance, 0 for the others."""
    odds = np.log((toxic + 0.1) / (toxic_texts + 0.2)) - np.log((clean + 0.5) / (clean_texts + 1.0))
    share = toxic_texts / max(clean_texts + toxic_texts, 1)
    seen = clean + toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(toxic > 0, toxic * np.log(toxic / (seen * share)), 0.0)
            + np.where(clean > 0, clean * np.log(clean / (seen * (1 - share))), 0.0)
        )
    return np.where((odds > STRONG) & (ratio > SURE), odds, 0.0)


def held_out(key) -> F.Column:
    """Rows whose labels are never used: crc32 of the key as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Model:
    """The character model from every text, n-gram weights and curve from the labelled sample.

    Without toxic or without clean labelled rows the curve gives the constant share of toxic ones
    (0 without labels).
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counted = count_trigrams(rows).toPandas()  # at most CLASSES^3 rows
    uses = np.zeros(CLASSES**3)
    uses[counted["trigram"]] = counted["uses"]
    trigrams = log_trigrams(uses)
    # At most ``limit`` rows of a key, a flag and a fold, whatever the input.
    sample = labelled_sample(labels, limit, key)
    chosen = rows.join(F.broadcast(sample), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigrams)
        seen = np.zeros((2 * FOLDS, SLOTS), dtype=np.int32)
        for batch in batches:
            kinds = np.array(batch.column("toxic").to_pylist(), dtype=np.int64) * FOLDS
            kinds += np.array(batch.column("fold").to_pylist(), dtype=np.int64)
            for first, data, offsets in grams.blocks(batch.column("text")):
                data, offsets = restore(data, offsets, restorer)
                sums = grams.running(data)
                for length in LENGTHS:
                    slot = slots(sums, length)
                    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                    inside = np.arange(len(slot)) + length <= offsets[owner[: len(slot)] + 1]
                    pair = np.unique(owner[: len(slot)][inside] * SLOTS + slot[inside])
                    kind = kinds[first + pair // SLOTS]
                    for part in np.unique(kind):
                        seen[part] += np.bincount(pair[kind == part] % SLOTS, minlength=SLOTS).astype(np.int32)
        hit = np.flatnonzero(seen.any(axis=0))
        for first in range(0, len(hit), SENT):
            part = hit[first : first + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(row[part].astype(np.int64)) for row in seen)], names=["slot", *counts])

    counts = [f"{kind}{fold}" for kind in ("clean", "toxic") for fold in range(FOLDS)]
    counted = chosen.mapInArrow(count, ", ".join(["slot long", *[f"{c} long" for c in counts]]))
    # The texts are counted by themselves, so that the slots are read once and need not be kept.
    summed = counted.groupBy("slot").agg(*[F.sum(c).alias(c) for c in counts])
    texts = np.zeros((2, FOLDS), dtype=np.int64)
    for row in chosen.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        texts[row["toxic"], row["fold"]] = row["n"]
    clean, toxic = int(texts[0].sum()), int(texts[1].sum())
    weights = np.zeros(SLOTS)
    if not clean or not toxic:
        share = toxic / max(clean + toxic, 1)
        level = -30.0 if not toxic else (30.0 if share == 1 else np.log(share / (1 - share)))
        return Model(trigrams, weights, np.array([level, 0.0, 0.0, 0.0, 0.0]))
    # Only slots that some toxic texts more than chance have reach the driver: fewer than the toxic
    # texts of the sample have n-grams, whatever the input. The likelihood ratio cannot be enough
    # below ``least`` toxic texts, whichever fold is left out.
    others = texts.sum(axis=1, keepdims=True) - texts
    least = SURE / (2 * np.log(1 / max(float((others[1] / np.maximum(others.sum(axis=0), 1)).min()), 1e-9)))
    of = {kind: " + ".join(f"{kind}{fold}" for fold in range(FOLDS)) for kind in ("clean", "toxic")}
    likelier = f"({of['toxic']}) * {clean} > ({of['clean']}) * {toxic}"
    found = summed.filter(f"{of['toxic']} >= {least} AND {likelier}").select("slot", *counts).toPandas()
    uses = found[counts].to_numpy().T.reshape(2, FOLDS, -1)
    slot = found["slot"].to_numpy()
    weights[slot] = strong_slots(*uses.sum(axis=1), clean, toxic)
    unseen = np.zeros((FOLDS, SLOTS), dtype=np.float32)
    for fold in range(FOLDS):
        others = uses.sum(axis=1) - uses[:, fold]
        unseen[fold, slot] = strong_slots(*others, clean - int(texts[0, fold]), toxic - int(texts[1, fold]))
    points = _evidence_of(chosen.select("text", "toxic", "fold"), trigrams, unseen).select("toxic", "signs").toPandas()
    signs = np.array(points["signs"].to_list()).reshape(-1, 4)
    return Model(trigrams, weights, logistic(signs, points["toxic"].to_numpy(dtype=float)))


def logistic(signs: np.ndarray, label: np.ndarray, penalty: float = 1.0, steps: int = 100) -> np.ndarray:
    """Coefficients of a ridge logistic regression, intercept first.

    Newton's method on standardised signs; a step is halved until it lessens the loss, which is
    convex, so the way to its least value does not swing even where the classes part.
    """
    middle, spread = signs.mean(axis=0), signs.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    x = np.column_stack([np.ones(len(signs)), (signs - middle) / spread])
    ridge = penalty * np.diag([0.0, *[1.0] * signs.shape[1]])

    def loss(c: np.ndarray) -> float:
        line = x @ c
        return float(np.logaddexp(0, line).sum() - label @ line + c @ ridge @ c / 2)

    curve = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        slope = x.T @ (label - p) - ridge @ curve
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        move, before = np.linalg.solve(bend, slope), loss(curve)
        while loss(curve + move) > before and np.abs(move).max() > 1e-9:
            move = move / 2
        curve = curve + move
        if np.abs(move).max() < 1e-8:
            break
    factors = curve[1:] / spread
    return np.concatenate(([curve[0] - factors @ middle], factors))


def _evidence_of(rows: DataFrame, trigrams: np.ndarray, weights: np.ndarray, text: str = "text", restored: str | None = None) -> DataFrame:
    extra = [T.StructField("signs", T.ArrayType(T.DoubleType()))]
    extra += [T.StructField(restored, T.StringType())] if restored else []
    schema = T.StructType([*rows.schema.fields, *extra])
    # Sparse form for the way to the tasks; with folds, a row of weights each.
    table_shape, flat = weights.shape, weights.reshape(-1)
    hit = np.flatnonzero(flat)
    hit_weights = flat[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigrams)
        table = np.zeros(table_shape, dtype=np.float32)
        table.reshape(-1)[hit] = hit_weights
        for batch in batches:
            for first, data, offsets in grams.blocks(batch.column(text)):
                data, offsets = restore(data, offsets, restorer)
                part = batch.slice(first, len(offsets) - 1)
                fold = part.column("fold").to_numpy() if table.ndim == 2 else None
                signs = pa.array(evidence(data, offsets, table, fold).tolist(), pa.list_(pa.float64()))
                columns, names = [*part.columns, signs], [*part.schema.names, "signs"]
                if restored:
                    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
                    whole = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)
                    columns.append(whole.cast(pa.string()))
                    names.append(restored)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", restored: str | None = "restored") -> DataFrame:
    """``documents`` with ``held_out``, ``score`` (0 to 1), ``predicted`` and the restored text.

    NULL and empty texts have no evidence and get the curve's lowest value. Columns of these
    names are replaced. ``restored=None`` leaves the restored text out.
    """
    added = ["held_out", "score", "predicted", "signs", *([restored] if restored else [])]
    kept = documents.select(*without(documents, *added))
    signed = _evidence_of(kept, model.trigrams, model.weights, text, restored)
    line = F.lit(float(model.curve[0]))
    for i, factor in enumerate(model.curve[1:]):
        line = line + F.col("signs")[i] * F.lit(float(factor))
    value = F.round(1 / (1 + F.exp(-line)), 9)
    return (
        signed.withColumn("held_out", held_out(F.col(f"`{key}`")))
        .withColumn("score", value)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .drop("signs")
    )
