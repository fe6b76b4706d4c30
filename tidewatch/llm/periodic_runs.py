"""Periodic runs of words, found on a grammar of each text.

1. Re-Pair: the most frequent pair of neighbouring symbols of a text becomes a new symbol until no
   pair occurs twice. Thousands of texts are reduced together; in one pass a text replaces every
   pair that is more frequent than both pairs it overlaps with, the most frequent one among them.
2. A run inside a text lies across the boundary of exactly one smallest symbol that holds it whole,
   or across a boundary of the reduced text. So runs are sought across the boundary of each symbol
   once, however often the symbol occurs.
3. A run of at least four periods that crosses a boundary reaches two periods to one side of it, so
   the words around the boundary recur one period further on that side. Recurrences of 4, 16, 64 …
   words give the periods to try, hashes of stretches their extents; runs that are kept are compared
   word by word.
4. A symbol's runs hold at all places it was put at. Intervals of one period that overlap by a period
   are one run; of several periods of one interval the smallest counts.

Words are told apart by 64-bit hashes. Work and memory of a task are bounded by a block of texts of
about a MiB, or by one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import grams
from tidewatch.llm.common import without

#: A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Periods compared at a time; only speed depends on it.
TRIED = 1 << 16

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key's group, and the size of each group."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    numbers = np.empty(len(keys), dtype=np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers, np.diff(np.append(np.flatnonzero(new), len(keys)))


def _spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Grammar:
    """The symbols of many texts: ``low``, ``cut`` and ``high`` are the word places where the first
    occurrence of a symbol starts, is divided and ends; ``rule`` and ``place`` list all occurrences.
    ``tops`` are the starts of the symbols left in the reduced texts."""

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        symbols, text = words.copy(), texts
        start, end = np.arange(len(words)), np.arange(len(words)) + 1
        fresh = int(words.max()) + 1 if len(words) else 0
        tops, nodes, rules, places, made = [], [], [], [], 0
        while len(symbols):
            inside = np.zeros(len(symbols), dtype=bool)
            inside[:-1] = text[1:] == text[:-1]
            key = np.full(len(symbols), -1, dtype=np.int64)
            key[:-1] = (symbols[:-1] << 32) | symbols[1:]
            # In a stretch of one symbol every other pair counts, the rest overlap with those.
            repeated = np.zeros(len(symbols), dtype=bool)
            repeated[1:] = inside[1:] & inside[:-1] & (key[1:] == key[:-1])
            at = np.arange(len(symbols))
            since = at - np.maximum.accumulate(np.where(repeated, 0, at))
            found = np.flatnonzero(inside & (since % 2 == 0))
            group, sizes = _groups(key[found])
            weight = np.zeros(len(symbols) + 2, dtype=np.int64)
            often = sizes[group] > 1
            weight[found[often] + 1] = (sizes[group[often]] << 32) | (group[often] + 1)
            open_texts = np.unique(text[found[often]])
            goes_on = np.isin(text, open_texts)
            if not goes_on.all():
                tops.append(start[~goes_on])
            if not len(open_texts):
                break
            own = weight[1:-1]
            won = np.flatnonzero((own > 0) & (own > weight[:-2]) & (own > weight[2:]))
            names, sizes = _groups(own[won])
            won, names = won[sizes[names] > 1], names[sizes[names] > 1]
            rank = np.cumsum(sizes > 1) - 1
            names = rank[names]
            # Where each new symbol first occurs, and all its places.
            _, first = np.unique(names, return_index=True)
            head = won[first]
            nodes.append((start[head], start[head + 1], end[head + 1]))
            rules.append(names + made)
            places.append(start[won])
            made += len(first)
            symbols[won] = names + fresh
            fresh += len(first)
            end[won] = end[won + 1]
            goes_on[won + 1] = False
            symbols, text, start, end = symbols[goes_on], text[goes_on], start[goes_on], end[goes_on]
        none = np.zeros(0, dtype=np.int64)
        self.low, self.cut, self.high = (np.concatenate(x) for x in zip(*nodes, strict=True)) if nodes else (none,) * 3
        self.rule, self.place = (np.concatenate(x) if x else none for x in (rules, places))
        self.tops = np.sort(np.concatenate(tops)) if tops else none


class _Stretches:
    """Hashes of stretches of words, and how far two stretches agree."""

    def __init__(self, words: np.ndarray):
        self.words = words
        values = grams.mix(words.astype(np.uint64) + grams.U(0x9E3779B97F4A7C15))
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(values * grams.powers(grams.BASE, len(words)), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return grams.stretch(self.sums, start, end)

    def agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        """Words in which the texts from ``x`` and ``y`` on (or before them) agree, up to ``most``."""
        sure, beyond = np.zeros(len(x), dtype=np.int64), most + 1
        while len(x) and (beyond - sure > 1).any():
            half = (sure + beyond) // 2
            if ahead:
                same = self.hashes(x, x + half) == self.hashes(y, y + half)
            else:
                same = self.hashes(x - half, x) == self.hashes(y - half, y)
            sure, beyond = np.where(same, half, sure), np.where(same, beyond, half)
        return sure


def _periods(
    words: np.ndarray, ends: np.ndarray, stretches: _Stretches, cut: np.ndarray, low: np.ndarray, high: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(boundaries, x, q)``: periods ``q`` to try at boundaries, where words ``x`` and ``x + q`` agree.

    ``ends`` is the end of the text of each word.
    """
    all_of = np.arange(len(cut))
    near = all_of[words[cut - 1] == words[cut]]
    yield near, cut[near] - 1, np.ones(len(near), dtype=np.int64)
    right = all_of[cut + 2 < high]
    s = cut[right]
    right = right[(words[s - 1] == words[s + 1]) & (words[s] == words[s + 2])]
    yield right, cut[right] - 1, np.full(len(right), 2)
    left = all_of[cut - 3 >= low]
    s = cut[left]
    left = left[(words[s] == words[s - 2]) & (words[s - 1] == words[s - 3])]
    yield left, cut[left] - 2, np.full(len(left), 2)
    active, size = np.arange(len(words)), 4
    longest = (high - low) // LEAST_PERIODS
    while True:
        active = active[active + size <= ends[active]]
        nodes = all_of[longest >= size - 1]
        if not len(active) or not len(nodes):
            return
        hashes = stretches.hashes(active, active + size)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        here, there = active[order][:-1][same], active[order][1:][same]
        after, before = (np.full(len(words) + 1, -1, dtype=np.int64) for _ in range(2))
        after[here], before[there] = there, here
        for hop, x in ((after, cut[nodes] - 1), (before, cut[nodes] - size + 1)):
            kept = x >= low[nodes]
            who, origin = nodes[kept], x[kept]
            place = hop[origin]
            while len(who):
                q = np.abs(place - origin)
                stays = (place >= 0) & (q <= np.minimum(longest[who], 4 * size - 2))
                who, origin, place, q = who[stays], origin[stays], place[stays], q[stays]
                tried = q >= size - 1
                yield who[tried], (cut[who] - 1 if hop is after else cut[who] - q)[tried], q[tried]
                place = hop[place]
        active = np.unique(np.concatenate([here, there]))
        size *= 4


def _exact(words: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether words ``q`` apart are the same all through ``start:end``."""
    counts = end - start - q
    at = np.repeat(start, counts) + _spans(counts)
    wrong = words[at] != words[at + np.repeat(q, counts)]
    return np.bincount(np.repeat(np.arange(len(start)), counts)[wrong], minlength=len(start)) == 0


def _smallest(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Indexes of the smallest period of each interval, by start, end."""
    order = np.lexsort((q, end, start))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (start[order][1:] != start[order][:-1]) | (end[order][1:] != end[order][:-1])
    return order[new]


def _gathered(parts: Iterator[tuple]) -> Iterator[tuple]:
    """The arrays of ``parts`` put together, TRIED or more entries at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= TRIED:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


def _crossing(words: np.ndarray, ends: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """``(boundary, start, end, period)`` of runs inside ``low:high`` that cross ``cut``."""
    stretches = _Stretches(words)
    found = []
    for node, x, q in _gathered(_periods(words, ends, stretches, cut, low, high)):
        y = x + q
        end = y + stretches.agree(x, y, high[node] - y, ahead=True)
        start = x - stretches.agree(x, y, x - low[node], ahead=False)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(tuple(v[long] for v in (node, start, end, q)))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    node, start, end, q = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((q, end, start, node))
    node, start, end, q = (v[order] for v in (node, start, end, q))
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    node, start, end, q = (v[first] for v in (node, start, end, q))
    if not _exact(words, start, end, q).all():  # two different stretches of one hash
        return _crossing_slow(words, cut, low, high)
    return node, start, end, q


def _crossing_slow(words: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """The same by comparing words, for blocks in which hashes of different stretches agree."""
    found = []
    for node, (s, a, b) in enumerate(zip(cut.tolist(), low.tolist(), high.tolist(), strict=True)):
        for q in range(1, (b - a) // LEAST_PERIODS + 1):
            breaks = np.flatnonzero(words[a : b - q] != words[a + q : b]) + a
            # The stretch of agreeing places around the boundary, on either side of it.
            for x in {s - 1, s - q}:
                if a <= x < b - q and words[x] == words[x + q]:
                    at = np.searchsorted(breaks, x)
                    start = breaks[at - 1] + 1 if at else a
                    end = (breaks[at] if at < len(breaks) else b - q) + q
                    if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and start < s < end:
                        found.append((node, start, end, q))
    node, start, end, q = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 4).T
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[first], start[first], end[first], q[first]


def _merged(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> Runs:
    """Intervals of one period that overlap by a period or more, joined."""
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    new_period = np.ones(len(q), dtype=bool)
    new_period[1:] = q[1:] != q[:-1]
    # Ends grow along the whole list if each period's intervals are moved behind those before.
    shift = (np.cumsum(new_period) - 1) * (int(end.max()) + 1 if len(end) else 0)
    reach = np.maximum.accumulate(end + shift) - shift
    new = new_period.copy()
    new[1:] |= start[1:] + q[1:] > reach[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(q)) - 1 if len(firsts) else firsts
    start, end, q = start[firsts], reach[lasts], q[firsts]
    kept = _smallest(start, end, q)
    return start[kept], end[kept], q[kept]


def runs_of(words: np.ndarray, counts: np.ndarray) -> Runs:
    """``(start, end, period)`` of every run in texts of ``counts`` words each, as places in
    ``words``, by start and period. Words are any integers."""
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    if not len(words):
        return (np.zeros(0, dtype=np.int64),) * 3
    own, _ = _groups((grams.mix(words.astype(np.uint64)) + grams.mix(text.astype(np.uint64) + grams.U(1))).view(np.int64))
    grammar = Grammar(own, text)
    starts = ends - np.repeat(counts, counts)
    tops = grammar.tops[grammar.tops > starts[grammar.tops]]
    cut = np.concatenate([grammar.cut, tops])
    low = np.concatenate([grammar.low, starts[tops]])
    high = np.concatenate([grammar.high, ends[tops]])
    wide = np.flatnonzero(high - low >= LEAST_WORDS)
    node, start, end, q = _crossing(own, ends, cut[wide], low[wide], high[wide])
    node = wide[node]
    whole = node >= len(grammar.cut)
    parts = [(start[whole], end[whole], q[whole])]
    if not whole.all():
        order = np.argsort(grammar.rule, kind="stable")
        firsts = np.searchsorted(grammar.rule[order], np.arange(len(grammar.cut) + 1))
        inner = np.flatnonzero(~whole)
        uses = np.diff(firsts)[node[inner]]
        each = np.repeat(inner, uses)
        places = grammar.place[order][np.repeat(firsts[node[inner]], uses) + _spans(uses)]
        moved = places - grammar.low[node[each]]
        parts.append((start[each] + moved, end[each] + moved, q[each]))
    return _merged(*(np.concatenate(v) for v in zip(*parts, strict=True)))


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Runs of each text and each text without the repeats, words joined by one space."""
    starts, ends, counts = grams.split((~grams.SPACE[data]).astype(np.uint8), offsets)
    words = grams.mix(grams.stretch(grams.running(data), starts, ends)).view(np.int64)
    begin, end, period = runs_of(words, counts)
    text = np.searchsorted(np.cumsum(counts), begin, side="right")
    first = np.cumsum(counts) - counts
    found = pa.StructArray.from_arrays(
        [pa.array(v, pa.int64()) for v in (begin - first[text], end - begin, period)], names=["start", "length", "period"]
    )
    per_text = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(counts)))))
    # Words go that lie in a run behind its first period.
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, end, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    owner = np.repeat(np.arange(len(counts)), counts)[kept]
    followed = np.zeros(len(kept), dtype=bool)
    followed[:-1] = owner[1:] == owner[:-1]
    # A kept word with one more kept word behind it takes along the blank that ends it.
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[kept]] += 1
    np.add.at(edge, ends[kept] + followed, -1)
    chosen = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = data[chosen]
    blanks = np.zeros(len(data), dtype=bool)
    blanks[ends[kept][followed]] = True
    out[blanks[chosen]] = 0x20
    lengths = np.concatenate(([0], np.cumsum(chosen)))[offsets]
    texts = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(out))
    return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), found), texts.cast(pa.string())


def collapse(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``runs`` and ``collapsed``, one row per row.

    ``runs`` are ``(start, length, period)`` of each run of the text, counted in words between white
    space (space, tab, line feed, vertical tab, form feed, carriage return), by start and period. A
    run is a stretch of at least LEAST_WORDS words and LEAST_PERIODS times its smallest period that no
    neighbouring word extends. ``collapsed`` is the text without the words that lie in a run behind
    its first period, joined by single spaces. NULL and empty texts and those without words have no
    runs and collapse to the empty text. Rows are independent of each other: repeated rows, NULL or
    repeated keys change nothing. Columns of the two names are replaced, others are kept.
    """
    kept = without(documents, "runs", "collapsed")
    rows = documents.select(*kept)
    source = documents.select(F.col(f"`{text}`").cast("string")).schema[0].name
    if text.lower() in ("runs", "collapsed"):
        raise ValueError("the text column must not be named runs or collapsed")
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in grams.blocks(batch.column(source)):
                runs, texts = _block(data, offsets)
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, runs, texts], names=[*part.schema.names, "runs", "collapsed"])

    return rows.mapInArrow(run, schema)
