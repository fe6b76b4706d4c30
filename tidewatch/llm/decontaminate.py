"""Benchmark passages in documents, found by the q-gram lemma and verified by alignment.

Items are cut into overlapping windows of two lengths: long ones leave room for replaced words,
short ones find pieces of an item. A stretch of text within ``k`` edits of a window of ``w`` bytes
shares at least ``w - q + 1 - k * q`` of its q-grams, on diagonals (place in the text less place
in the item) that differ by at most ``k``. Documents are scanned once against an index of the
items' q-grams; shared ones that lie alone are dropped, the rest are counted per window in
overlapping bands of diagonals, and bands that reach the bound are aligned bit-parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import grams
from tidewatch.llm.common import fresh, tidy, without

Q = 6
#: Length and stride of the windows, and edits allowed per byte. A long window, or an item that
#: is shorter, may also lose its longest word.
LONG = (128, 32, 0.13)
PIECE = (48, 12, 0.105)
#: Q-grams that a stretch within the budget shares at least, however short the window.
SHARED = 3
#: Bytes of benchmark text that one pass over the documents looks for.
PASS_BYTES = 1 << 20
#: Shared q-grams handled at a time, and alignments.
SLAB = 1 << 18
ALIGNED = 4_096
#: Lower-cased A-Z; all white space is one kind, and a run of it one sign (``folded``).
FOLD = grams.LOWER.copy()
FOLD[grams.SPACE] = 32
FILTER_BITS = 20

LEAK = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Index:
    """Windows of the items, and the places of q-grams in all items joined, sorted by hash."""

    items: list[str]
    window_item: np.ndarray
    windows: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    #: Distinct hashes, and where each one's places begin (one entry more).
    hashes: np.ndarray
    firsts: np.ndarray
    place: np.ndarray
    #: Where each window begins among all bytes, and windows by byte: those that hold its q-gram.
    begin: np.ndarray
    holders: np.ndarray
    holder_firsts: np.ndarray
    #: Items shorter than a q-gram: by length, their bytes as numbers (sorted) and their items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def budget(window: bytes, long: bool) -> int:
    """Edits allowed in a window, so many that SHARED q-grams must remain."""
    edits = int(LONG[2] * len(window)) if long else int(PIECE[2] * len(window))
    if long:
        edits = max(edits, max(map(len, window.split())))
    return max(min(edits, (len(window) - Q + 1 - SHARED) // Q), 0)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes folded, each run of white space inside a text as one space; their offsets and places."""
    signs = FOLD[data]
    kept = np.ones(len(signs), dtype=bool)
    if len(signs):
        blank = signs == 32
        kept[1:] = ~(blank[1:] & blank[:-1])
        kept[offsets[:-1][offsets[:-1] < len(signs)]] = True
    places = np.flatnonzero(kept)
    return signs[places], np.searchsorted(places, offsets), places


def numbers(data: np.ndarray, length: int) -> np.ndarray:
    """Every stretch of ``length`` bytes as a number."""
    out = np.zeros(max(len(data) - length + 1, 0), dtype=np.int64)
    for i in range(length):
        out = out * 256 + data[i : i + len(out)]
    return out


def index_of(items: list[tuple[str, str | None]]) -> Index:
    """Index of ``(name, text)``. Empty and NULL items are never found."""
    names, bodies, window_item, windows, window_begin, allowed = [], [], [], [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    size = 0
    for name, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
        raw = np.frombuffer((text or "").strip().encode(), dtype=np.uint8)
        body = folded(raw, np.array([0, len(raw)]))[0].tobytes()
        if not body:
            continue
        if len(body) < Q:
            short.setdefault(len(body), []).append((int.from_bytes(body, "big"), len(names)))
        else:
            for width, stride, _ in (LONG, PIECE) if len(body) > PIECE[0] else (LONG,):
                last = max(len(body) - width, 0)
                for start in [*range(0, last, stride), last]:
                    window_item.append(len(names))
                    windows.append(body[start : start + width])
                    window_begin.append(size + start)
                    allowed.append(budget(windows[-1], width == LONG[0]))
        names.append(name)
        bodies.append(body)
        size += len(body)
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    edits = np.array(allowed, dtype=np.int64)
    begin = np.array(window_begin, dtype=np.int64)
    # Q-grams of each window by place; a place that no window holds is not indexed.
    count = lengths - Q + 1
    window = np.repeat(np.arange(len(windows)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    holders = window[np.argsort(at, kind="stable")]
    holder_firsts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=size))])
    place = np.flatnonzero(np.diff(holder_firsts))
    hashes = grams.stretch(grams.running(np.frombuffer(b"".join(bodies), dtype=np.uint8)), place, place + Q)
    order = np.lexsort((place, hashes))
    distinct, firsts = np.unique(hashes[order], return_index=True)
    bound = lengths - Q + 1 - edits * Q
    codes = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(pairs), strict=True)) for n, pairs in short.items()}
    return Index(
        names, np.array(window_item, dtype=np.int64), windows, edits, bound, distinct, np.append(firsts, len(place)),
        place[order], begin, holders, holder_firsts, codes,
    )


def distances(patterns: list[bytes], regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and a stretch of its region, and the first end of one.

    Myers' bit-parallel columns, for all pairs at once; a pattern takes one word per 64 bytes.
    """
    n, width = regions.shape
    lengths = np.array([len(p) for p in patterns], dtype=np.int64)
    words = int(-(-lengths.max() // 64))
    rows, one = np.arange(n), np.uint64(1)
    signs = np.frombuffer(b"".join(p.ljust(words * 64, b"\xff") for p in patterns), dtype=np.uint8).reshape(n, -1)
    # Bytes that no pattern has share the last code, which equals nothing.
    kinds = np.flatnonzero(np.bincount(signs.reshape(-1), minlength=256)[:255])
    code = np.full(256, len(kinds), dtype=np.int64)
    code[kinds] = np.arange(len(kinds))
    alphabet = len(kinds) + 1
    equal = np.zeros((words, n, alphabet), dtype=np.uint64)
    for i in range(words * 64):
        equal[i // 64, rows, code[signs[:, i]]] |= one << np.uint64(i % 64)
    equal[:, :, -1] = 0
    equal = equal.reshape(words, -1)
    columns = code[regions.T] + rows * alphabet
    top = ((lengths - 1) % 64).astype(np.uint64)
    last = (lengths - 1) // 64
    ending = [last == w for w in range(words)]
    up = np.full((words, n), np.uint64(2**64 - 1))
    down = np.zeros((words, n), dtype=np.uint64)
    score, best, end = lengths.copy(), lengths.copy(), np.zeros(n, dtype=np.int64)
    for j in range(width):
        more = less = None
        for w in range(words):
            eq, pv, mv = equal[w].take(columns[j]), up[w], down[w]
            xv = eq | mv
            if less is not None:
                eq |= less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if ending[w].any():
                step = ((ph >> top) & one).view(np.int64) - ((mh >> top) & one).view(np.int64)
                score += step if words == 1 else np.where(ending[w], step, 0)
            if w + 1 < words:
                high_more, high_less = ph >> np.uint64(63), mh >> np.uint64(63)
            ph <<= one
            mh <<= one
            if more is not None:
                ph |= more
                mh |= less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            if w + 1 < words:
                more, less = high_more, high_less
        better = score < best
        if better.any():
            best = np.where(better, score, best)
            end = np.where(better, j + 1, end)
    return best, end


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def spread(firsts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``firsts[i] … firsts[i] + count[i] - 1`` of every ``i``, in order."""
    return np.arange(int(count.sum())) + np.repeat(firsts - (np.cumsum(count) - count), count)


@dataclass(frozen=True)
class Kind:
    """Windows of similar size: the most edits, the reach of a match, windows by byte, the least bound there."""

    most: int
    span: int
    holders: np.ndarray
    firsts: np.ndarray
    held: np.ndarray
    least: np.ndarray


def kind_of(index: Index, lengths: np.ndarray, chosen: np.ndarray) -> Kind:
    """The kind that the ``chosen`` windows, some at least, make up."""
    most = int(index.edits[chosen].max())
    own = chosen[index.holders]
    firsts = np.concatenate([[0], np.cumsum(own)])[index.holder_firsts]
    holders = index.holders[own]
    held = np.diff(firsts) > 0
    least = np.ones(len(firsts), dtype=np.int64)
    least[np.flatnonzero(held)] = np.minimum.reduceat(index.bound[holders], firsts[:-1][held])
    return Kind(most, int(lengths[chosen].max()) + most, holders, firsts, held, least)


class Finder:
    """Finds the items of an index in texts."""

    def __init__(self, index: Index):
        self.index = index
        # Numbers within a slab take half the room, where all of them fit.
        self.small = np.int32 if len(index.holder_firsts) < 1 << 30 else np.int64
        # By the first bits of a hash: the first hash that begins so (one entry more), and whether any does.
        slot = (index.hashes >> grams.U(64 - FILTER_BITS)).astype(np.int64)
        held = np.bincount(slot, minlength=1 << FILTER_BITS)
        self.slots = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        self.filter = held > 0
        self.chain = int(held.max())
        self.lengths = np.array([len(w) for w in index.windows], dtype=np.int64)
        self.most = int(index.edits.max()) if len(index.edits) else 0
        #: Places within which the q-grams of one match lie; texts are set apart by more.
        self.span = int(self.lengths.max()) + self.most if len(index.edits) else 0
        self.apart = 2 * self.span + 2 * self.most + 2
        # Cells wide enough that a match lies in two by two of them.
        self.cell = max(self.most, 1).bit_length(), max(self.span, 1).bit_length()
        self.cell = self.cell[0], max(self.cell)
        # The least bound of the windows that hold a place.
        self.least = np.ones(len(index.holder_firsts), dtype=np.int64)
        held = np.flatnonzero(np.diff(index.holder_firsts))
        if len(held):
            self.least[held] = np.minimum.reduceat(index.bound[index.holders], index.holder_firsts[held])
        # Narrow windows are told by narrow bands and stretches, which the wide ones would blur.
        narrow = (self.lengths <= PIECE[0]) & (index.edits <= int(PIECE[2] * PIECE[0]))
        self.kinds = [kind_of(index, self.lengths, chosen) for chosen in (narrow, ~narrow) if chosen.any()]
        # A cell need not count beyond the largest bound; four such counts fit a byte.
        self.full = max([1, *(int(kind.least.max()) for kind in self.kinds)])
        self.place = index.place.astype(self.small)
        self.counter = np.uint8 if self.full <= 63 else np.int32
        self.enough = self.least.astype(self.counter)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int, int]]]:
        """Leaks ``(item, edits, start, length)`` by the number of the text in the block."""
        body, limits, places = folded(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        self._short(body, limits, best)
        if len(body) >= Q and self.index.windows:
            self._long(body, limits, best)
        found: dict[int, list[tuple[str, int, int, int]]] = {}
        for (text, item), (_, edits, begin, end) in sorted(best.items()):
            first, after = int(places[begin]), int(places[end - 1]) + 1
            found.setdefault(text, []).append((self.index.items[item], edits, first - int(offsets[text]), after - first))
        return found

    def _short(self, body: np.ndarray, limits: np.ndarray, best: dict) -> None:
        for length, (codes, items) in self.index.short.items():
            made = numbers(body, length)
            at = np.flatnonzero(np.isin(made, codes))
            text = np.searchsorted(limits, at, side="right") - 1
            inside = at + length <= limits[text + 1]
            at, text = at[inside], text[inside]
            _, first = np.unique(np.stack([text, made[at]], axis=1), axis=0, return_index=True)
            for i in first.tolist():
                a, b = (int(np.searchsorted(codes, made[at[i]], side=side)) for side in ("left", "right"))
                for item in items[a:b].tolist():
                    best[int(text[i]), item] = (-length, 0, int(at[i]), int(at[i]) + length)

    def _long(self, body: np.ndarray, limits: np.ndarray, best: dict) -> None:
        index = self.index
        sums = grams.running(body)
        hashes = (sums[Q:] - sums[:-Q]) * grams.powers(grams.UNBASE, len(body) - Q + 1)
        slot = (hashes >> grams.U(64 - FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero(self.filter[slot])
        at, gram = self._grams(at, slot[at], hashes[at])
        text = np.repeat(np.arange(len(limits) - 1), np.diff(np.searchsorted(at, limits)))
        kept = at + Q <= limits[text + 1]
        at, gram, text = at[kept], gram[kept], text[kept]
        spot = at + text * self.apart
        count = index.firsts[gram + 1] - index.firsts[gram]
        sizes = np.concatenate([[0], np.cumsum(count)])
        starts = limits[:-1] + np.arange(len(limits) - 1) * self.apart
        first, close = 0, []
        while first < len(spot):
            # The next slab starts a match's reach before this one's end.
            again = int(np.searchsorted(spot, spot[first] + 2 * self.apart, side="right"))
            stop = max(int(np.searchsorted(sizes, sizes[first] + SLAB)), min(again, len(spot)))
            places = spread(index.firsts[gram[first:stop]], count[first:stop])
            near = spot[first:stop] - spot[first]
            if near[-1] < 1 << 30:
                near = near.astype(self.small)
            close.append(self._slab(starts, int(spot[first]), np.repeat(near, count[first:stop]), self.place.take(places)))
            if stop >= len(spot):
                break
            first = max(int(np.searchsorted(spot, spot[stop - 1] - self.apart)), first + 1)
        if not close:
            return
        # Aligned together, since the steps of an alignment cost little more for many.
        window, low, text = (np.concatenate(x) for x in zip(*close, strict=True))
        for words in (1, 2):
            of_size = np.flatnonzero((self.lengths[window] > 64) == (words == 2))
            for i in range(0, len(of_size), ALIGNED):
                part = of_size[i : i + ALIGNED]
                self._align(body, limits, window[part], low[part], text[part], best)

    def _grams(self, at: np.ndarray, slot: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places whose hash is indexed, and the hash's number; ``slot`` has its first bits."""
        known = self.index.hashes
        gram = self.slots[slot].astype(np.int64)
        right = known[gram] == hashes
        for _ in range(1, self.chain):
            rest = np.flatnonzero(~right)
            rest = rest[gram[rest] + 1 < self.slots[slot[rest] + 1]]
            gram[rest] += 1
            right[rest] = known[gram[rest]] == hashes[rest]
        return at[right], gram[right]

    def _slab(self, starts: np.ndarray, first: int, spot: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands to align: the window, where it would begin in the text, and the text.

        ``spot`` counts from ``first``.
        """
        near = self._near(spot, place)
        kept = np.flatnonzero(near >= self.enough.take(place))
        spot, place, near = spot.take(kept).astype(np.int64) + first, place.take(kept).astype(np.int64), near.take(kept)
        parts = []
        for kind in self.kinds:
            held = np.flatnonzero(kind.held.take(place) & (near >= kind.least.take(place)))
            parts.append(self._bands(kind, starts, spot.take(held), place.take(held)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _bands(self, kind: Kind, starts: np.ndarray, spot: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for windows of one kind, from the shared q-grams that they hold."""
        index, none = self.index, (np.zeros(0, dtype=np.int64),) * 3
        if not len(spot):
            return none
        # Band j covers diagonals (most + 1) * j … (most + 1) * (j + 2) - 1; in one of them all
        # q-grams of a match lie. Those that have too few others near them cannot belong to one.
        base = int(spot[0])
        band = (spot - place - base + len(index.holder_firsts)) // (kind.most + 1)
        room = int(spot[-1]) - base + kind.span + 1
        bits = max(len(spot) - 1, 1).bit_length()
        key = band * room + (spot - base)
        if (int(key.max()) + 1) >> (62 - bits):
            order = np.argsort(np.concatenate([key, key - room]), kind="stable")
            entry = np.where(order < len(spot), order, order - len(spot))
            key = np.where(order < len(spot), key[entry], key[entry] - room)
        else:
            # Key and entry in one number sort faster than by their order.
            both = (key << bits) + np.arange(len(spot))
            both = np.sort(np.concatenate([both, both - (room << bits)]))
            key, entry = both >> bits, both & ((1 << bits) - 1)
        ahead = np.arange(len(key)) + kind.least[place[entry]] - 1
        close = ahead < len(key)
        close &= key[np.minimum(ahead, len(key) - 1)] - key <= kind.span
        begins = np.flatnonzero(close)
        if not len(begins):
            return none
        marks = np.bincount(begins, minlength=len(key) + 1)
        marks = marks - np.bincount(np.searchsorted(key, key[begins] + kind.span, side="right"), minlength=len(key) + 1)
        chosen = np.zeros(len(spot), dtype=bool)
        chosen[entry[np.cumsum(marks[:-1]) > 0]] = True
        spot, place = spot[chosen], place[chosen]
        # The same per window with its own band, each place of the window counted once.
        count = kind.firsts[place + 1] - kind.firsts[place]
        window = kind.holders[spread(kind.firsts[place], count)]
        within = np.repeat(place, count) - index.begin[window]
        diagonal = np.repeat(spot, count) - base - within + self.span
        band = diagonal // (index.edits[window] + 1)
        slots = room + 2 * self.span + 2
        widest = LONG[0]
        key = ((window * slots + band) * widest + within)
        pairs, _ = distinct(np.concatenate([key, key[band > 0] - widest]))
        bands, shared = distinct(pairs // widest)
        window, band = np.divmod(bands, slots)
        kept = shared >= index.bound[window]
        window, band = window[kept], band[kept]
        low = band * (index.edits[window] + 1) - self.span + base
        text = np.clip(np.searchsorted(starts, low + self.lengths[window] // 2, side="right") - 1, 0, len(starts) - 1)
        return window, low - text * self.apart, text

    def _near(self, spot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many the fullest two by two cells (of text places and diagonals) around each shared q-gram hold.

        A cell counts up to ``full``.
        """
        fine, coarse = self.cell
        ratio = 1 << (coarse - fine)
        row = spot >> coarse
        # Diagonals count from the first one that the row can have.
        wide = (len(self.least) >> fine) + 3 * ratio + 4
        high = int(row[-1]) + 1
        if high * wide >= 1 << 31:
            spot, row = spot.astype(np.int64), row.astype(np.int64)
        cell = spot - place
        cell += len(self.least)
        cell >>= fine
        row *= wide - ratio
        cell += row
        cell += ratio + 1
        cell = cell.astype(np.int64, copy=False)
        held = np.zeros((high + 2, wide), dtype=self.counter)
        held[1:-1] = np.minimum(np.bincount(cell, minlength=high * wide), self.full).reshape(high, wide)
        pairs = held.copy()
        pairs[:, :-1] += held[:, 1:]
        # Boxes begin at a row and a diagonal; the next row counts its diagonals from ``ratio`` later.
        boxes = pairs.copy()
        boxes[:-1, ratio:] += pairs[1:, :-ratio]
        most = boxes.copy()
        np.maximum(most[1:, :-ratio], boxes[:-1, ratio:], out=most[1:, :-ratio])
        best = most.copy()
        np.maximum(best[:, 1:], most[:, :-1], out=best[:, 1:])
        return best[1:-1].reshape(-1).take(cell)

    def _align(self, body: np.ndarray, limits: np.ndarray, window: np.ndarray, low: np.ndarray, text: np.ndarray, best: dict) -> None:
        edits, lengths = self.index.edits[window], self.lengths[window]
        begin = low - edits
        # Two bands of diagonals, the window's length, and the edits either side.
        places = begin[:, None] + np.arange(int((lengths + 4 * edits + 2).max()))
        inside = (places >= limits[text][:, None]) & (places < limits[text + 1][:, None])
        regions = np.where(inside, body[np.clip(places, 0, len(body) - 1)], np.uint8(254))
        least, end = distances([self.index.windows[w] for w in window.tolist()], regions)
        for i in np.flatnonzero(least <= edits).tolist():
            row = int(text[i])
            after = min(max(int(begin[i] + end[i]), int(limits[row]) + 1), int(limits[row + 1]))
            start = max(after - int(lengths[i]), int(limits[row]))
            found = (-int(lengths[i]), int(least[i]), start, after)
            at = (row, int(self.index.window_item[window[i]]))
            if at not in best or found < best[at]:
                best[at] = found


def flag(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", leaks: str = "leaks") -> DataFrame:
    """``documents`` with ``leaks``: per item found, its name, edits, first byte and length.

    Names are the item ids as text. An item counts as found if a window of it (the whole item, if
    shorter) lies in the text within the edit budget; of its windows the longest that passes is
    reported, then the one of fewest edits. A-Z is folded, a run of white space equals a space.
    Items shorter than a q-gram count as found wherever they occur verbatim. NULL
    and empty texts have no leaks; a column named ``leaks`` is replaced. Items are looked for in
    passes of about PASS_BYTES, so a larger benchmark costs more scans, not more memory.
    """
    (size_name,) = fresh(benchmark, "size")
    sized = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("body"))
    sized = sized.filter("item IS NOT NULL AND body IS NOT NULL").withColumn(size_name, F.octet_length("body"))
    total = sized.agg(F.sum(size_name).alias("n")).first()["n"] or 0
    passes = -(-total // PASS_BYTES)
    out = documents.select(*without(documents, leaks)).withColumn(leaks, F.lit(None).cast(T.ArrayType(LEAK)))
    for turn in range(passes):
        part = sized.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn)
        rows = [(r["item"], r["body"]) for r in part.select("item", "body").toLocalIterator()]
        out = _scan(out, index_of(rows), text, leaks)
    return out.withColumn(leaks, F.coalesce(F.col(f"`{leaks}`"), F.array().cast(T.ArrayType(LEAK))))


def _scan(documents: DataFrame, index: Index, text: str, leaks: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item", pa.string()), ("edits", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for batch in batches:
            known = batch.column(leaks).to_pylist()
            for first, data, offsets in grams.blocks(batch.column(text)):
                for row, found in finder.block(data, offsets).items():
                    made = [dict(zip(("item", "edits", "start", "length"), x, strict=True)) for x in found]
                    known[first + row] = (known[first + row] or []) + made
            columns = [pa.array(known, kind) if n == leaks else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(tidy(run), documents.schema)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """``documents`` without those that hold a benchmark passage."""
    (mark,) = fresh(documents, "leaks")
    flagged = flag(documents, benchmark, text, leaks=mark, **names)
    return flagged.filter(F.size(F.col(mark)) == 0).drop(mark)
