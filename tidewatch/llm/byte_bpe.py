"""Byte-level BPE by overlapping chunks.

Short texts are encoded where they lie. A text longer than a chunk is cut into overlapping
chunks that are pre-tokenised in parallel, each from its own first character. What the pattern
matches from a boundary on depends only on what follows, so once two neighbouring chunks share a
boundary inside their overlap they agree from there on: the text is cut at that boundary. A cut
never follows white space, because the pattern looks one character ahead there and would match
otherwise at the end of a piece. The pieces between cuts are encoded in parallel, and the ids of
a text are put together in order. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import fresh, text_of, tidy, without

#: Characters of a chunk, and characters that a chunk shares with the next one.
CHUNK = 32_768
OVERLAP = 512


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder per Python worker, without special tokens."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})


@lru_cache(maxsize=4)
def pieces_of(path: str) -> list[bytes]:
    known = vocabulary(path)
    table = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        table[rank] = token
    return table


def ids_of(text: str, path: str, pattern: str) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return encoder(path, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Where matches begin, up to the first match that the end of the chunk may have cut."""
    found = []
    for match in regex.finditer(pattern, text):
        found.append(match.start())
        if match.end() == len(text) and not last:
            break
    return found


def _small_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column`` (a longer cell alone)."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()])
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if len(sizes) > first:
        yield batch.slice(first)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, function) -> DataFrame:
    """``df`` with ``target`` = ``function`` of each cell of ``source``, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(target, kind)])

    def run(batches):
        for batch in batches:
            for part in _small_batches(batch, source):
                made = [function(x) for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, pa.binary() if kind == T.BinaryType() else pa.list_(pa.int32()))],
                    names=[*part.schema.names, target],
                )

    return df.mapInArrow(tidy(run), schema)


def encode(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with the binary column ``ids`` (little-endian unsigned 32-bit token ids).

    ``ranks`` is the place of the rank file on every machine. NULL and empty texts get no ids. A
    column of that name is replaced; all other columns are kept whatever their names. Equal long
    texts are encoded once. Where neighbouring chunks share no boundary in the overlap (a run of
    more than ``overlap`` characters without one), the rest of that text is one piece.
    """
    if overlap < 1 or chunk < overlap:
        raise ValueError("overlap must be between 1 and chunk")
    kept = docs.select(*without(docs, ids))
    body, sign = fresh(kept, "body", "sign")
    rows = kept.withColumn(body, text_of(f"`{text}`"))
    whole = F.char_length(F.col(body)) <= chunk
    short = _mapped(rows.filter(whole), body, ids, T.BinaryType(), lambda x: ids_of(x, ranks, pattern)).drop(body)
    long = rows.filter(~whole).withColumn(sign, F.sha2(body, 256)).drop(body)
    texts = rows.filter(~whole).select(F.sha2(body, 256).alias("sign"), F.col(body).alias("body"))
    done = _long_texts(texts.dropDuplicates(["sign"]), ranks, pattern, chunk, overlap)
    joined = long.join(done.select(F.col("sign").alias(sign), F.col("ids").alias(ids)), sign).drop(sign)
    return short.unionByName(joined)


def _long_texts(texts: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(sign, ids)`` of distinct long texts."""
    counted = texts.withColumn("last", ((F.char_length("body") - 1) / chunk).cast("int"))
    numbered = counted.select("sign", "body", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("no"))
    chunks = numbered.select(
        "sign", "no", (F.col("no") == F.col("last")).alias("final"), F.expr(f"substring(body, no * {chunk} + 1, {chunk + overlap})").alias("body")
    ).repartition("sign", "no")

    def mark(batches):
        for batch in batches:
            heads, tails = [], []
            for body, final in zip(batch.column("body").to_pylist(), batch.column("final").to_pylist(), strict=True):
                found = boundaries(body, pattern, final)
                heads.append([b for b in found if b < overlap])
                tails.append([b - chunk for b in found if b >= chunk and not body[b - 1].isspace()])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sign"), batch.column("no"), *lists], names=["sign", "no", "heads", "tails"]
            )

    marked = chunks.mapInArrow(tidy(mark), "sign string, no int, heads array<int>, tails array<int>")
    order = Window.partitionBy("sign").orderBy("no")
    before = F.lag("tails").over(order)
    cuts = marked.select(
        "sign",
        "no",
        F.when(F.col("no") == 0, F.lit(0)).otherwise(
            F.array_min(F.array_intersect(before, "heads")) + F.col("no") * F.lit(chunk).cast("long")
        ).alias("cut"),
    )
    # Cuts count up to the first missing one; a text's list has one number per chunk.
    usable = cuts.withColumn("sound", F.min(F.col("cut").isNotNull()).over(order)).filter("sound")
    listed = usable.groupBy("sign").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    pieces = (
        texts.join(listed, "sign")
        .select("sign", "body", "cuts", F.posexplode("cuts").alias("no", "cut"))
        .select(
            "sign",
            "no",
            F.expr("substring(body, cast(cut + 1 as int), cast(coalesce(try_element_at(cuts, no + 2), char_length(body)) - cut as int))").alias("body"),
        )
        .repartition("sign", "no")
    )
    coded = _mapped(pieces, "body", "ids", T.BinaryType(), lambda x: ids_of(x, ranks, pattern)).drop("body")

    def joined(key, table):
        ordered = table.sort_by("no").column("ids").to_pylist()
        return pa.table({"sign": pa.array([key[0].as_py()]), "ids": pa.array([b"".join(ordered)], pa.binary())})

    return coded.groupBy("sign").applyInArrow(joined, "sign string, ids binary")


def decode(rows: DataFrame, ranks: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``rows`` with the binary column ``raw``: the bytes of the ids, one after another.

    NULL ids give empty bytes. An id outside the vocabulary raises IndexError.
    """

    def bytes_of(cell: bytes | None) -> bytes:
        table = pieces_of(ranks)
        return b"".join([table[i] for i in np.frombuffer(cell or b"", dtype="<u4").tolist()])

    return _mapped(rows.select(*without(rows, raw)), ids, raw, T.BinaryType(), bytes_of)
