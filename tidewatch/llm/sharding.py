"""Proportional stratified interleaving: shards of equal row counts with the mixture of the whole.

Rows are shuffled by a seeded hash within their source. Row ``r`` of a source of ``n`` rows gets
the fractional rank ``(2r - 1) / 2n``. Sorted by it, every stretch of the sequence holds each
source in its overall proportion, so cutting the sequence into equal pieces gives shards that
match the mixture to within a row or so per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import without
from tidewatch.operators.cumulative import running_totals

SHARDS = 24
SEED = 17
#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def interleave(
    rows: DataFrame, stratum: str = "source", key: str = "doc_id", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Row counts of the shards differ by one at most. Both ranks come from running totals over a
    range-partitioned order, so neither a source with a third of all rows nor the whole sequence
    meets in one task. All columns of ``rows`` are carried; columns named ``shard`` or ``slot``
    are replaced. NULL sources form a source of their own, NULL keys sort first, repeated rows
    are told apart by their contents, and fully equal rows take neighbouring places in either
    order. An empty table gives an empty table. Map columns cannot be carried.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    packed = rows.select(
        F.col(f"`{stratum}`").alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))).alias("dice"),
        F.struct(*without(rows, "shard", "slot")).alias("kept"),
        F.lit(1).cast("long").alias("one"),
    )
    order = ["dice", "kept"]
    ranked = running_totals(packed, ["stratum"], order, ["one"])
    placed = ranked.select(
        ((2 * F.col("cum_one") - 1) / (2 * F.col("all_one"))).alias("fraction"), *order, "one"
    )
    whole = running_totals(placed, [], ["fraction", *order], ["one"], few_groups=True)
    position, total = F.col("cum_one") - 1, F.col("all_one")
    return whole.select(
        "kept", F.expr(f"(cum_one - 1) * {shards} div all_one").alias("shard"), position.alias("position"), total.alias("total")
    ).select(
        "kept.*",
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"),
    )


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (UTF-8 bytes plus 8) and ``text_crc32`` of every row.

    A NULL text counts as empty: size 8, checksum 0.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return documents.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.col(f"`{stratum}`").alias("source"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
