"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder, small_batches  # noqa: F401


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has (Spark ignores case in names)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def without(df: DataFrame, *names: str) -> list[Column]:
    """Columns of ``df`` except those that an operator is about to set."""
    out = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]


def text_of(column: str | Column) -> Column:
    """A text cell as it is, or the empty text for NULL."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Slots of the bitmap that ``thinned`` sends to the scan, 32 bits each.
BITMAP_WORDS = 1 << 15


def thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is among the first column of ``wanted``; without NULL keys.

    A bitmap of fixed size, whatever the input, drops most other rows before the join shuffles
    them; the rest is dropped by the join itself.
    """
    name = wanted.columns[0]
    bit = F.pmod(F.xxhash64(F.col(name)), F.lit(BITMAP_WORDS * 32)).cast("int")
    set_bits = wanted.select(bit.alias("bit")).groupBy(F.expr("bit div 32").cast("int").alias("slot"))
    table = [0] * BITMAP_WORDS
    for row in set_bits.agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits")).collect():
        table[row["slot"]] = row["bits"]
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")
    own = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_WORDS * 32)).cast("int")
    held = F.get(known, F.shiftright(own, 5))
    hit = F.call_function("shiftrightunsigned", held, own.bitwiseAND(F.lit(31))).bitwiseAND(F.lit(1)) == 1
    return rows.filter(hit).join(wanted.select(F.col(name).alias(key)).distinct(), key)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a checkpoint in columns.

    Far smaller on disk than a checkpoint of rows where columns compress or repeat.
    """
    place = shared_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps that nothing refers to any more.

    Spark's cleaner acts when the driver collects its garbage, which it otherwise does too seldom
    to keep the disk use of several large steps from adding up. Free memory of the driver's Python
    goes back to the system as well.
    """
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return memory that this process holds but does not use to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, giving free memory back after the last batch of each task.

    Workers outlive their tasks: what allocators keep would otherwise stay beside later stages.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
