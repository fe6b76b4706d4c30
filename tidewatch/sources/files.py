"""Uploaded CSV files of any size: manifest with fingerprints, and their rows as maps of text cells.

A file is read in *ranges* of bounded length, each by its own task. Whether a range begins inside a
quoted cell follows from the ranges before it: every range tells how it ends for either beginning,
and one ordered pass over these facts (a few per file) gives all beginnings. A range then parses the
records that begin in it, reading on into the next ones for the end of its last record. Files of one
range are read by Spark; longer ones by Arrow's file systems, which executors must be able to open.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import null_if_missing
from tidewatch.session import as_small_side, cut_lineage

# Ship these functions with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The usual upload limit and the messages of the file rules, in order.
UPLOAD_LIMIT = 10 * 1024 * 1024
ONLY_CSV = "Only CSV files are supported."
EMPTY_FILE = "The uploaded CSV file is empty."
TOO_LARGE = "The uploaded CSV exceeds the 10 MB size limit."
UNREADABLE = "The uploaded file is not a valid readable CSV."
NO_ROWS = "The CSV must contain at least one data row."

#: Bytes of a range, and of a read while a long file is hashed.
RANGE = 8 << 20
#: Bytes read at a time for the end of a record, and bytes beyond its range a record may have; a file
#: with a longer one is unreadable.
STEP = 1 << 16
RECORD_BYTES = 256 << 20

ROW_SCHEMA = "path STRING, row_id BIGINT, malformed BOOLEAN, cells MAP<STRING, STRING>"


def plain_path(path: Column) -> Column:
    """A file path without its scheme, so that listings and row metadata agree."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def _listing(spark: SparkSession, files: str | list[str], max_bytes: int | None) -> DataFrame:
    """Spark's listing of a folder, a glob, or a list of paths that the caller bounds.

    Content is read only where a query asks for it. With ``max_bytes``, longer files are left out.
    """
    found = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(files)
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    return found.withColumns({"uri": F.col("path"), "path": plain_path(F.col("path"))})


def _opened(uri: str):
    """A file opened for reading at any place."""
    if re.match(r"[a-z][a-z0-9+.-]+:", uri) and not uri.startswith("file:"):
        system, place = fs.FileSystem.from_uri(uri)
        return system.open_input_file(place)
    return open(uri, "rb")


def _place(path: Column, uri: Column) -> Column:
    """What ``_opened`` takes: a plain path for local files."""
    return F.when(uri.startswith("file:") | uri.startswith("/"), path).otherwise(uri)


def _range(place: str, number: int, size: int) -> tuple[bytes, bytes]:
    """The byte before a range of a file, and its bytes."""
    with _opened(place) as file:
        file.seek(max(number * size - 1, 0))
        before = file.read(1) if number else b""
        return before, file.read(size)


def _read_ranges(size: int):
    """Rows (path, place, number, count) with the bytes of the range and the byte before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place, number, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, content = _range(place, number, size)
                columns = [[path], [place], [number], [count], [before], [content]]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                arrays = [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "place", "number", "count", "before", "content"])

    return run


def _short_ranges(listed: DataFrame, size: int) -> DataFrame:
    """Files of one range, read by Spark."""
    place, one = _place(F.col("path"), F.col("uri")).alias("place"), F.lit(1).cast("long").alias("count")
    short = listed.where(F.col("length") <= size)
    return short.select("path", place, F.lit(0).cast("long").alias("number"), one, F.lit(b"").alias("before"), "content")


def _long_ranges(listed: DataFrame, size: int) -> DataFrame:
    """``path, place, number, count`` of the ranges of longer files, dealt out one by one, so that the
    ranges of one file are read by many tasks."""
    place, count = _place(F.col("path"), F.col("uri")).alias("place"), F.expr(f"(length + {size - 1}) div {size}")
    long = listed.where(F.col("length") > size).select("path", place, count.alias("count"))
    ranges = long.select("path", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("number"), "count")
    return ranges.repartition(listed.sparkSession.sparkContext.defaultParallelism * 4, "path", "number")


def file_ranges(spark: SparkSession, files: str | list[str], max_bytes: int | None = None, size: int = RANGE) -> DataFrame:
    """``path, place, number, count, before, content``: the bytes of the files in ranges of ``size``."""
    listed = _listing(spark, files, max_bytes)
    schema = "path string, place string, number long, count long, before binary, content binary"
    return _short_ranges(listed, size).unionByName(_long_ranges(listed, size).mapInArrow(_read_ranges(size), schema))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, place) with hash, validity of the text and whether the first line is blank.

    A file passes through one task, because its hash depends on all bytes in order, in pieces.
    """
    for batch in batches:
        out = []
        for path, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest, text = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
            is_text, blank, decided = True, True, False
            with _opened(place) as file:
                while piece := file.read(RANGE):
                    digest.update(piece)
                    try:
                        line = text.decode(piece)
                    except UnicodeDecodeError:
                        is_text, line = False, ""
                        text = codecs.getincrementaldecoder("utf-8")("replace")
                    if not decided:
                        line = line.lstrip("\r\n\ufeff") if blank else line
                        head = re.match(r"[^\r\n]*", line).group()
                        blank = blank and not head.strip(" ")
                        decided = len(head) < len(line) or not blank
            try:
                text.decode(b"", True)
            except UnicodeDecodeError:
                is_text = False
            out.append((path, digest.hexdigest(), is_text, blank))
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_()]
        arrays = [pa.array(list(v), k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "content_hash", "is_text", "blank"])


def list_files(spark: SparkSession, files: str | list[str], max_bytes: int | None = None, size: int = RANGE) -> DataFrame:
    """One row per file: name, size, content hash and the first broken file rule.

    Files of one range are hashed where Spark reads them, longer ones by one reader each in pieces of
    bounded size. ``max_bytes`` is for callers who want to refuse larger files (``UPLOAD_LIMIT`` is
    the usual choice); by default no file is too large. The result is written once because both the
    fingerprint guard and the reader use it.
    """
    every = _listing(spark, files, None).select("path", "uri", F.col("length").alias("bytes"))
    judged = _listing(spark, files, max_bytes)
    text = F.col("content").cast("string")
    first_line = F.regexp_extract(F.make_valid_utf8(text), r"^[\r\n\uFEFF]*([^\r\n]*)", 1)
    short = judged.where(F.col("length") <= size).select(
        "path", F.sha2("content", 256).alias("content_hash"), F.is_valid_utf8(text).alias("is_text"), (F.trim(first_line) == "").alias("blank")
    )
    long = judged.where(F.col("length") > size).select("path", _place(F.col("path"), F.col("uri")).alias("place"))
    spread = long.repartition(spark.sparkContext.defaultParallelism, "path")
    facts = short.unionByName(spread.mapInArrow(_fingerprints, "path string, content_hash string, is_text boolean, blank boolean"))
    name = F.element_at(F.split("path", "/"), -1)
    listed = every.select("path", name.alias("file_name"), "bytes").join(facts, "path", "left")
    too_large = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    problem = (
        F.when(~F.lower("file_name").endswith(".csv"), ONLY_CSV)
        .when(F.col("bytes") == 0, EMPTY_FILE)
        .when(too_large, TOO_LARGE)
        .when(F.col("blank") | ~F.col("is_text"), UNREADABLE)
    )
    return cut_lineage(listed.withColumn("file_error", problem).drop("is_text", "blank"))


# --- records ----------------------------------------------------------------------------

QUOTE = 0x22
#: Bytes after which a cell may begin, or a quoted one go on after a doubled quote.
OPENERS = np.zeros(256, dtype=bool)
OPENERS[[0x0A, 0x0D, 0x2C, QUOTE]] = True


def quoted_spans(content: bytes, before: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that open or close cells, in turns, and whether the end lies inside a cell.

    A quote opens a cell only where a cell begins; elsewhere outside it is a sign like others.
    """
    data = np.frombuffer(content, dtype=np.uint8)
    quotes = np.flatnonzero(data == QUOTE)
    last = np.frombuffer(before, dtype=np.uint8)
    at_start = not len(last) or bool(OPENERS[last[-1]])
    opens = np.where(quotes > 0, OPENERS[data[quotes - 1]], at_start) if len(quotes) else np.zeros(0, dtype=bool)
    if len(quotes) and not len(last) and content.startswith(codecs.BOM_UTF8) and quotes[0] == 3:
        opens[0] = True
    first = 1 if inside else 0
    if opens[first::2].all():
        return quotes, inside ^ bool(len(quotes) & 1)
    kept = []
    for place, fits in zip(quotes.tolist(), opens.tolist(), strict=True):
        # A quote beside one that was no opener begins no cell either.
        fits = fits and not (place and data[place - 1] == QUOTE and not (kept and kept[-1] == place - 1))
        if inside or fits:
            kept.append(place)
            inside = not inside
    return np.array(kept, dtype=np.int64), inside


def _ends(size: int):
    """Whether a range (path, place, number) ends inside a quoted cell, for either beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for place, number in zip(batch.column("place").to_pylist(), batch.column("number").to_pylist(), strict=True):
                before, content = _range(place, number, size)
                ends.append([quoted_spans(content, before, start)[1] for start in (False, True)])
            sides = [pa.array([e[i] for e in ends], pa.bool_()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("number"), *sides], names=["path", "number", "if_out", "if_in"])

    return run


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beginning of each range, from ranges in order."""
    path, inside = None, False
    for batch in batches:
        out = []
        for own, _, if_out, if_in in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            inside = inside and own == path
            path = own
            out.append(inside)
            inside = if_in if inside else if_out
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("number"), pa.array(out, pa.bool_())], names=["path", "number", "inside"])


def record_starts(content: bytes, before: bytes, inside: bool) -> tuple[int | None, bool]:
    """Where the first record of a range begins, and whether its end lies inside a quoted cell.

    A record begins at the start of the file or behind a line end outside of quoted cells.
    """
    quotes, ends_inside = quoted_spans(content, before, inside)
    if not before or (not inside and before in (b"\n", b"\r")):
        return 0, ends_inside
    data = np.frombuffer(content, dtype=np.uint8)
    for place in np.flatnonzero((data == 0x0A) | (data == 0x0D)):
        if inside == bool(np.searchsorted(quotes, place) & 1):
            return int(place) + 1, ends_inside
    return None, ends_inside


def _rest(place: str, start: int, last: bytes, inside: bool) -> bytes | None:
    """What the last record of a range has behind it, without its line end; None if that is too long."""
    pieces, size = [], 0
    with _opened(place) as file:
        file.seek(start)
        while piece := file.read(STEP):
            quotes, ends_inside = quoted_spans(piece, last, inside)
            data = np.frombuffer(piece, dtype=np.uint8)
            for at in np.flatnonzero((data == 0x0A) | (data == 0x0D)):
                if inside == bool(np.searchsorted(quotes, at) & 1):
                    return b"".join([*pieces, piece[:at]])
            pieces.append(piece)
            size += len(piece)
            if size > RECORD_BYTES:
                return None
            inside, last = ends_inside, piece[-1:]
    return b"".join(pieces)


def _parse(size: int):
    """Ranges with ``inside`` as records (path, row_id, cells); a record that is too long has no cells.

    Ranges without content are read here, one at a time, so that a batch of them holds no file's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for row in range(batch.num_rows):
                path, place, number, count, before, content, inside = (c[row].as_py() for c in batch.columns)
                if content is None:
                    before, content = _range(place, number, size)
                start, ends_inside = record_starts(content, before, inside)
                if start is None or start >= len(content):
                    continue
                if number < count - 1 and (ends_inside or content[-1:] not in (b"\n", b"\r")):
                    rest = _rest(place, (number + 1) * size, content[-1:], ends_inside)
                    if rest is None:
                        yield _records(path, [number << 33, number << 33 | 1], [[], []])
                        continue
                    content += rest
                text = content[start:].decode("utf-8", "replace")
                ids, cells = [], []
                for at, record in enumerate(csv.reader(io.StringIO(text if number else text.removeprefix("\ufeff"), newline=""))):
                    if record:
                        ids.append(number << 33 | at)
                        cells.append(record)
                    if len(ids) == 10_000:
                        yield _records(path, ids, cells)
                        ids, cells = [], []
                if ids:
                    yield _records(path, ids, cells)

    return run


def _records(path: str, ids: list[int], cells: list[list[str]]) -> pa.RecordBatch:
    arrays = [pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "row_id", "cells"])


def read_records(spark: SparkSession, files: str | list[str], paths: DataFrame, max_bytes: int | None = None, size: int = RANGE) -> DataFrame:
    """``path, row_id, cells`` of the records of the files in ``paths``; ids grow along a file."""
    wanted = as_small_side(paths.select("path").distinct())
    listed = _listing(spark, files, max_bytes)
    # Files of one range begin outside of any cell; only the others need the ordered pass.
    short = _short_ranges(listed, size).join(wanted, "path", "left_semi").withColumn("inside", F.lit(False))
    ranges = cut_lineage(_long_ranges(listed, size).join(wanted, "path", "left_semi"))
    several = ranges.select("path", "place", "number")
    ends = several.mapInArrow(_ends(size), "path string, number long, if_out boolean, if_in boolean")
    ordered = ends.repartition("path").sortWithinPartitions("path", "number")
    begins = as_small_side(ordered.mapInArrow(_begins, "path string, number long, inside boolean").where("inside"))
    none = F.lit(None).cast("binary")
    marked = ranges.join(begins, ["path", "number"], "left").select(
        "path", "place", "number", "count", none.alias("before"), none.alias("content"), F.coalesce("inside", F.lit(False)).alias("inside")
    )
    return short.unionByName(marked).mapInArrow(_parse(size), "path string, row_id long, cells array<string>")


def _names(header: Column) -> Column:
    """Column names of a parsed header row; repeated ones get ``.1``, ``.2``, blank ones a position."""
    named = F.transform(
        header, lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x)
    )

    def numbered(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x))
        return F.when(before > 0, F.concat(x, F.lit("."), before.cast("string"))).otherwise(x)

    return F.transform(named, numbered)


def read_rows(spark: SparkSession, manifest: DataFrame, files: str | list[str], max_bytes: int | None = None, size: int = RANGE) -> DataFrame:
    """Rows of the accepted files: path, row_id, malformed flag and the cells as a map.

    Files are parsed in ranges, whatever their headers; the header of a file is its first record,
    and rows meet it by path. The parsed rows are written once, so that nothing is parsed again.
    """
    accepted = manifest.where("file_error IS NULL")
    parsed = cut_lineage(read_records(spark, files, accepted, max_bytes, size))
    firsts = as_small_side(parsed.groupBy("path").agg(F.min("row_id").alias("row_id")))
    headers = parsed.join(firsts, ["path", "row_id"])
    first_name = F.regexp_replace(F.get("cells", F.lit(0)), "^\uFEFF", "")
    header = F.transform("cells", lambda x, i: F.when(i == 0, first_name).otherwise(x))
    headers = headers.select("path", F.col("row_id").alias("header_row"), _names(header).alias("names"))
    rows = parsed.join(as_small_side(headers), "path").where("row_id > header_row")
    # Too few cells leave the last ones empty, which is allowed; too many make a line unreadable.
    padded = F.transform("names", lambda _, i: null_if_missing(F.get("cells", i)))
    return rows.select(
        "path",
        "row_id",
        ((F.size("cells") > F.size("names")) | (F.size("cells") == 0)).alias("malformed"),
        F.map_from_arrays("names", padded).alias("cells"),
    )
