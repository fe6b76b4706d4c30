"""License scan: sparse TF-IDF cosine against templates, and inheritance from directories.

Lines of a text are its headers; a text that consists of little else is a licence file of its
directory. Both are compared with the templates by the cosine of sparse TF-IDF vectors, whose
weights come from all texts. What holds no licence of its own takes that of the nearest ancestor
directory with a licence file, found by joins on paths.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import fresh, without

#: Names and wordings of the templates. The usual notices of these licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]
#: Cosine from which a line or a text is taken for a template's licence.
LEAST_COSINE = 0.8
#: A text with at most this many words besides its licence lines is a licence file.
FILE_WORDS = 40
TERM = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")


def terms_of(text: str) -> list[str]:
    """Lower-cased words and numbers; inner dots and hyphens belong to them."""
    return TERM.findall(text.lower())


class Scanner:
    """Cosines of texts with the templates under given document frequencies."""

    def __init__(self, texts: int, frequency: dict[str, int], templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.bags = [Counter(terms_of(body)) for _, body in templates]
        self.terms = sorted({t for bag in self.bags for t in bag})
        #: A word that no template has weighs as if one text had it.
        self.other = math.log((1 + texts) / 2) + 1
        self.idf = {t: math.log((1 + texts) / (1 + frequency.get(t, 0))) + 1 for t in self.terms}
        self.norms = [math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in sorted(bag.items()))) for bag in self.bags]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(self.bags):
            for term, n in sorted(bag.items()):
                self.postings.setdefault(term, []).append((i, n * self.idf[term]))
        self.anchors = self._anchors()

    def _anchors(self) -> set[str]:
        """Terms of which every line that reaches the cosine has one.

        Without them a line can share no more with a template than the rest of its terms, whose
        share of the template's norm bounds the cosine.
        """
        chosen: set[str] = set()
        for bag, norm in zip(self.bags, self.norms, strict=True):
            rest = sorted(bag, key=lambda t: (-bag[t] * self.idf[t], t))
            left = norm**2
            for term in rest:
                if math.sqrt(max(left, 0)) / norm < LEAST_COSINE:
                    break
                chosen.add(term)
                left -= (bag[term] * self.idf[term]) ** 2
        return chosen

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """The highest cosine of a bag of words and its template; ties to the first one."""
        bag = Counter(words)
        dots: dict[int, float] = {}
        square = 0.0
        for term, n in sorted(bag.items()):
            weight = n * self.idf.get(term, self.other)
            square += weight * weight
            for i, other in self.postings.get(term, ()):
                dots[i] = dots.get(i, 0.0) + weight * other
        if not dots:
            return 0.0, None
        cosine, at = max((dot / (self.norms[i] * math.sqrt(square)), -i) for i, dot in dots.items())
        return round(cosine, 6), self.names[-at]

    def scan(self, text: str | None) -> tuple[str | None, float, int, bool]:
        """Licence, cosine, line number and whether the text is a licence file."""
        lines = (text or "").split("\n")
        lowered = (text or "").lower()
        if not any(a in lowered for a in self.anchors):
            return None, 0.0, -1, False
        found: tuple[float, int, str] | None = None
        other = 0
        for number, line in enumerate(lines):
            words = terms_of(line) if any(a in line.lower() for a in self.anchors) else None
            cosine, name = self.best(words) if words else (0.0, None)
            if name is not None and cosine >= LEAST_COSINE:
                if found is None or cosine > found[0]:
                    found = (cosine, number, name)
            else:
                other += len(line.split())
        if found is None:
            cosine, name = self.best(terms_of(text or ""))
            return (name, cosine, 0, True) if name is not None and cosine >= LEAST_COSINE else (None, 0.0, -1, False)
        return found[2], found[0], found[1], other <= FILE_WORDS


def frequencies(documents: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of texts, and how many hold each template term. One row per term is collected."""
    terms = sorted({t for _, body in templates for t in terms_of(body)})
    known = set(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter = Counter()
        total = 0
        for batch in batches:
            total += batch.num_rows
            for cell in batch.column(0).to_pylist():
                lowered = (cell or "").lower()
                held = [t for t in terms if t in lowered]
                if held:
                    uses.update(known.intersection(TERM.findall(lowered)))
        yield pa.RecordBatch.from_arrays([pa.array([*uses, ""], pa.string()), pa.array([*uses.values(), total], pa.int64())], names=["term", "uses"])

    counted = documents.select(F.col(f"`{text}`")).mapInArrow(count, "term string, uses long")
    sums = {r["term"]: r["uses"] for r in counted.groupBy("term").agg(F.sum("uses").alias("uses")).collect()}
    return sums.pop("", 0), sums


def scan(documents: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``documents`` with ``own_license``, ``cosine``, ``license_line`` and ``license_file``.

    NULL and empty texts, and those where no line reaches the cosine, have no licence, cosine 0
    and line -1. Columns of these names are replaced.
    """
    scanner = Scanner(*frequencies(documents, text, templates), templates)
    added = [("own_license", T.StringType(), pa.string()), ("cosine", T.DoubleType(), pa.float64()), ("license_line", T.IntegerType(), pa.int32()), ("license_file", T.BooleanType(), pa.bool_())]
    kept = documents.select(*without(documents, *[n for n, _, _ in added]))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t, _ in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [scanner.scan(cell) for cell in batch.column(text).to_pylist()]
            columns = list(zip(*cells, strict=True)) if cells else [()] * 4
            arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *[n for n, _, _ in added]])

    return kept.mapInArrow(run, schema)


def inherit(scanned: DataFrame, directory: Column) -> DataFrame:
    """``scanned`` with ``license`` and ``license_from``.

    ``directory`` is the path of a row's folder, parts joined by ``/``. A row's own licence comes
    first (``license_from`` is its own directory). Else it takes the licence of the nearest
    directory, its own or an ancestor, with a licence file; the root is the empty path. Of several licence files of one
    directory the most frequent licence counts, then the first by name. NULL paths are the root.
    The nearest ancestor is found once per directory, so a directory with a third of all rows
    adds one row to that search; rows meet its result in a plain join that adaptive execution
    splits.
    """
    (place,) = fresh(scanned, "place")
    kept = scanned.select(*without(scanned, "license", "license_from"), F.coalesce(directory, F.lit("")).alias(place))
    files = kept.filter("license_file").groupBy(F.col(place).alias("dir"), "own_license").agg(F.count("*").alias("files"))
    order = Window.partitionBy("dir").orderBy(F.col("files").desc(), "own_license")
    files = files.withColumn("turn", F.row_number().over(order)).filter("turn = 1").select(F.col("dir").alias("ancestor"), F.col("own_license").alias("granted"))
    parts = F.split(F.col("dir"), "/")
    # A path of d parts has d + 1 ancestors with itself and the root.
    steps = kept.select(F.col(place).alias("dir")).distinct().select(
        "dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")
    )
    ancestors = steps.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("ancestor"))
    nearest = ancestors.join(files, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "granted")).alias("best"))
    nearest = nearest.select(F.col("dir").alias(place), F.col("best.ancestor").alias("from_dir"), F.col("best.granted").alias("granted"))
    joined = kept.join(nearest, place, "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        *without(scanned, "license", "license_from"),
        F.coalesce("own_license", "granted").alias("license"),
        F.when(own, F.col(place)).otherwise(F.col("from_dir")).alias("license_from"),
    )
