import math
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import license_scan, queries

SF = "/root/testdata/sf0.01"


def brute_cosine(words, texts, frequency):
    """Dense cosine of a bag of words with every template."""
    bags = [Counter(license_scan.terms_of(b)) for _, b in license_scan.TEMPLATES]
    known = {t for bag in bags for t in bag}
    weight = lambda t: math.log((1 + texts) / (1 + frequency.get(t, 0) if t in known else 2)) + 1
    own = Counter(words)
    best = (0.0, None)
    for (name, _), bag in zip(license_scan.TEMPLATES, bags, strict=True):
        dot = sum(own[t] * bag[t] * weight(t) ** 2 for t in bag)
        norm = math.sqrt(sum((n * weight(t)) ** 2 for t, n in own.items()) * sum((n * weight(t)) ** 2 for t, n in bag.items()))
        if norm and dot / norm > best[0] + 1e-12:
            best = (dot / norm, name)
    return best


def test_lines_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    total, frequency = license_scan.frequencies(documents)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    terms = {t for _, b in license_scan.TEMPLATES for t in license_scan.terms_of(b)}
    counted = Counter(t for text in texts.values() for t in terms.intersection(license_scan.terms_of(text)))
    assert total == len(texts) and {t: n for t, n in frequency.items() if n} == dict(counted)
    found = {r["doc_id"]: r for r in license_scan.scan(documents).collect()}
    for key, text in texts.items():
        lines = [brute_cosine(license_scan.terms_of(x), total, frequency) for x in text.split("\n")]
        best = max(lines, key=lambda x: x[0])
        if best[0] >= license_scan.LEAST_COSINE + 1e-6:
            assert found[key]["own_license"] == best[1] and math.isclose(found[key]["cosine"], best[0], abs_tol=1e-5)
        elif not found[key]["license_file"]:
            assert found[key]["own_license"] is None
    assert sum(r["own_license"] is not None for r in found.values()) > 10


def test_nearest_ancestor(spark):
    schema = "path string, own_license string, license_file boolean, place int, license int"
    rows = [
        ("", "MIT", True, 1, 1),
        ("a", None, False, 1, 1),
        ("a/b", "GPL-3.0", True, 1, 1),
        ("a/b", "MIT", True, 1, 1),
        ("a/b", "GPL-3.0", True, 1, 1),
        ("a/b/c/d", None, False, 1, 1),
        ("a/bc", None, False, 1, 1),
        ("a/b/c", "BSD-3-Clause", False, 1, 1),
        (None, None, False, None, None),
    ]
    out = license_scan.inherit(spark.createDataFrame(rows, schema), F.col("path"))
    found = Counter((r["path"], r["license"], r["license_from"]) for r in out.collect())
    assert found == Counter(
        [
            ("", "MIT", ""),
            ("a", "MIT", ""),
            ("a/b", "GPL-3.0", "a/b"),
            ("a/b", "MIT", "a/b"),
            ("a/b", "GPL-3.0", "a/b"),
            ("a/b/c/d", "GPL-3.0", "a/b"),
            ("a/bc", "MIT", ""),
            ("a/b/c", "BSD-3-Clause", "a/b/c"),
            (None, "MIT", ""),
        ]
    )


def test_odd_texts(spark):
    schema = "doc_id long, text string, cosine string, place string"
    mit = "Released under the MIT License."
    rows = [(1, None, "c", "p"), (2, "", "c", "p"), (3, mit, "c", "p"), (3, mit, "c", "p"), (None, f"{'word ' * 30000}\n{mit}", None, None), (4, "the license of the version", "c", "p"), (5, "Released under\nthe MIT\nLicense.", "c", "p")]
    out = license_scan.scan(spark.createDataFrame(rows, schema))
    found = {r["doc_id"]: (r["own_license"], r["license_line"], r["license_file"]) for r in out.collect()}
    assert found == {1: (None, -1, False), 2: (None, -1, False), 3: ("MIT", 0, True), None: ("MIT", 1, False), 4: (None, -1, False), 5: ("MIT", 0, True)}
    assert out.count() == 7 and out.columns.count("cosine") == 1
    empty = license_scan.scan(spark.createDataFrame([], schema))
    assert license_scan.inherit(empty, F.lit("a")).collect() == []


def test_query_covers_every_document(spark):
    rows = queries.QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
