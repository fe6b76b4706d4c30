"""Files in ranges: records against the whole file's, any range size, long files and odd quotes."""

import csv
import hashlib
import io
import os
import random

import pytest

from tidewatch.sources import files
from tidewatch.sources.files import file_ranges, list_files, quoted_spans, read_records, read_rows


def odd_csv(rng, rows):
    """Cells with commas, quotes, line ends and signs of several bytes; quotes inside plain cells."""
    out = ["a,b,\"c\nd\""]
    for i in range(rows):
        cells = []
        for _ in range(3):
            kind = rng.randrange(7)
            text = "".join(rng.choice(["x", "é", "漢", " ", "7"]) for _ in range(rng.randrange(0, 9)))
            if kind == 0:
                text = '"' + text + rng.choice([",", "\n", "\r\n", '""', "\r", '"",""', '""\n""']) + text + '"'
            elif kind == 1:
                text = text + "5'" + '"' + text  # a quote in the middle of a plain cell
                text = "z" + text
            elif kind == 2:
                text = '""'
            cells.append(text)
        cells[0] = f"{i}"
        out.append(",".join(cells))
        if rng.random() < 0.05:
            out.append("")
    return rng.choice(["\n", "\r\n", "\r"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_records_do_not_depend_on_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(files, "STEP", 5)
    expected = {}
    for seed in range(3 if size < 7 else 12):
        text = ("\ufeff" if seed % 4 == 1 else "") + odd_csv(random.Random(seed), 12 if size < 7 else 60)
        path = str(tmp_path / f"{seed} a+b.csv")
        with open(path, "w", encoding="utf-8", newline="") as out:
            out.write(text)
        expected[path] = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if r]
    manifest = list_files(spark, str(tmp_path), size=size)
    assert manifest.where("file_error IS NOT NULL").count() == 0
    rows = read_records(spark, str(tmp_path), manifest, size=size).collect()
    for path, records in expected.items():
        found = [r["cells"] for r in sorted((r for r in rows if r["path"] == path), key=lambda r: r["row_id"])]
        assert found == records, path


def test_ranges_of_long_files_reach_the_parser_without_their_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(500)))
    (tmp_path / "short.csv").write_text("a,b\n1,y\n")
    manifest, taken = list_files(spark, str(tmp_path), size=100), []
    real = files._parse

    def seen(size):
        run = real(size)

        def checked(batches):
            def each():
                for batch in batches:
                    held = [len(c or b"") for c in batch.column("content").to_pylist()]
                    assert sum(held) < 100, held
                    yield batch

            yield from run(each())

        taken.append(size)
        return checked

    monkeypatch.setattr(files, "_parse", seen)
    rows = read_records(spark, str(tmp_path), manifest, size=100)
    assert rows.count() == 503 and taken == [100]


def test_spans_of_stray_quotes():
    assert quoted_spans(b'a"b,c"d\n', b"", False)[1] is False
    assert quoted_spans(b'a"",b\n', b"", False)[1] is False
    assert quoted_spans(b'x,"a""b', b"", False)[1] is True
    assert quoted_spans(b'"b","', b'"', False)[1] is True  # goes on behind a doubled quote
    assert quoted_spans(b"", b"", True)[1] is True


def test_fingerprints_of_long_files(spark, tmp_path):
    """A file is hashed and checked in pieces as it would be as a whole."""
    texts = {
        "plain.csv": b"a,b\n" + b"1,2\n" * 500,
        "wide.csv": "é,漢\n".encode() * 300,
        "broken.csv": b"a,b\n" + b"x" * 100 + b"\xff\n" * 10,
        "blank.csv": b"\n\r\n   \n" + b"1,2\n" * 100,
        "late.csv": b"\n" * 90 + b"a\n1\n",
        "cut.csv": b"a\n" + "é".encode()[:1],
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    whole, pieces = (
        {r["file_name"]: (r["bytes"], r["content_hash"], r["file_error"]) for r in list_files(spark, str(tmp_path), size=s).collect()}
        for s in (1 << 20, 16)
    )
    assert whole == pieces
    assert {n: v[1] for n, v in whole.items()} == {n: hashlib.sha256(t).hexdigest() for n, t in texts.items()}
    assert {n for n, v in whole.items() if v[2]} == {"broken.csv", "blank.csv", "cut.csv"}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(b"a,b\n" + b"1,2\n" * 20_000)
    ranges = file_ranges(spark, str(tmp_path), size=4096)
    assert ranges.count() == 20 and ranges.rdd.getNumPartitions() > 10
    kept = b"".join(r["content"] for r in ranges.orderBy("number").collect())
    assert kept == (tmp_path / "one.csv").read_bytes()
    rows = read_rows(spark, list_files(spark, str(tmp_path), size=4096), str(tmp_path), size=4096)
    assert rows.count() == 20_000 and rows.where("malformed").count() == 0


def test_a_header_longer_than_any_prefix(spark, tmp_path):
    names = [f"column {i} " + "x" * 100 for i in range(12_000)]
    assert sum(map(len, names)) > 1 << 20
    (tmp_path / "wide.csv").write_text('"a\nb",' + ",".join(names) + "\n" + ",".join("1" for _ in range(12_001)) + "\n")
    row = read_rows(spark, list_files(spark, str(tmp_path)), str(tmp_path)).first()
    assert len(row["cells"]) == 12_001 and row["cells"]["a\nb"] == "1" and not row["malformed"]


def test_a_file_of_three_gigabytes_beside_small_ones(spark, tmp_path, monkeypatch):
    """Nothing of its size is held: it is hashed in pieces, and its endless record refused."""
    monkeypatch.setattr(files, "RECORD_BYTES", 1 << 20)
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    with open(tmp_path / "large.csv", "wb") as out:
        out.write(b"a,b\n")
        out.truncate(3 << 30)
    manifest = list_files(spark, str(tmp_path))
    found = {r["file_name"]: r for r in manifest.collect()}
    assert found["large.csv"]["bytes"] == 3 << 30 and found["large.csv"]["file_error"] is None
    digest = hashlib.sha256(b"a,b\n")
    for _ in range(0, (3 << 30) - 4, 1 << 26):
        digest.update(bytes(min(1 << 26, (3 << 30) - 4 - _)))
    assert found["large.csv"]["content_hash"] == digest.hexdigest()
    rows = read_rows(spark, manifest, str(tmp_path), size=64 << 20).collect()
    small, large = ([r for r in rows if os.path.basename(r["path"]) == n] for n in ("small.csv", "large.csv"))
    assert [r["cells"] for r in small] == [{"a": "1", "b": "2"}] and not small[0]["malformed"]
    assert large and all(r["malformed"] for r in large)
