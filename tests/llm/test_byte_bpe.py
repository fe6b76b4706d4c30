import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def ids(text):
    whole = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary(text or "")
    return np.array(whole, dtype="<u4").tobytes()


def test_query_against_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.QUERIES["op2_byte_bpe"](spark, SF).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = ids(texts[row["doc_id"]])
        assert row["n_tokens"] == len(expected) // 4
        assert row["ids_sha256"] == hashlib.sha256(expected).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (16, 16), (50, 1)])
def test_chunks_stitch_to_the_whole(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = [None, "", "a", " ", "<|endoftext|>", "a" * 300, " " * 300 + "x", "\t\n " * 90, "word " * 200, "word " * 200, "it's we'll " * 60]
    texts += ["".join(rng.choice("ab  \n\t'é漢1!.") for _ in range(700)) for _ in range(8)]
    texts += ["".join(rng.choice([" ", "​", "\x1c", "　", " ", "a", "\r\n"]) for _ in range(400)) for _ in range(4)]
    rows = spark.createDataFrame([(i % 7 or None, t, "b", i) for i, t in enumerate(texts)], "doc_id long, text string, body string, sign int")
    out = byte_bpe.decode(byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), RANKS)
    found = out.collect()
    assert sorted(r["sign"] for r in found) == list(range(len(texts)))
    for row in found:
        assert row["text"] == texts[row["sign"]] and row["body"] == "b"
        assert row["ids"] == ids(row["text"])
        assert row["raw"] == (row["text"] or "").encode()


def test_empty_table_and_replaced_columns(spark):
    empty = spark.createDataFrame([], "text string, ids int, raw int")
    out = byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.collect() == [] and dict(out.dtypes)["ids"] == "binary"
    with pytest.raises(ValueError):
        byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN, chunk=1, overlap=2)
