import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks_of
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_ngram_join import shingles
from tidewatch.llm import byte_bpe, decontaminate, quality

SF = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


def near_classes(rows):
    sets = sorted((r["doc_id"], shingles(r["text"], 5)) for r in rows)
    root = {key: key for key, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {key: find(key) for key in root}


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_stages_against_brute_force(spark, outputs):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    good, lines, unlike, clean, tokens = outputs
    # 1: the highest keys, as many as weigh at least 0
    rated = quality.keyed(documents, quality.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    wanted = sum(r["log_weight"] >= 0 for r in rated)
    best = sorted(rated, key=lambda r: -r["sort_key"])[:wanted]
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in best}
    # 2: lines that repeat an earlier one
    gone = repeated([(r["doc_id"], r["text"]) for r in good], 80)
    expected = {}
    for row in good:
        rest = [x for i, x in enumerate(row["text"].split("\n")) if i not in gone[row["doc_id"]]]
        if not gone[row["doc_id"]] or any(x.strip() for x in rest):
            expected[row["doc_id"]] = "\n".join(rest)
    assert {r["doc_id"]: r["text"] for r in lines} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    # 3: one document of each class
    classes = near_classes(lines)
    assert {r["doc_id"] for r in unlike} == {k for k, v in classes.items() if k == v}
    # 4: no benchmark passage
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = decontaminate.index_of([(str(r["item_id"]), r["text"]) for r in bench])
    kept = {r["doc_id"] for r in clean}
    assert kept <= {r["doc_id"] for r in unlike}
    for row in unlike:
        exact = any(r["text"].lower() in row["text"].lower() for r in bench)
        assert not (exact and row["doc_id"] in kept)
        if row["doc_id"] not in kept and not exact and len(row["text"]) < 1500:
            assert leaks_of(row["text"], index)
    # 5: ids of the whole texts
    encoder = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in tokens} == set(texts)
    for row in tokens:
        assert row["n_tokens"] == len(encoder.encode_ordinary(texts[row["doc_id"]]))
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_columns_between_stages(outputs):
    for rows in outputs[:-1]:
        assert rows and list(rows[0].asDict()) == COLUMNS


def test_run_gives_the_last_stage(spark, outputs):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in outputs[-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
        docs = out if out.columns == COLUMNS else docs


def test_null_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a few plain words here", "en", "s", 22), (2, "a few plain words here", "en", "s", 22)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= 4
        docs = out if out.columns == COLUMNS else docs
