"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    byte_bpe,
    conversation_repair,
    decontaminate,
    knn_join,
    license_scan,
    line_dedup,
    ngram_join,
    periodic_runs,
    quality,
    sharding,
    superminhash,
    toxicity,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity after deobfuscation."""
    documents, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    documents = documents.select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.fit(documents, labels), restored=None)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public rank file and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN).drop("text")
    return byte_bpe.decode(coded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the good ones keeps."""
    documents, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    kept = quality.select(documents.select("doc_id", "text"), labels)
    return kept.select("doc_id", "log_weight", "features", "sort_key")


@query(
    "op4_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, parts, unnest(range(len(parts))) AS line, unnest(parts) AS body
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), sets AS (
        SELECT doc_id, line, list_sort(list_distinct(list_filter(
                   regexp_split_to_array(lower(body), '[ \t\x0B\f\r]+'), lambda w: w != ''))) AS words
        FROM lines
    ), units AS (
        SELECT words, len(words) AS n, min((doc_id, line)) AS first, row_number() OVER () AS unit
        FROM sets WHERE len(words) > 0 GROUP BY words
    ), tokens AS (
        SELECT unit, n, unnest(words) AS word FROM units
    ), common AS (
        SELECT a.unit AS a, b.unit AS b, count(*) AS shared, any_value(a.n) AS n_a, any_value(b.n) AS n_b
        FROM tokens a JOIN tokens b ON a.word = b.word AND a.unit != b.unit
         AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
        GROUP BY a.unit, b.unit
    ), late AS (
        SELECT DISTINCT a AS unit
        FROM common JOIN units x ON x.unit = a JOIN units y ON y.unit = b
        WHERE 100 * shared >= 80 * (n_a + n_b - shared) AND y.first < x.first
    ), told AS (
        SELECT s.doc_id, s.line,
               len(s.words) > 0 AND (l.unit IS NOT NULL OR (s.doc_id, s.line) > u.first) AS gone
        FROM sets s LEFT JOIN units u ON u.words = s.words LEFT JOIN late l ON l.unit = u.unit
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT coalesce(gone, false)) AS n_kept,
           coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE gone), '') AS gone
    FROM told GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines and the numbers of those that repeat an earlier line."""
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("lines").alias("n_lines"),
        (F.col("lines") - F.size("gone")).alias("n_kept"),
        F.array_join("gone", ",").alias("gone"),
    )


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 3-word shingles at a similarity of 0.9."""
    return ngram_join.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed by proportional stratified interleaving, law ``rows``."""
    placed = sharding.interleave(sharding.measured(table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


@query(
    "op7_url_rules",
    r"""
    WITH parts AS (
        SELECT page_id,
               translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)
    ), ruled AS (
        SELECT *, CASE
                WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
            list_filter(list_reverse(string_split(host, '.')), lambda x: x != '') AS hs,
            list_filter(string_split(path, '/'), lambda x: x != '') AS ps
        FROM parts
    ), tokened AS (
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
            list_sort(list_distinct(list_concat(
                list_transform(CASE WHEN len(hs) < 4 THEN hs ELSE list_append(hs[:3], array_to_string(hs[4:], '.')) END, lambda x, i: 'h' || (i - 1) || ':' || x),
                list_transform(CASE WHEN len(ps) < 3 THEN ps ELSE list_append(ps[:2], array_to_string(ps[3:], '/')) END, lambda x, i: 'p' || (i - 1) || ':' || x)))) AS tokens
        FROM ruled
    ), combos AS (
        SELECT page_id, said, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS picked
        FROM (SELECT page_id, said, tokens, unnest(range(1, 1 << len(tokens))) AS mask FROM tokened)
    ), mined AS (
        SELECT picked, said, n, n / alone AS confidence
        FROM (SELECT picked, said, count(*) AS n, sum(count(*)) OVER (PARTITION BY picked) AS alone
              FROM combos WHERE said IS NOT NULL GROUP BY picked, said)
        WHERE n >= 0.01 * (SELECT count(*) FROM tokened WHERE said IS NOT NULL) AND n / alone >= 0.8
    ), best AS (
        SELECT c.page_id, arg_max(m.said, (m.confidence, m.n, m.said = 'block')) AS verdict
        FROM combos c JOIN mined m ON m.picked = c.picked WHERE c.said IS NULL GROUP BY c.page_id
    )
    SELECT page_id, host, path, rule, coalesce(said, verdict, 'allow') AS verdict
    FROM tokened LEFT JOIN best USING (page_id)
    """,
)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the list and the mined rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    documents, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    flagged = decontaminate.flag(documents.select("doc_id", "text"), benchmark).filter("size(leaks) > 0")
    found = flagged.select("doc_id", F.explode("leaks").alias("leak"))
    return found.select(
        "doc_id", F.col("leak.item").cast("long").alias("item_id"), "leak.edits", "leak.start", "leak.length"
    )


@query(
    "op9_knn_join",
    """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, w.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, w.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole q JOIN whole w ON q.vec_id % 50 = 0 AND w.vec_id != q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
    QUALIFY rank <= 5
    """,
)
def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector among all others."""
    vectors = knn_join.whole_vectors(table(spark, sf_dir, "embeddings"))
    return knn_join.top_k(vectors, vectors.filter("id % 50 = 0"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or that of its nearest directory.

    The table has no paths; a document lies in ``<source>/<lang>/<doc_id modulo 100>``.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scanned = license_scan.scan(documents).drop("text")
    folder = F.concat_ws("/", "source", "lang", F.pmod("doc_id", F.lit(100)))
    return license_scan.inherit(scanned, folder).select(
        "doc_id", "own_license", "cosine", "license_line", "license_file", "license", "license_from"
    )


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a text whose key's checksum ends in 0 repeats a stretch up to its end.

    Of its n words those from ``a = g % n`` on become the first ``p`` of them over and over, with ``g``
    a tenth of the checksum and ``p = 1 + (n - a) div (3 + g % 8)``.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    repeated = F.expr(
        "array_join(transform(sequence(0, n - 1), i -> get(words, CAST(IF(i < a, i, a + (i - a) % p) AS INT))), ' ')"
    )
    keyed = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    split = (
        keyed.withColumn("words", F.when(chosen, words))
        .withColumn("n", F.size("words"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    )
    return split.select("doc_id", F.when(F.col("words").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs after a tenth of the documents was made periodic."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.collapse(with_planted_runs(documents)).drop("text")
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS small)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    digests = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return digests.select(
        "doc_id",
        "n_runs",
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with rows dropped, emptied, cut, repeated or given to the user by checksum."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn"))) % 20
    rows = conversations.select("conv_id", "turn", cell("role").alias("role"), cell("text").alias("text"), act.alias("act"))
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = rows.filter("act != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("act") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return kept.drop("copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the cheapest repair of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, _ = conversation_repair.repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(audits, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op13_superminhash")
def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 3-word shingles at a similarity of 0.85."""
    return superminhash.classes(table(spark, sf_dir, "documents"), k=3, percent=85)
