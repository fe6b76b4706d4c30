"""URL filtering by a rule list and by association rules mined from the pages the list labels.

Pages that a list rule fits are labelled by its verdict. FP-growth mines the token combinations
of labelled URLs; rules ``tokens -> verdict`` that pass the support and confidence floors are
pruned to the most general ones and matched through an inverted index on their rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, without
from tidewatch.session import cut_lineage

#: (host, path, verdict). Fixed values of the query's contract.
LIST = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Share of the labelled pages that a mined rule must cover, verdict included.
MIN_SUPPORT = 0.01
#: Share of the labelled pages with a rule's tokens that must have its verdict.
MIN_CONFIDENCE = 0.8
#: Host labels from the right and path segments from the left that become tokens of their own.
#: What lies beyond joins the last one, so a URL has at most HOST_DEPTH + PATH_DEPTH tokens and
#: the number of frequent combinations is at most 2^9 / MIN_SUPPORT.
HOST_DEPTH = 4
PATH_DEPTH = 3


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (longest host plus path), or NULL."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens ``h0:com`` (top level), ``h1:…`` and ``p0:en``, ``p1:…``; none if empty."""

    def numbered(prefix: str, parts: Column, depth: int, glue: str) -> Column:
        head = F.slice(parts, 1, depth - 1)
        tail = F.slice(parts, F.lit(depth), F.greatest(F.size(parts) - (depth - 1), F.lit(1)))
        folded = F.when(F.size(parts) < depth, parts).otherwise(F.concat(head, F.array(F.array_join(tail, glue))))
        return F.transform(folded, lambda x, i: F.concat(F.lit(prefix), i.cast("string"), F.lit(":"), x))

    hosts = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    paths = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(
        F.concat(numbered("h", hosts, HOST_DEPTH, "."), numbered("p", paths, PATH_DEPTH, "/"))
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(tokens, verdict, confidence, cover)`` from rows ``(tokens, verdict)``.

    ``cover`` is the number of labelled rows with tokens and verdict. A rule is dropped if a rule
    with a subset of its tokens has the same verdict and at least its confidence. The number of
    rules is bounded by the support floor and the token depth, whatever the input.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    total = F.lit(labelled.count())
    rules = model.associationRules.filter(F.col("consequent")[0].startswith("=")).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], 2, 100).alias("verdict"),
        "confidence",
        F.round(F.col("support") * total).cast("long").alias("cover"),
    )
    rules = cut_lineage(rules.filter(F.forall("tokens", lambda x: ~x.startswith("="))))
    # Each rule against the rules on its own subsets: at most 2^7 probes per rule, matched by key.
    general = rules.select(F.col("tokens").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    probes = rules.withColumn("mask", F.explode(F.expr("sequence(1, cast(shiftleft(1, size(tokens)) - 2 as int))")))
    probes = probes.filter(F.col("mask").between(1, F.expr("shiftleft(1, size(tokens)) - 2"))).withColumn(
        "fewer", F.expr("filter(tokens, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    )
    implied = probes.join(
        general,
        (probes["fewer"] == general["fewer"]) & (probes["verdict"] == general["same"]) & (general["sure"] >= probes["confidence"]),
        "left_semi",
    ).select("tokens", "verdict")
    return rules.join(implied, ["tokens", "verdict"], "left_anti")


def judge(
    pages: DataFrame, url: str = "url", rules=LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (list rule or NULL) and ``verdict``.

    The verdict is the list rule's; else that of the matching mined rule with the highest
    confidence, then cover (block on a tie); else allow. NULL urls and those without ``://``
    have an empty host and path and no tokens, hence allow. Each distinct url is judged once, so
    repeated rows cost one join row. Columns of ``pages`` named like the four are replaced. An
    empty table, or one on which no list rule fits, mines nothing and allows the rest.
    """
    (link,) = fresh(pages, "link")
    source = pages.withColumn(link, F.coalesce(F.col(f"`{url}`"), F.lit("")))
    host, path = host_of(F.col(link)), path_of(F.col(link))
    name, says = list_rule(F.col("host"), F.col("path"), rules)
    urls = source.select(F.col(link).alias("link"), host.alias("host"), path.alias("path"))
    listed = urls.select("link", "host", "path", name.alias("rule"), says.alias("said")).withColumn(
        "tokens", tokens_of(F.col("host"), F.col("path"))
    )
    labelled = listed.filter("said IS NOT NULL").select("tokens", F.col("said").alias("verdict"))
    distinct = listed.dropDuplicates(["link"])
    if labelled.isEmpty():
        verdicts = distinct.withColumn("mined", F.lit(None).cast("string"))
    else:
        verdicts = _matched(distinct, mine(labelled, min_support, min_confidence))
    verdicts = verdicts.select(
        F.col("link").alias(link), "host", "path", "rule", F.coalesce("said", "mined", F.lit("allow")).alias("verdict")
    )
    kept = without(pages, "host", "path", "rule", "verdict")
    slim = source.select(*kept, link)
    return slim.join(verdicts, link, "left").drop(link)


def _matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with ``mined``: the verdict of the best mined rule whose tokens a url has."""
    # Rarest token of a rule: the one in the fewest rules, then by name. Bounded like the rules.
    spread = rules.select("tokens", "verdict", "confidence", "cover", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("uses"))
    index = (
        spread.join(F.broadcast(common), "token")
        .groupBy("tokens", "verdict", "confidence", "cover")
        .agg(F.min(F.struct("uses", "token"))["token"].alias("anchor"))
        .withColumnRenamed("tokens", "needed")
    )
    open_urls = urls.filter("said IS NULL").select("link", "tokens", F.explode("tokens").alias("anchor"))
    hits = open_urls.join(F.broadcast(index), "anchor").filter(F.size(F.array_except("needed", "tokens")) == 0)
    rank = F.struct(F.col("confidence"), F.col("cover"), (F.col("verdict") == "block").alias("blocks"))
    best = hits.groupBy("link").agg(F.max(rank)["blocks"].alias("blocks"))
    mined = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow")
    return urls.join(best, "link", "left").withColumn("mined", mined)
