"""URL filters by mined association rules.

``mine`` turns labelled URLs into token sets (scheme, host labels, path segments with digits
as #, query keys), adds an item for the bad label, and runs FP-growth. Rules that conclude the
bad label stay if support, confidence and lift reach their limits and no shorter rule with
the same confidence or more is contained in them. ``judge`` matches all URLs by an inverted
index: each rule is listed under its rarest token, so a URL meets only rules that share
it, and then the whole antecedent is tested. Fixed host and path rules go first: a rule is listed
under its host, a URL meets the rules of its host and its parent domains, the longest whose
path is a prefix wins.

Both rule tables are joined without hints: what FP-growth finds at a given support is small, but
nothing depends on it. URLs are judged once each, so a host or a URL with many rows costs no more.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no rule and
are judged by their tokens (null: none, so allowed); labels that are null are ignored, repeated
labels of a page count as the worst; with no labels there are no mined rules; repeated
rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put

BAD = "label=bad"


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.002
    min_rows: int = 10             # support in rows, at least
    min_confidence: float = 0.5
    min_lift: float = 2.0
    partitions: int = 32


def split(urls: DataFrame) -> DataFrame:
    """Adds host, path and tokens to rows with a ``url``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    d = urls.withColumn("rest__", F.coalesce(rest, F.lit("")))
    d = d.withColumn("host", F.translate(F.regexp_extract("rest__", "^[^/?#]*", 0), upper, lower))
    d = d.withColumn("path", F.regexp_extract("rest__", "^[^/?#]*([^?#]*)", 1)).drop("rest__")
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(F.coalesce("url", F.lit("")), "://", 1)))),
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), "[0-9]+", "#"))),
        F.transform(F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1)))))
    tokens = F.filter(F.array_distinct(tokens), lambda x: ~x.endswith("="))
    return d.withColumn("tokens", F.when((F.col("host") != "") & F.col("url").isNotNull(), tokens).otherwise(F.array().cast("array<string>")))


def document_number(urls: DataFrame) -> DataFrame:
    """Adds doc_id to rows with a ``path``: the number that its last segment is, before any ending;
    null if there is none."""
    return urls.withColumn("doc_id", F.regexp_extract("path", r"/([0-9]+)(\.[A-Za-z]+)?/?$", 1).try_cast("bigint"))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``labelled`` (tokens, bad) -> rules: tokens, confidence, support, lift, head (rarest token)."""
    from pyspark.ml.fpm import FPGrowth
    spark = labelled.sparkSession
    rows = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0))
    n = rows.count()
    schema = "tokens array<string>, confidence double, support double, lift double, head string"
    if not n:
        return spark.createDataFrame([], schema)
    items = rows.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(mining.min_support, mining.min_rows / n)),
                     minConfidence=mining.min_confidence, numPartitions=mining.partitions).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") >= mining.min_lift))
    rules = put(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"), "rules")
    # a rule that a shorter one implies, with no less confidence, is pruned; they meet on any of its tokens
    short = rules.select(F.explode("tokens").alias("t"), F.col("tokens").alias("s_tokens"), F.col("confidence").alias("s_confidence"))
    implied = rules.withColumn("t", F.explode("tokens")).join(short, "t").where(
        (F.size("s_tokens") < F.size("tokens")) & (F.size(F.array_except("s_tokens", "tokens")) == 0) & (F.col("s_confidence") >= F.col("confidence")))
    rules = rules.join(implied.select("tokens").distinct(), "tokens", "left_anti")
    freq = rows.select(F.explode("tokens").alias("t")).groupBy("t").count()
    head = rules.select("tokens", F.explode("tokens").alias("t")).join(freq, "t").groupBy("tokens").agg(F.min_by("t", F.struct("count", "t")).alias("head"))
    return put(rules.join(head, "tokens").select("tokens", "confidence", "support", "lift", "head"), "rules")


def fixed_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """``[("org/", "allow"), ...]`` -> rule, r_host, r_path, r_verdict."""
    return spark.createDataFrame([(r, r[:r.index("/")], r[r.index("/"):], v) for r, v in rules], "rule string, r_host string, r_path string, r_verdict string")


def judge(pages: DataFrame, fixed: DataFrame, mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the best mined rule that fits)."""
    urls = put(split(pages.select("url").where("url IS NOT NULL").distinct()), "urls")
    domains = F.expr("transform(sequence(0, size(split(host, '[.]')) - 1), i -> array_join(slice(split(host, '[.]'), i + 1, size(split(host, '[.]'))), '.'))")
    hits = urls.withColumn("r_host", F.explode(domains)).join(fixed, "r_host").where(F.col("path").startswith(F.col("r_path")))
    hits = hits.groupBy("url").agg(F.max_by(F.struct("rule", "r_verdict"), F.struct(F.length("rule"), "rule")).alias("r"))
    found = urls.select("url", "tokens", F.explode("tokens").alias("head")).join(mined.select("head", F.col("tokens").alias("need"), "confidence"), "head")
    found = found.where(F.size(F.array_except("need", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))
    verdicts = hits.join(found, "url", "full").select(F.col("url").alias("v_url"), F.col("r.rule").alias("rule"), F.col("r.r_verdict").alias("r_verdict"), "confidence")
    d = split(pages.select("page_id", "url")).drop("tokens")
    d = d.join(verdicts, d.url == verdicts.v_url, "left")
    verdict = F.coalesce("r_verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
