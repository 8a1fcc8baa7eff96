"""URL filtering: allow and block rules, and gradient-boosted trees for what no rule covers.

The trees see lexical features only and learn from labelled URLs. Suffix statistics are the
block rates of a host's last labels and a path's first part among all labelled rows, smoothed;
a training row gets the rate of the folds it is not in. Only the fit of the trees takes a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.llm.util import LOWER, UPPER, hinted
from shoalcount.session import materialize


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query is to apply.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: The trees are fitted on at most so many labelled URLs (all of them, if there are fewer).
TRAIN_ROWS = 200_000

FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "hyphens", "tail1_rate", "tail2_rate", "first_rate")

#: Folds of the labelled rows for the suffix statistics.
FOLDS = 5

#: Prior weight of the overall block rate in a suffix's rate.
PRIOR = 8.0


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    after = F.when(F.contains(url, F.lit("://")), F.substring_index(_after(url), "/", 1))
    bare = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(bare, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; else empty."""
    after = F.when(F.contains(url, F.lit("://")), _after(url))
    bare = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    slash = F.locate("/", bare)
    return F.coalesce(F.when(slash > 0, F.call_function("substring", bare, slash)), F.lit(""))


def _after(url: Column) -> Column:
    return F.call_function("substring", url, F.locate("://", url) + 3)


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, url (null as it is), host and path."""
    return pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict), or null. Rules are part of the plan."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the last that fits is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """The lexical features of split URLs, besides page_id, url, host, path and the suffix keys."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.when(F.contains(url, F.lit("?")), F.call_function("substring", url, F.locate("?", url) + 1)).otherwise("")
    query = F.substring_index(query, "#", 1)
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        F.when(host == "", 0.0).otherwise(count(host, ".") + 1.0).alias("host_depth"), count(path, "/").cast("double").alias("path_depth"),
        F.coalesce(F.try_divide(digits.cast("double"), F.length(url).cast("double")), F.lit(0.0)).alias("digit_ratio"), _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("parameters"), count(url, "-").cast("double").alias("hyphens"),
        F.substring_index(host, ".", -1).alias("tail1"), F.substring_index(host, ".", -2).alias("tail2"), F.substring_index(F.substring_index(path, "/", 2), "/", -1).alias("first"),
    )


class UrlModel(NamedTuple):
    trees: GBTClassificationModel | None
    base: float
    rates: dict[str, DataFrame]


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], base: float) -> DataFrame:
    """Adds the smoothed block rate of each suffix; rows with a ``fold`` get it from the other folds."""
    folds = "fold" in rows.columns
    for key, table in rates.items():
        every = table.groupBy("key").agg(F.sum("blocked").alias("__b"), F.sum("seen").alias("__n")).withColumnRenamed("key", key)
        rows = rows.join(every, key, "left")
        b, n = F.coalesce("__b", F.lit(0)), F.coalesce("__n", F.lit(0))
        if folds:
            rows = rows.join(hinted(table).select(F.col("key").alias(key), "fold", F.col("blocked").alias("__fb"), F.col("seen").alias("__fn")), [key, "fold"], "left")
            b, n = b - F.coalesce("__fb", F.lit(0)), n - F.coalesce("__fn", F.lit(0))
        rows = rows.withColumn(f"{key}_rate", (b + PRIOR * base) / (n + PRIOR)).drop("__b", "__n", "__fb", "__fn")
    return rows


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on split URLs with ``label`` (1 block, 0 allow), a sample by hash of page_id and URL of about ``rows`` at most.

    Rates of suffixes and the base rate are of all labelled rows. With no labelled rows, or one
    kind only, there are no trees and the base rate decides.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
    known = labelled.select("page_id", "url", "host", "path", F.col("label").cast("int").alias("label"))
    keys = ("tail1", "tail2", "first")
    groups = materialize(lexical(known).groupBy(*keys, fold).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("seen")))
    total = groups.agg(F.sum("seen"), F.sum("blocked")).first()
    base = (total[1] or 0) / total[0] if total[0] else 0.0
    rates = {k: materialize(groups.groupBy(F.col(k).alias("key"), "fold").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))) for k in keys}
    if not 0 < base < 1:
        return UrlModel(None, base, rates)
    share = min(1.0, rows / total[0])
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20))  # splits repeated URLs
    picked = materialize(lexical(known.where(drawn) if share < 1 else known).select("*", fold))
    held = materialize(_with_rates(picked, rates, base).select("label", *FEATURES))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(held)
    boosted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64)
    return UrlModel(boosted.fit(ready), base, rates)


def predict(urls: DataFrame, model: UrlModel) -> DataFrame:
    """Split URLs with ``block_score``, the model's probability that the URL is to be blocked."""
    rows = _with_rates(lexical(urls), model.rates, model.base)
    if model.trees is None:
        return rows.withColumn("block_score", F.lit(float(model.base)))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return model.trees.transform(ready).withColumn("block_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, model: UrlModel | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    The longest rule that fits the host (or a parent domain) and the path's start decides;
    without one the trees do, which learned from the URLs that rules label (or are given).
    Null URLs and those without :// have empty host and path and no rule. Repeated rows stay,
    other columns (html among them) are not read. An empty table gives no rows.
    """
    urls = split_urls(pages)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    if model is None:
        known = urls.withColumn("rule", rule).where("rule is not null")
        model = train(known.select("page_id", "url", "host", "path", (F.col("rule.verdict") == "block").cast("int").alias("label")))
    scored = predict(urls, model).withColumn("rule", rule)
    guess = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", guess).alias("verdict"), "block_score")
