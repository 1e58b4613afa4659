"""URL filters: rules by host and path, and gradient-boosted trees for what no rule covers.

The URLs that a rule covers are the labelled ones (blocked or allowed), so the labels come from the
rules alone; the trees learn from lexical features and judge the rest. A suffix's rate of blocked URLs
leaves out the row whose feature it is, so that no label tells of itself.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged like any other; rows that repeat get equal verdicts; rules of equal length that both fit go to
the later one in the list; URLs of any length are read whole; without labels of both kinds the one
kind there is (else ``allow``) is the verdict; an empty table gives an empty result; columns other than
page_id and url are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_or_shuffled, stored

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "has_fragment", "secure", "suffix_share", "suffix_blocked")


def parts(url: Column) -> tuple[Column, Column]:
    """(Lower-cased host, path)."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(The longest rule that fits, its verdict); null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that depend on the URL alone."""
    url = F.coalesce("url", F.lit(""))
    long = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    chars = F.split(F.lower(url), "")
    kinds = F.array_distinct(chars)
    share = lambda ch: (F.char_length(F.lower(url)) - F.char_length(F.replace(F.lower(url), ch, F.lit("")))) / long
    entropy = F.aggregate(kinds, F.lit(0.0), lambda acc, ch: acc - F.when(share(ch) > 0, share(ch) * F.log2(share(ch))).otherwise(0.0))
    return pages.select(
        "*",
        F.char_length(url).cast("double").alias("length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (F.char_length(F.regexp_replace(url, "[^0-9]", "")) / long).alias("digit_ratio"),
        F.round(entropy, 9).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"),
        (F.char_length(url) - F.char_length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        url.contains("#").cast("double").alias("has_fragment"),
        url.startswith("https").cast("double").alias("secure"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sample: int = 20_000,
    trees: int = 10,
    depth: int = 3,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null under a rule).

    The trees are fitted on at most ``sample`` labelled URLs, drawn by hash; suffix statistics
    (share of pages, rate of blocked) cover all pages, and their table is broadcast only if it
    has few rows.
    """
    host, path = parts(F.col("url"))
    d = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, told = ruled(F.col("host"), F.col("path"), rules)
    d = stored(lexical(d.select("*", rule.alias("rule"), told.alias("told"))).drop("url"), "url-features")
    labelled = F.col("told").isNotNull()
    total = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("told") == "block").alias("block"), F.count_if(labelled).alias("told")).first()
    if not total.block or total.block == total.told:
        one = "block" if total.block else "allow"
        return d.select("page_id", "host", "path", "rule", F.coalesce("told", F.lit(one)).alias("verdict"), F.when(~labelled, float(one == "block")).alias("score"))
    prior = total.block / total.told
    stats = d.groupBy("suffix").agg(
        (F.count(F.lit(1)) / total.n).alias("suffix_share"),
        F.count_if(F.col("told") == "block").alias("suffix_block"), F.count_if(labelled).alias("suffix_told"),
    )
    stats = stored(stats, "url-suffixes")
    d = d.join(small_or_shuffled(stats, stats.count(), 100_000), "suffix")
    # Without the row itself, which must not learn from its own label.
    rate = (F.col("suffix_block") - (labelled & (F.col("told") == "block")).cast("int") + 5.0 * prior) / (F.col("suffix_told") - labelled.cast("int") + 5.0)
    d = d.withColumn("suffix_blocked", F.coalesce(rate, (F.col("suffix_block") + 5.0 * prior) / (F.col("suffix_told") + 5.0)))
    drawn = F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 30)) < math.ceil(min(1.0, 0.9 * sample / total.told) * (1 << 30))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d)
    train = rows.where(labelled & drawn).withColumn("label", (F.col("told") == "block").cast("double")).orderBy("host", "path", "page_id").limit(sample)
    train = stored(train.select("features", "label"), "url-train").coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(train)
    p = F.round(vector_to_array("probability")[1], 9)
    scored = model.transform(rows.where(~labelled)).select("page_id", "host", "path", "rule", F.when(p >= 0.5, "block").otherwise("allow").alias("verdict"), p.alias("score"))
    return scored.unionByName(d.where(labelled).select("page_id", "host", "path", "rule", F.col("told").alias("verdict"), F.lit(None).cast("double").alias("score")))
