"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Columns, SQL functions and MLlib transformers only. The model is fitted on a small labelled table of
urls (label 1: block) given by the caller, of at most `MAX_LABELLED` rows; judging is one projection.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#`
or the end. A null url, or one without `://`, has both empty. A rule `host/path` fits its host and all
subdomains where the path begins with the rule's; the longest rule wins, then the smaller text.

Defined cases: an empty labelled table, or one with a single label, gives no model: urls without a
rule are then allowed (or get that label); null urls are judged by the method on empty text; extra
columns are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.shared import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4)
BUCKETS = 4096
MAX_LABELLED = 4000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (action, host/path) that fits, or null. Rules are a short list written by hand."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ngrams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Character n-grams of host and path, each between marks, with the part's letter before them."""
    def of(mark: str, text: Column, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    return F.concat(*[of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in sizes])


def hashed(df: DataFrame, host: Column, path: Column) -> DataFrame:
    grams = df.withColumn("__grams", ngrams(host, path))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__x").transform(grams).drop("__grams")


def fit(labelled: DataFrame, iterations: int = 30, penalty: float = 1e-3) -> LogisticRegressionModel | float:
    """The model of a labelled table (url, label 0/1), or the share of blocked urls where one label is all there is."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    rows = kept(rows.orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED))
    low, high = rows.df.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return low or 0.0
    learner = LogisticRegression(
        featuresCol="__x", labelCol="label", maxIter=iterations, regParam=penalty, standardization=False,
        rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__y")
    return learner.fit(hashed(rows.df, host, path))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel | float,
    url_col: str = "url", threshold: float = 0.5,
) -> DataFrame:
    """All columns of `pages`, host, path, rule, block_score (null where a rule decides) and verdict."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "block_score", "verdict")]
    host, path = url_parts(F.col(f"`{url_col}`"))
    df = pages.select(*keep, host.alias("host"), path.alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if isinstance(model, float):
        df = df.withColumn("__score", F.lit(model))
    else:
        df = model.transform(hashed(df, F.col("host"), F.col("path"))).withColumn("__score", vector_to_array("__p")[1])
    action = F.lit(None).cast("string")
    for what, rule in rules:
        action = F.when(F.col("rule") == rule, what).otherwise(action)
    judged = F.when(F.col("__score") >= threshold, "block").otherwise("allow")
    return (df.withColumn("verdict", F.coalesce(action, judged))
            .withColumn("block_score", F.when(F.col("rule").isNull(), F.col("__score")))
            .drop("__x", "__raw", "__p", "__y", "__score"))
