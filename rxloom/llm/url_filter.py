"""Blocking and allowing pages by URL: host rules first, then gradient-boosted trees.

URLs that a rule judges are the labelled ones. Trees learn from their lexical features
and judge the rest. Parsing, rules and features are DataFrame expressions; the trees
are Spark ML's, fitted and applied in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The fit takes at most this many labelled URLs: those of the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", *[f"f_{k}_{what}" for k in ("suffix", "domain", "head") for what in ("share", "block")]]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/ ? #``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; the first listed among equals; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url)
    digits = n - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return {
        "f_length": n, "f_host": F.length(host), "f_path": F.length(path), "f_depth": count(path, "/"), "f_labels": count(host, ".") + 1,
        "f_digits": F.when(n > 0, digits / n).otherwise(0.0), "f_entropy": entropy(host),
        "f_params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "f_hyphens": count(host, "-"),
    }


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE, withheld: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    Suffix statistics are counted over all rows by a host's last label, by its last
    two, and by the path's first part: the share of rows that have it, and the
    share of blocked among those labelled, smoothed and without the row itself. Null and malformed URLs have empty host and path and
    are judged by the trees like others. Where rules label nothing every
    unlabelled URL is allowed; where they label one way it gets that verdict.
    ``withheld`` rows are judged by the trees and are no labels, whatever the
    rules say of them: so the trees' accuracy can be measured.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.lit(False).alias("held") if withheld is None else F.coalesce(withheld, F.lit(False)).alias("held"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": F.when(~F.col("held"), verdict), "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "head": F.regexp_extract("path", "^/?([^/]*)", 1)})
    y = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    rows = rows.withColumn("y", y)
    stats = {k: scratch.save(rows.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("blocked")), k) for k in ("suffix", "domain", "head")}
    total = stats["suffix"].agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("blocked").alias("blocked")).first()
    known, blocked = total["known"] or 0, total["blocked"] or 0.0
    keep = ["id", "host", "path", "rule"]
    if not known or blocked in (0, known):
        return rows.select(*keep, F.coalesce("ruled", F.lit("block" if known and blocked else "allow")).alias("verdict"))

    prior = blocked / known
    own = F.when(F.col("y").isNull(), 0).otherwise(1)
    rows = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    for k, counts in stats.items():
        block = (F.col("blocked") - F.coalesce("y", F.lit(0.0)) + 5 * prior) / (F.col("known") - own + 5)
        rows = rows.join(counts, k).withColumns({f"f_{k}_share": F.col("n") / total["n"], f"f_{k}_block": block}).drop("n", "known", "blocked")
    taken = rows.filter("y is not null").orderBy(F.xxhash64("url"), "url", "id").limit(sample).select("y", *FEATURES)
    taken = scratch.save(taken, "sample")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1).fit(assembler.transform(taken))
    found = trees.transform(assembler.transform(rows.select(*keep, "ruled", *FEATURES)))
    method = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return found.select(*keep, F.coalesce("ruled", method).alias("verdict"))


def op7_url_filter(spark, sf_dir) -> DataFrame:
    """page_id, host, path, rule, verdict of all of ``pages``."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).withColumnRenamed("id", "page_id")
