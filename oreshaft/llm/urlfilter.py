"""URL filtering: rules on host and path, else a logistic regression.

The model's features are character n-grams (3 to 5) of the host and the path,
each marked with its part and hashed into `buckets`; a URL's distinct n-grams
weigh alike and sum to one. It is trained on a small labelled table (at most
`max_rows` rows, the first by hash): features come from the same expressions
that score, and full-batch gradient descent with weight decay runs on the driver. Scoring is one
projection: the weights are a constant array inside the expression, of a size
fixed by `buckets`. Nothing is shuffled.

Rules are few and given by the caller: "host/path" with a verdict. A rule fits
its host and all subdomains where the url's path starts with its path; of those
that fit the longest wins (of equally long ones, the first by code point).

Nulls: a null url, or one without ://, has empty host and path, no n-gram, and
so the verdict of the bias alone. Labelled rows with a null label are left out.
"""

from __future__ import annotations

import csv
import json
import math
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
GRAMS = (3, 4, 5)
BUCKETS = 8192

#: A small table of urls labelled by hand: sites as they are known, and made-up ones of unwanted kinds.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path)"""
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    said = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r))[::-1]:
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        said = F.when(fits, F.lit(rule)).otherwise(said)
    verdict = F.lit(None).cast("string")
    for rule, v in rules.items():
        verdict = F.when(said == rule, F.lit(v)).otherwise(verdict)
    return said, verdict


def _hashed(s: Column, mark: str, n: int, buckets: int):
    return lambda i: (F.pmod(F.xxhash64(F.lit(f"{mark}{n}"), F.substring(s, i, F.lit(n))), F.lit(buckets)) + 1).cast("int")


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets (1 to buckets) of both parts' n-grams."""
    every = []
    for mark, part in (("h", host), ("p", path)):
        s = F.concat(F.lit("^"), part, F.lit("$"))
        for n in GRAMS:
            hashed = _hashed(s, mark, n, buckets)
            every.append(F.when((F.char_length(s) >= n) & (part != ""), F.transform(F.sequence(F.lit(1), F.char_length(s) - n + 1), hashed)).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(*every))


def example_table(spark: SparkSession) -> DataFrame:
    """The labelled table that comes with the package: url, blocked."""
    with LABELLED.open(newline="") as f:
        rows = [{"url": r["url"], "blocked": int(r["blocked"])} for r in csv.DictReader(f)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,blocked:int>>")))


def fit(labelled: DataFrame, buckets: int = BUCKETS, max_rows: int = 10_000, rounds: int = 800, rate: float = 2500.0, decay: float = 1e-4, prior: float = 0.8) -> list[float]:
    """Weights of the buckets, bias last; an empty table gives zeros with a bias against blocking.

    prior is the share of wanted urls that the model takes as given, whatever the
    table's is; a url of unknown n-grams so is allowed.
    """
    host, path = parts(F.col("url"))
    rows = labelled.where("blocked is not null").select(grams(host, path, buckets).alias("g"), (F.col("blocked") > 0).alias("y"), F.xxhash64("url").alias("k")).orderBy("k", "y").limit(max_rows).collect()
    w, bias = np.zeros(buckets + 1), math.log((1 - prior) / prior)
    if not rows:
        return [*w[1:].tolist(), bias]
    y, size = np.array([float(r["y"]) for r in rows]), np.array([len(r["g"]) for r in rows])
    row, gram = np.repeat(np.arange(len(rows)), size), np.array([i for r in rows for i in r["g"]], np.int64)
    share, part = y.mean(), 1 / np.maximum(size, 1)
    weigh = np.where(y > 0, (1 - prior) / max(share, 1e-9), prior / max(1 - share, 1e-9)) / len(rows)
    for _ in range(rounds):
        z = bias + np.bincount(row, w[gram], len(rows)) * part
        d = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        w = w * (1 - decay) - rate * np.bincount(gram, (d * part)[row], buckets + 1)
    return [*w[1:].tolist(), bias]


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a url is to be blocked."""
    buckets = len(weights) - 1
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in weights[:-1])), ",").cast("array<double>")  # folded to one constant
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, i: a + F.element_at(table, i)) / F.greatest(F.size(g), F.lit(1))
    z = F.element_at(F.transform(F.array(grams(host, path, buckets)), total), 1) + weights[-1]
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, rules: dict[str, str], weights: list[float], url: str = "url", least: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and blocked_p (in place of columns of these names)."""
    own = ("host", "path", "rule", "verdict", "blocked_p")
    kept = [c for c in pages.columns if c.lower() not in own]
    host, path = parts(F.col(f"`{url}`"))
    base = pages.select(*(f"`{c}`" for c in kept), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = base.withColumn("rule", rule).withColumn("__said", verdict).withColumn("blocked_p", score(F.col("host"), F.col("path"), weights))
    return scored.withColumn("verdict", F.coalesce("__said", F.when(F.col("blocked_p") >= least, "block").otherwise("allow"))).drop("__said")
