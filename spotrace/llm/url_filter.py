"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for the rest.

DataFrame and SQL functions throughout: n-grams are hashed, counted and weighed inside a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
SIZES = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (verdict, host, path) of a rule (fixed values of the task).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A small labelled table: 1 marks URLs of adverts, trackers, shops, logins and the like.
LABELLED = (
    ("http://ads.banner.example.org/click?id=1", 1), ("http://track.pixel.example.org/imp/42", 1),
    ("https://adserver.example.net/banner/300x250", 1), ("https://casino-bonus.example.org/play/slots", 1),
    ("http://cheap-pills.example.org/buy/now", 1), ("https://login.example.org/signin/account", 1),
    ("https://shop.example.org/cart/checkout", 1), ("https://poker.example.net/casino/win-money", 1),
    ("http://xxx-cams.example.org/adult/live", 1), ("http://free-download.example.net/crack/keygen", 1),
    ("https://affiliate.example.net/promo/offer", 1), ("http://doubleclicks.example.org/adclick/redirect", 1),
    ("https://popup.example.net/ads/landing", 1), ("http://spam.example.org/tag/viagra", 1),
    ("https://accounts.example.net/register/login", 1), ("http://metrics.example.net/track/beacon", 1),
    ("https://blog.example.org/articles/history", 0), ("http://www.example.org/wiki/geology", 0),
    ("https://docs.example.net/guide/install", 0), ("https://news.example.org/world/report", 0),
    ("http://library.example.org/books/1234", 0), ("https://www.example.net/science/physics", 0),
    ("http://journal.example.org/issue/7/paper", 0), ("https://museum.example.org/collection/item", 0),
    ("https://en.example.org/article/music", 0), ("http://forum.example.net/thread/question", 0),
    ("https://university.example.org/course/notes", 0), ("http://recipes.example.net/soup/onion", 0),
    ("https://travel.example.org/city/guide", 0), ("http://archive.example.net/texts/1890", 0),
    ("https://health.example.org/topics/sleep", 0), ("http://weather.example.net/forecast/week", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    known = F.coalesce(F.when(url.contains("://"), after), F.lit(""))
    host = F.regexp_extract(known, r"^([^/?#]*)", 1)
    path = F.regexp_extract(known, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, ties by name; null where none fits.

    ``rules`` is a short list; each becomes one branch of a CASE, the longest first.
    """
    name = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def ngram_buckets(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram; host and path have n-grams of their own."""
    def grams(text: Column, size: int) -> Column:
        return F.when(F.length(text) >= size, F.transform(
            F.sequence(F.lit(1), F.length(text) - (size - 1)),
            lambda i: F.pmod(F.crc32(F.substr(text, i, F.lit(size))), F.lit(BUCKETS)).cast("int"),
        )).otherwise(F.array().cast("array<int>"))

    marked = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("^/"), path))
    return F.concat(*[grams(text, size) for text in marked for size in SIZES])


def labelled_urls(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def train(labelled: DataFrame, regularisation: float = 1e-4) -> tuple[float, list[float]]:
    """(intercept, weight of each bucket) from rows of url and label (1: to block).

    Rows with a null url or label are left out.  The result has a fixed size.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(
        F.col("label").cast("double").alias("label"), ngram_buckets(host, path).alias("grams")
    )
    share = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda j: F.size(F.filter("grams", lambda g: g == j)) / F.greatest(F.size("grams"), F.lit(1)),
    )
    fitted = LogisticRegression(regParam=regularisation, maxIter=30, standardization=False).fit(
        rows.select("label", array_to_vector(share).alias("features"))
    )
    return float(fitted.intercept), [float(w) for w in fitted.coefficients.toArray()]


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, score and verdict to every row of ``pages``.

    ``score`` is the model's probability that the URL is to be blocked; it decides where no rule
    fits.  A null url or one without ``://`` has an empty host and path and is judged by the
    model like any other.  Columns of the new names are replaced, others and repeated rows stay.
    Training on ``labelled`` starts a job.
    """
    intercept, weights = train(labelled)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(*own, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__grams", ngram_buckets(F.col("host"), F.col("path")))
    logit = F.lit(intercept) + F.aggregate(
        "__grams", F.lit(0.0), lambda total, g: total + F.get(F.lit(weights), g)
    ) / F.greatest(F.size("__grams"), F.lit(1))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "score": 1 / (1 + F.exp(-logit)), "__said": said})
    verdict = F.coalesce("__said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).drop("__grams", "__said")
