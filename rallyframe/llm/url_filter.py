"""URL verdicts: path rules first, a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# Fixed values: (verdict, host with its path); the longest that fits decides.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Words of the labelled URL table. A URL is to be blocked if its host or its path has a blocked word.
BLOCKED_HOSTS = "ads-track free-bets cheap-pills spam-farm casino-win adult-x ad-tracker best-bets pills-shop spam-links casino-bonus adult-cams".split()
ALLOWED_HOSTS = "news library weather city-hall open-maps museum university recipes gardens science history archive theatre railway hospital school".split()
BLOCKED_PATHS = "casino/bonus bets/free pills/cheap adult/cams spam/links ads/click win/jackpot loans/fast".split()
ALLOWED_PATHS = "en/articles fr/histoire de/nachrichten es/noticias docs/guide events/2024 maps/city about/team".split()
DOMAINS = ("example.com", "example.net", "example.org")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without `://`."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=URL_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of host and path, with `^` and `$` at the ends and `|` between."""
    whole = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.substring(whole, i, F.lit(n)))
    return F.concat(*[of(n) for n in sizes])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) with label 1.0 for block: every host word with every path word and with bare and numbered
    paths, 560 rows. Host and path decide together, so the n-grams of both carry the label."""
    rows = []
    for i, host in enumerate([*BLOCKED_HOSTS, *ALLOWED_HOSTS]):
        bad = host in BLOCKED_HOSTS
        site = f"https://{host}.{DOMAINS[i % len(DOMAINS)]}"
        rows += [(f"{site}{p}", float(bad)) for p in ("", "/", f"/{i}.html", f"/en/{i}")]
        rows += [(f"{site}/{p}/{i}", 1.0) for p in BLOCKED_PATHS] + [(f"{site}/{p}/{i}", float(bad)) for p in ALLOWED_PATHS]
    return spark.createDataFrame(rows, "url string, label double")


def trained(labelled: DataFrame, dim: int = 4096, reg: float = 0.001, max_iter: int = 60, max_rows: int = 100_000) -> PipelineModel:
    """Fit on at most `max_rows` labelled rows, those of the least hash of their URL (a bound on the label table, not
    on what is judged)."""
    host, path = parsed(F.col("url"))
    rows = labelled.filter("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).select(grams(host, path).alias("__grams"), F.col("label"))
    hashing = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=dim, binary=True)
    line = LogisticRegression(featuresCol="__features", labelCol="label", predictionCol="__class", probabilityCol="__probability", rawPredictionCol="__raw", regParam=reg, maxIter=max_iter)
    return PipelineModel([hashing, line.fit(hashing.transform(rows.coalesce(1)))])


def judged_urls(pages: DataFrame, model: PipelineModel, url: str = "url", key: str = "page_id", threshold: float = 0.5, rules=URL_RULES) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) for every row, in one pass without a shuffle.

    A null URL and one without `://` have an empty host and path, fit no rule and are scored as such.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("__ruled", verdict).withColumn("__grams", grams(F.col("host"), F.col("path")))
    score = vector_to_array("__probability")
    scored = model.transform(rows).withColumn("block_score", F.round(F.get(score, 1), 6))
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(key, "host", "path", "rule", F.coalesce("__ruled", learned).alias("verdict"), "block_score")
