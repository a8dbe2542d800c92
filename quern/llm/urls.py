"""URL filtering by rules and, where none fits, by logistic regression, with SQL functions only.

Features are character n-grams of host and path, hashed into ``DIM`` buckets. Training is full-batch
gradient descent over a small labelled table, as one higher-order expression over one row; its
weights are ``DIM`` + 1 numbers, which scoring holds as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DIM, SIZES, STEPS, RATE, DECAY = 512, (3, 4), 120, 8.0, 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of hosts that were labelled by hand.
BLOCKED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm", "adult-cam", "ad-tracker", "casino-spin", "pills-shop", "bets-live", "spam-links", "poker-win", "cheap-meds", "free-spins", "link-farm", "loan-now", "xxx-video", "casino-club", "free-casino", "adult-video", "xxx-cams", "spam-mail", "track-ads", "cheap-loans", "win-money", "pills-online", "bets-online", "poker-bets", "link-spam", "spin-win", "meds-store", "loan-farm", "cam-girls")
ALLOWED = ("library", "thornton", "museum", "weather", "theatre", "station", "institution", "northern", "heather", "rathbone", "stanhope", "ensemble", "orchard", "tradition", "threshold", "eastwind", "ingleside", "motherland", "reading", "history", "garden", "lighthouse", "anthem", "hearth", "bloom", "nation", "athens", "shoreline", "whittle", "stories", "school", "village", "gazette", "council", "bakery", "forest", "railway", "gallery", "almanac", "harbour", "chapel", "kitchen", "observatory", "pottery")
TOPS, LANGS, FRONTS = ("com", "net", "org"), ("en", "fr", "de", "es"), ("", "www.", "m.", "blog.")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, y): the labelled table. Each word stands under three tops, so a top tells nothing."""
    rows = []
    for y, names in ((1.0, BLOCKED), (0.0, ALLOWED)):
        for k, name in enumerate(names):
            for j, top in enumerate(TOPS):
                url = f"https://{FRONTS[(k + j) % 4]}{name}.example.{top}/{LANGS[(k + 2 * j) % 4]}/{(k * 7919 + j * 104729) % 60000}{('', '/', '.html')[(k + j) % 3]}"
                rows.append(F.struct(F.lit(url).alias("url"), F.lit(y).alias("y")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, r"(?s)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def buckets(host: Column, path: Column) -> Column:
    """Bucket of each n-gram, host and path apart; texts have marks at their ends."""
    found = []
    for side, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        found += [_hashed(side, text, size) for size in SIZES]
    return F.concat(*found)


def _hashed(side: str, text: Column, size: int) -> Column:
    """Each n-gram's bucket, from one split of the text into characters."""
    characters, count = F.split(text, ""), F.greatest(F.length(text) - (size - 1), F.lit(0))
    grams = F.slice(characters, F.lit(1), count)
    for k in range(1, size):
        grams = F.zip_with(grams, F.slice(characters, F.lit(1 + k), count), lambda a, b: F.concat(a, b))
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(side), g), F.lit(DIM)).cast("int"))


def train(table: DataFrame) -> list[float]:
    """Weights of the buckets and, last, the bias. ``table`` (url, y) is small by contract: all its
    rows become one. An empty table, or one without usable rows, gives weights of 0."""
    host, path = parts(F.col("url"))
    rows = table.where("y is not null").select(F.col("y").cast("double").alias("y"), buckets(host, path).alias("g"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM)), lambda j: F.when(j == DIM, 1.0).otherwise(F.size(F.filter("g", lambda b: b == j)) / F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double"))))
    examples = rows.select("y", "g", dense.alias("x")).agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("e"))
    zeros = F.array_repeat(F.lit(0.0), DIM + 1)

    def step(w: Column, _: Column) -> Column:
        def add(g: Column, e: Column) -> Column:
            margin = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            wrong = F.array(1.0 / (1.0 + F.exp(-margin)) - e["y"])
            return F.aggregate(wrong, g, lambda held, r: F.zip_with(held, e["x"], lambda a, b: a + r * b))

        slope = F.aggregate("e", zeros, add)
        return F.zip_with(w, slope, lambda a, s: a * (1.0 - RATE * DECAY) - s * RATE / F.greatest(F.size("e"), F.lit(1)))

    learned = examples.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zeros, step).alias("w"))
    return learned.first()["w"]  # DIM + 1 numbers


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The chance that a URL is to be blocked."""
    grams = buckets(host, path)
    total = F.aggregate(grams, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, b: F.struct((acc["s"] + F.get(F.lit(weights[:-1]), b)).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: acc["s"] / F.sqrt(F.greatest(acc["n"], F.lit(1)).cast("double")))
    return 1.0 / (1.0 + F.exp(-(total + F.lit(weights[-1]))))


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of (page_id, url).

    The longest rule that fits decides; else the model does: block from a chance of one half. A null
    url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model.
    Repeated rows are judged alike; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", F.explode(F.array(F.struct(host.alias("host"), path.alias("path")))).alias("u")).select("page_id", "u.host", "u.path")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.withColumn("score", probability(F.col("host"), F.col("path"), weights)).withColumn("rule", rule)
    verdict = F.coalesce(says, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
