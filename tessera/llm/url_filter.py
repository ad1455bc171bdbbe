"""URL filter: path rules first, then a logistic regression on hashed character
n-grams of host and path.

DataFrame functions only.  One job hashes a small labelled table, bounded in
rows, for the fit; the weights, a fixed number of buckets, become a literal
array, and scoring a URL is one projection without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: lengths of the n-grams, and buckets they are hashed to
SIZES, BUCKETS = (2, 3, 4), 1 << 13

#: fixed values: the rules of the standing query, verdict and prefix
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: fixed values: labelled URLs, 1 for those to block
LABELLED = (
    (0, "https://www.herald.example.com/en/news/2024/05/science-report"),
    (0, "https://blog.garden.example.net/en/how-to-grow-tomatoes"),
    (0, "https://docs.library.example.org/guide/getting-started"),
    (0, "https://www.university.example.edu/research/physics/papers"),
    (0, "https://museum.example.org/collections/paintings/1890"),
    (0, "https://news.daily.example.com/world/2023/11/summit-results"),
    (0, "https://www.recipes.example.net/fr/soupe-aux-legumes"),
    (0, "https://forum.astronomy.example.org/topic/4411/telescope-advice"),
    (0, "https://www.city.example.gov/services/parks"),
    (0, "https://www.health.example.org/articles/sleep-and-memory"),
    (0, "https://blog.trail.example.com/es/rutas-de-montana"),
    (0, "https://www.history.example.net/de/artikel/mittelalter"),
    (0, "https://weather.example.com/en/455"),
    (0, "https://www.letters.example.org/en/archive/270"),
    (0, "https://www.choir.example.net/fr/723/"),
    (0, "https://blog.kitchen.example.com/en/88?page=2"),
    (0, "https://encyclopedia.example.org/wiki/Photosynthesis"),
    (0, "https://www.books.example.com/authors/essays/letters"),
    (0, "http://chess.example.net/lessons/openings/italian"),
    (0, "https://www.maps.example.org/atlas/rivers"),
    (1, "http://cheap-pills-online.example.com/buy-now/viagra-discount"),
    (1, "http://win-free-casino.example.net/bonus/jackpot?ref=991"),
    (1, "http://casino-slots-777.example.com/play/free-spins"),
    (1, "http://hot-adult-cams.example.net/xxx/live-sex-chat"),
    (1, "http://xxx-porn-tube.example.com/videos/porn-free-sex"),
    (1, "http://best-loans-fast.example.com/payday-loan/apply-now"),
    (1, "http://replica-watches-sale.example.net/cheap/discount/buy"),
    (1, "http://free-money-crypto.example.com/bitcoin-doubler/claim-bonus"),
    (1, "http://ads.tracker-click.example.net/click?id=8872&aff=spam"),
    (1, "http://get-followers-cheap.example.com/buy-likes-now"),
    (1, "http://adult-dating-hot.example.net/sexy/singles/join-free"),
    (1, "http://betting-odds-win.example.com/casino/poker-bonus"),
    (1, "http://viagra-cialis-shop.example.com/cheap-pills"),
    (1, "http://download-crack-keygen.example.net/warez/serial-free"),
    (1, "http://torrent-warez-free.example.com/crack/full-version"),
    (1, "http://lottery-winner-claim.example.net/prize/free-money"),
    (1, "http://poker-casino-bonus.example.com/slots/jackpot-win"),
    (1, "http://click-ads-banner.example.net/redirect?aff=44"),
    (1, "http://weight-loss-miracle.example.com/pills/buy-cheap"),
    (1, "http://porn-sex-cams.example.net/adult/xxx"),
    (0, "https://thorn.example.net/en/812"),
    (0, "https://www.linden.example.com/de/37.html"),
    (0, "https://m.station.example.org/es/640/"),
    (0, "https://blog.another.example.net/fr/95?utm_source=feed"),
    (0, "https://www.weather.example.net/es/1204"),
    (0, "https://m.reader.example.com/en/2001.html"),
    (0, "https://blog.thinking.example.com/en/77/"),
    (0, "https://www.nation.example.org/de/518"),
    (0, "https://others.example.com/es/33?page=4"),
    (0, "https://m.anthem.example.net/de/290.html"),
    (0, "https://www.enter.example.net/fr/1650"),
    (0, "https://blog.shine.example.org/en/904"),
    (1, "https://www.casino-night.example.com/en/211"),
    (1, "https://sports-bets.example.net/de/87"),
    (1, "https://m.free-spins.example.com/es/40"),
    (1, "https://pills-online.example.net/fr/1021"),
    (1, "https://www.cheap-meds.example.org/en/16.html"),
    (1, "https://link-farm.example.com/en/733/"),
    (1, "https://blog.spam-links.example.net/de/64"),
    (1, "https://ads-network.example.com/en/58"),
    (1, "https://m.click-track.example.net/es/910"),
    (1, "https://adult-videos.example.com/fr/345"),
    (1, "https://www.win-prizes.example.net/en/72.html"),
    (1, "https://free-coins.example.org/de/1200"),
)


def host_of(url: Column) -> Column:
    """Lower-cased host (A-Z only); empty for null and without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path up to ? or #; empty for null and without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def grams(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct buckets of the character n-grams, n each of ``sizes``, of
    ``^host|path$``."""
    text = F.concat(F.lit("^"), host, F.lit("|"), F.lower(path), F.lit("$"))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[pieces(n) for n in sizes]))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(prefix, verdict) of the longest fitting rule, nulls if none fits.

    A rule host/start fits its host and all subdomains where the path begins
    with /start (so an empty path fits none).  Of equal length the first listed wins.
    """
    prefix, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        prefix, verdict = F.when(fits, F.lit(rule)).otherwise(prefix), F.when(fits, F.lit(say)).otherwise(verdict)
    return prefix, verdict


def _listed(spark: SparkSession, pairs) -> DataFrame:
    if not pairs:
        return spark.sql("select cast(null as int) as label, cast(null as string) as url where false")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(y).alias("label"), F.lit(u).alias("url")) for y, u in pairs])))


def _hashed(spark: SparkSession, labelled, sizes: tuple[int, ...], buckets: int, max_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, row of each entry, bucket of each entry) of at most ``max_rows``
    distinct labelled URLs, those of least hash: one job, whatever their number."""
    table = labelled if isinstance(labelled, DataFrame) else _listed(spark, labelled)
    rows = (
        table.where("label is not null").select(F.col("label").cast("double").alias("y"), F.coalesce("url", F.lit("")).alias("url")).distinct()
        .orderBy(F.xxhash64("url", F.lit(17)), "url", "y").limit(max_rows)
        .select("y", grams(host_of(F.col("url")), path_of(F.col("url")), sizes, buckets).alias("g")).collect()
    )
    size = [len(r.g) for r in rows]
    return np.array([r.y for r in rows], float), np.repeat(np.arange(len(rows)), size), np.array([b for r in rows for b in r.g], np.int64)


def fit(y: np.ndarray, row: np.ndarray, bucket: np.ndarray, buckets: int, steps: int = 1000, rate: float = 4.0, decay: float = 1e-4, momentum: float = 0.9) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss plus ``decay`` / 2 of the squared
    weights; every row's entries weigh one over the root of their number.  Full
    gradient steps with momentum, on the driver: the rows are few."""
    w, bias = np.zeros(buckets), 0.0
    speed, pace = np.zeros(buckets), 0.0
    if not len(y):
        return w, bias
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    for _ in range(steps):
        z = np.bincount(row, w[bucket] * scale, len(y)) + bias
        e = 1 / (1 + np.exp(-z)) - y
        speed = momentum * speed - rate * (np.bincount(bucket, e[row] * scale, buckets) / len(y) + decay * w)
        pace = momentum * pace - 0.1 * rate * e.mean()
        w, bias = w + speed, bias + pace
    return w, bias


def train(spark: SparkSession, labelled, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS, max_rows: int = 20_000) -> tuple[list[float], float]:
    """Weights of the logistic regression on ``labelled``, a DataFrame (label,
    url) or a small sequence of such pairs; ``max_rows`` bounds what is fitted."""
    w, bias = fit(*_hashed(spark, labelled, sizes, buckets, max_rows), buckets)
    return w.tolist(), float(bias)


def url_filter(
    pages: DataFrame,
    labelled=LABELLED,
    rules: tuple[tuple[str, str], ...] = RULES,
    sizes: tuple[int, ...] = SIZES,
    buckets: int = BUCKETS,
    cut: float = 0.6,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per input row.

    A null URL, or one without ``://``, has an empty host and path and is
    judged by the model on those.  Null and repeated ids pass through; very
    long URLs are scored whole; other columns are ignored.  Without labelled
    rows the weights are zero, and URLs without a rule are allowed.
    """
    weights, bias = train(pages.sparkSession, labelled, sizes, buckets)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    w = F.lit(weights)
    rule, say = rule_for(F.col("host"), F.col("path"), rules)
    scored = slim.withColumn("g", grams(F.col("host"), F.col("path"), sizes, buckets))
    z = F.aggregate("g", F.lit(0.0), lambda a, i: a + F.element_at(w, i + 1)) / F.sqrt(F.size("g")) + F.lit(bias)
    return scored.withColumn("score", 1 / (1 + F.exp(-z))).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(say, F.when(F.col("score") > cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score",
    )
