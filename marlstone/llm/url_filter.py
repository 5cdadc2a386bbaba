"""URL filters: rules by host and path prefix, and logistic regression on hashed character n-grams for the rest; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, written

#: (action, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DIMENSIONS = 2048
#: The small labelled table that trains the model where no other is given: addresses to block, and ordinary ones.
BLOCKED = (
    "http://casino-royal-bonus.example/slots/free-spins", "http://best-online-casino.test/jackpot", "http://bet365-odds.example/sports/betting", "http://win-poker-chips.test/poker/lobby",
    "http://cheap-pills-shop.example/buy/viagra", "http://no-prescription-meds.test/order/pills", "http://replica-watches.example/sale/rolex", "http://fast-payday-loans.test/apply-now",
    "http://adult-cams-live.example/xxx/room1", "http://hot-xxx-videos.test/porn/watch", "http://free-crack-keygen.example/download/serial.exe", "http://warez-torrents.test/dl/movie.torrent",
    "http://ads.tracker-net.example/click?id=1", "http://popunder-adserver.test/banner/ad.js", "http://seo-links-farm.example/tag/cheap-links", "http://spam-directory.test/submit/links.html",
    "http://claim-free-prize.example/winner/login.php", "http://secure-account-verify.test/signin/update.php", "http://lottery-winner.example/claim", "http://crypto-doubler.test/invest/double-btc",
)
ORDINARY = (
    "http://city-library.example/en/catalogue/history", "http://news-daily.test/2024/05/world/report.html", "http://university.example/research/papers", "http://docs.project.test/en/guide/install",
    "http://weather-service.example/forecast/today", "http://museum.test/fr/exposition/peinture", "http://garden-blog.example/posts/roses", "http://cooking-notes.test/recipes/bread",
    "http://gemeinde.example/de/verwaltung/kontakt", "http://schule.test/de/unterricht/mathematik", "http://journal.example/articles/biology/cells", "http://encyclopedia.test/wiki/Mountain",
    "http://travel-guide.example/es/ciudades/sevilla", "http://history-society.test/archive/letters", "http://open-data.example/datasets/rivers", "http://hospital.test/patients/visiting-hours",
    "http://music-school.example/lessons/piano", "http://railway.test/timetable/north", "http://parliament.example/debates/2023", "http://astronomy-club.test/events/observing",
)
#: At most so many distinct labelled urls train the model: those with the least hash.
TRAINING_ROWS = 1500
ROUNDS, RATE, DECAY = 30, 2.0, 1e-4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null and for urls without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, like net/; its action). A rule fits its host and all subdomains if the path starts with the rule's."""
    rule = action = None
    for verb, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, verb) if action is None else action.when(fits, verb)
    return rule, action


def features(host: Column, path: Column) -> Column:
    """Hashed 3-grams of host and of path, each between marks, as an array of distinct indexes."""
    grams = lambda text, mark: F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(3))), F.lit(DIMENSIONS)).cast("int"))
    framed = lambda text: F.concat(F.lit("^^"), text, F.lit("$$"))
    return F.array_distinct(F.concat(grams(framed(host), "h"), grams(framed(path), "p")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table of this module, as rows (url, blocked)."""
    rows = [F.struct(F.lit(url).alias("url"), F.lit(blocked).alias("blocked")) for blocked, urls in ((1, BLOCKED), (0, ORDINARY)) for url in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> list[float]:
    """Weights (index 0: the constant) from rows (url, blocked 0/1): full-batch gradient descent. The table is at most TRAINING_ROWS distinct urls.

    Without rows all weights are 0; a url that is null counts as empty.
    """
    once = labelled.select("url", F.col("blocked").cast("double").alias("y")).groupBy("url").agg(F.max("y").alias("y")).orderBy(F.xxhash64("url"), "url").limit(TRAINING_ROWS)
    url = F.col("url")
    cells = written(once.select("y", features(host_of(url), path_of(url)).alias("x")).coalesce(1), "labelled")
    weights = [0.0] * (DIMENSIONS + 1)
    rows = cells.count()
    if not rows:
        return weights
    for _ in range(ROUNDS):
        error = F.try_divide(F.lit(1.0), F.lit(1.0) + F.exp(-margin(F.col("x"), weights))) - F.col("y")
        gradient = cells.select(error.alias("e"), F.explode(F.concat(F.array(F.lit(-1)), F.col("x"))).alias("i")).groupBy("i").agg(F.sum("e").alias("g")).collect()
        step = RATE / rows
        weights = [w * (1 - DECAY) for w in weights]
        for i, g in gradient:
            weights[i + 1] -= step * g
    drop(cells)
    return weights


def margin(x: Column, weights: list[float]) -> Column:
    if not any(weights):
        return F.lit(0.0)
    table = F.split(F.lit(",".join(map(repr, weights[1:]))), ",").cast("array<double>")  # folded to one literal when the plan is made
    return F.aggregate(x, F.lit(float(weights[0])), lambda s, i: s + F.get(table, i))


def judge_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """A row per row of pages: page_id, host, path, rule (null if none fits), verdict (allow or block), probability (of block).

    A rule decides where one fits, else the model. labelled (url, blocked 0/1) trains it; without one, the small table of this module
    does (labelled_urls). TRAINING_ROWS of its urls are taken. Null urls and urls without :// have an empty host and path and are judged too.
    Null ids are passed on, repeated rows are judged alike, extra columns are ignored, and an empty table gives an empty result.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    weights = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(features(F.col("host"), F.col("path")), weights)))
    scored = parts.withColumn("rule", rule).withColumn("action", action).withColumn("probability", F.when(F.col("action").isNull(), score))
    verdict = F.coalesce("action", F.when(F.col("probability") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")

