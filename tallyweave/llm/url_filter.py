"""URL filter, with DataFrame operations only: allow and block rules by host and path, and for the rest a
logistic regression on hashed character n-grams of host and path, trained from a small labelled URL table.

The work on the pages is one pass without a shuffle. The rules are a fixed list turned into one
expression. The model has FEATURES weights, whatever the number of pages; the labelled table is bounded by
MAX_LABELLED rows (more are cut down to those with the smallest hashes, which is the documented bound of
the training sample). N-grams are cut from arrays of characters, so a long URL costs in proportion.

Null urls and urls without `://` have an empty host and path, no n-grams and no rule, and are allowed.
Empty hosts or paths simply give no n-grams. Repeated rows repeat. An empty labelled table allows whatever
no rule decides. Extra columns of the input are dropped.
"""

from __future__ import annotations

import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import hash64, table

FEATURES, SIZES, THRESHOLD, REGULARIZATION = 1 << 13, (3, 4, 5), 0.5, 0.001
MAX_LABELLED = 20_000
#: (verdict, host and path), as the query's contract names them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The labelled table: addresses made up for this purpose, one per line, by what they stand for.
BLOCKED = """
cheap-meds.example/buy/1.html online-pills.example/order best-pills-shop.example/en/12 pharma-discount.example/sale
pills4u.example/cart cheap-replica.example/watches cheap-loans.example/apply spam-mailer.example/list bulk-spam.example/send
spam-links.example/page/3 link-farm.example/out/77 seo-farm.example/a/1 content-farm.example/x casino-royal.example/play
online-casino.example/bonus casino-slots.example/spin big-win-slots.example/jackpot win-money.example/now poker-win.example/table
lucky-win.example/claim free-bets-now.example/odds sport-bets.example/live best-bets.example/tips bets-online.example/join
betting-tips.example/free free-gift.example/claim free-iphone.example/win adult-chat.example/room adult-videos.example/watch adult-films.example/new adult-net.example/en/4 adult-x-cams.example/es/2
xxx-adult.example/cams adult-dating.example/meet sexy-adult.example/pics hot-xxx.example/video porn-tube.example/v/1
ads-tracker.example/pixel ads-click.example/c track-ads.example/t ad-track.example/px click-track.example/r
popup-ads.example/show banner-ads.example/b tracking-pixel.example/p.gif malware-drop.example/exe phish-login.example/verify
warez-crack.example/keygen crack-serial.example/dl torrent-warez.example/get hack-tools.example/crack scam-offer.example/deal
crypto-scam.example/double get-rich.example/fast payday-loans.example/cash cheap-viagra.example/buy rolex-replica.example/shop
"""
ALLOWED = """
www.university.example/courses/2021 library.example/catalog/12 docs.example/guide/install blog.travelnotes.example/rome
news.daily.example/world/article-5 science.example/papers/88 museum.example/exhibits school.example/en/students
gov.example/forms/tax weather.example/today recipes.example/soup/3 gardening.example/roses m.sportsnews.example/match/9
books.example/review/44 history.example/fr/12 music.example/de/album encyclopedia.example/wiki/Tree maps.example/city
wiki.example/en/History developer.example/reference/api forum.cycling.example/thread/100 blog.kitchen.example/en/214
health.example/articles/sleep journal.example/es/volumen photos.example/gallery/2 astronomy.example/en/453
www.hospital.example/contact language.example/fr/748 m.cinema.example/en/673 theatre.example/tickets/5
parks.example/trails blog.painting.example/de/49 opensource.example/project/readme math.example/lessons/7
chess.example/games/1 www.orchestra.example/de/511 trains.example/timetable blog.knitting.example/en/27
economy.example/reports/2020 law.example/statutes/4 m.birds.example/en/196 archive.example/1999/05
radio.example/programme geology.example/rocks blog.theory.example/net/10 www.thinking.example/es/883 nation.example/en/78
other.example/en/625.html station.example/de/252.html m.motion.example/en/949 blog.author.example/en/625
thread.example/en/453 www.father.example/fr/825 blog.north.example/es/750 tradition.example/en/99 fashion.example/en/217
www.southern.example/en/773 blog.nature.example/en/453 m.weather.example/de/742 www.ethics.example/en/699
reading.example/en/118 www.tenth.example/en/125 m.earth.example/fr/357 blog.question.example/net/67
"""
NEUTRAL = ("/en/12", "/fr/8.html", "/de/742/", "/es/99", "/en/5.html", "/fr/31/", "/", "")


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if found is None else found


def grams(text: Column, tag: str) -> Column:
    """Character n-grams of a text between marks, digits as one sign, each with the tag ahead."""
    chars = F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$")), "")
    cut = lambda n: F.transform(
        F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit(tag), F.array_join(F.slice(chars, i, n), "")),
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*[cut(n) for n in SIZES]))


def features(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return urls.withColumn("host", host).withColumn("path", path).withColumn("grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the table above; label 1 is to be blocked."""
    rows = [(f"http://{u}", float(label)) for label, text in ((1, BLOCKED), (0, ALLOWED)) for u in text.split()]
    # Each host once more with a path that speaks for neither side.
    rows += [(f"{u[: u.index('/', 7)]}{NEUTRAL[i % len(NEUTRAL)]}", label) for i, (u, label) in enumerate(rows)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {label}D)" for u, label in rows) + " AS t(url, label)")


def train(labelled: DataFrame) -> PipelineModel | None:
    """The model, or None without rows of both labels."""
    rows = features(labelled.where("url is not null and label in (0, 1)").orderBy(hash64(F.col("url")), "url").limit(MAX_LABELLED))
    if rows.select("label").distinct().count() < 2:
        return None
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return PipelineModel([hashing, LogisticRegression(maxIter=60, regParam=REGULARIZATION).fit(hashing.transform(rows))])


def filter_urls(pages: DataFrame, model: PipelineModel | None, key: str = "page_id", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    rows = features(pages.select(key, "url"))
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = model.transform(rows).withColumn("score", F.when(F.size("grams") > 0, vector_to_array("probability")[1]).otherwise(0.0))
    rows = rows.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(key, "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))
