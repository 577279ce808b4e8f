"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Rules are a short list (at most MAX_RULES) and become one expression, so judging a table of URLs needs no shuffle. The model is
fitted by full-batch gradient steps over a small labelled URL table, bounded by max_labelled; each step is one aggregate to at
most `buckets` rows. Judging sums the weights of a URL's n-grams in one expression. The labelled names are also put into ordinary frames, beside made names that are
allowed, so that a host unlike any labelled one is no coin toss; the cut is calibrated on URLs that are held out.

Defined cases: a null URL or one without "://" has empty host and path, no rule, and the model's verdict on an empty URL, as
its bias and its marked ends say; repeated rows are judged alike; a null or repeated page_id is only carried; whole URLs are read, however long;
an empty table of pages gives no rows, and its other columns are not read; an empty or one-sided labelled table gives a model of its bias alone.
Of rules that fit, the longest (host and path together) wins; of equally long ones, the first by (host, path). A probability equal to the cut blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize

MAX_RULES = 1000
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# A small labelled URL table, written by hand for this model without a look at any judged table. The HELD_OUT part is never fitted on.
BLOCKED_URLS = """
http://www.cheapmeds-online.biz/order/pills https://buy-viagra-now.info/index.html http://discount-pharmacy.top/no-prescription/ https://best-pills4u.ru/cialis
https://lucky-casino-slots.com/bonus/free-spins http://online-poker-bets.net/play-now https://bigwin-jackpot.club/casino/ http://sportsbet-bonus.xyz/register
https://hot-xxx-videos.tv/watch/1234 http://adult-cams-live.net/sexy http://porn-tube-free.org/hd/ https://naughty-sex-dates.com/join
http://free-warez-download.to/crack/keygen.exe https://cracked-games-torrent.cc/full-version http://serial-keygen.ru/photoshop-crack https://torrent-movies-free.ws/dvdrip
http://win-free-iphone.click/prize/claim https://secure-login-verify-account.tk/bank/ http://paypal-account-update.ml/signin.php https://you-won-lottery.gq/claim-prize
http://make-money-fast.biz/get-rich https://payday-loans-instant.info/apply http://work-from-home-cash.top/earn https://crypto-doubler-profit.xyz/invest
http://replica-watches-cheap.cn/rolex https://cheap-designer-bags.shop/replica http://weight-loss-miracle.pw/diet-pills https://seo-backlinks-cheap.link/buy
http://click-ads-track.com/banner/popunder https://popup-adserver.net/redirect?id=1 http://spam-links-farm.info/links.php https://mass-mailer-bulk.ru/email-list
""".split()
ALLOWED_URLS = """
https://www.citylibrary.org/catalogue/history https://news.harbourtimes.com/2021/05/local-council http://www.botanicgarden.edu/plants/roses https://docs.softwareproject.io/guide/install
https://museum.nationalheritage.gov/exhibits/archaeology http://weather.coastalservice.gov/forecast/monday https://recipes.homekitchen.co.uk/bread/sourdough https://www.railwayhistory.org.uk/stations
https://physics.stateuniversity.edu/courses/mechanics http://journal.openmedicine.org/articles/1234 https://encyclopedia.worldatlas.net/wiki/Mountains https://forum.woodworkers.org/threads/hand-planes
http://www.schooldistrict.k12.us/calendar https://blog.astronomyclub.org/observing/jupiter https://parliament.publicrecord.gov/debates/2019 https://www.gardeningmonthly.com/tomatoes
https://travel.alpinehikers.ch/routes/valley http://poetry.literaryreview.org/issues/spring https://hospital.regionalhealth.org/departments/cardiology https://www.chamberorchestra.org/concerts
http://archive.oldnewspapers.org/1901/march https://data.statisticsoffice.gov/tables/population https://learn.mathematics.edu/algebra/lesson-3 https://www.birdwatchers.net/species/heron
https://law.courtreports.gov/opinions/2010 http://chess.localclub.org/tournaments https://www.farmersweekly.com/articles/wheat-harvest https://support.computerstore.com/manuals/printer
https://theatre.cityculture.org/programme http://geology.surveydata.gov/maps/rivers https://www.childrensbooks.org/reviews https://community.linguistics.edu/grammar/verbs
""".split()
HELD_OUT_BLOCKED_URLS = """
http://viagra-pills-discount.biz/buy https://casino-bonus-bets.club/slots http://xxx-adult-porn.tv/videos https://warez-crack-keygen.to/download
http://free-prize-claim-now.click/win https://bank-account-verify.tk/login.php http://cheap-replica-rolex.shop/watches https://instant-cash-loans.top/payday
http://poker-jackpot-spins.xyz/play https://sex-cams-free.com/live http://torrent-cracked.ws/games https://bulk-email-spam.ru/list
""".split()
HELD_OUT_ALLOWED_URLS = """
https://library.stateuniversity.edu/history/maps http://news.localtimes.org/2020/council https://www.gardenplants.org/roses/spring https://docs.openproject.io/manual/install
https://weather.regionalservice.gov/forecast http://museum.cityheritage.org/exhibits https://www.kitchenrecipes.co.uk/tomatoes https://journal.historyreview.edu/articles/1901
https://forum.birdclub.org/threads/observing http://courses.mathematics.edu/mechanics https://www.orchestraconcerts.org/programme https://data.surveyoffice.gov/tables/wheat
""".split()
#: Frames of framed(): where a name stands in ordinary URLs, with a number.
FRAMES = [
    "https://www.{name}.com/en/{n}",
    "http://{name}.org/index.html",
    "https://blog.{name}.net/fr/{n}/",
    "http://m.{name}.info/{n}/page.html",
    "https://{name}.co.uk/de/{n}.html?id={n}",
    "http://www.{name}.net/",
    "https://{name}.pages.org/es/{n}",
]


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The labelled URL table (url, blocked), or the part of it that is held out."""
    blocked, allowed = (HELD_OUT_BLOCKED_URLS, HELD_OUT_ALLOWED_URLS) if held_out else (BLOCKED_URLS, ALLOWED_URLS)
    return spark.createDataFrame([(u, True) for u in blocked] + [(u, False) for u in allowed], "url string, blocked boolean")


def framed(labelled: DataFrame, ordinary: int = 400, series: int = 0) -> DataFrame:
    """labelled (url, blocked) and, by rule, its hosts' names under ordinary frames, the same ones for both labels, so that neither a subdomain
    nor a top-level domain nor a number in a path tells a label; and as many allowed names as `ordinary` says, made of syllables,
    which stand for hosts unlike any labelled one. series: another number gives other such names. A null URL has an empty name; an empty table gives the made names alone."""
    spark = labelled.sparkSession
    host = F.split(url_parts(F.col("url"))[0], r"\.")
    # The name is the longest label of a host.
    names = labelled.select(F.element_at(F.array_sort(host, lambda a, b: F.length(b) - F.length(a)), 1).alias("name"), "blocked").distinct()
    syllables = [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"]
    made = spark.range(ordinary).select(F.concat(*[F.element_at(F.array(*map(F.lit, syllables)), (F.pmod(F.xxhash64("id", F.lit(k), F.lit(series)), F.lit(len(syllables))) + 1).cast("int")) for k in range(3)]).alias("name"), F.lit(False).alias("blocked"))
    frames = F.explode(F.array(*map(F.lit, FRAMES)))
    own = names.select("name", "blocked", frames.alias("frame"))
    # A made name has one frame, by its hash.
    few = made.select("name", "blocked", F.element_at(F.array(*map(F.lit, FRAMES)), (F.pmod(F.xxhash64("name"), F.lit(len(FRAMES))) + 1).cast("int")).alias("frame"))
    number = F.pmod(F.xxhash64("name", "frame"), F.lit(1000)).cast("string")
    every = own.unionByName(few).select(F.replace(F.replace("frame", F.lit("{name}"), F.col("name")), F.lit("{n}"), number).alias("url"), "blocked")
    return labelled.select("url", "blocked").unionByName(every).distinct()


def calibrated_cut(held_out: DataFrame, model: tuple[list[float], float], least_precision: float = 0.95) -> tuple[float, float, float]:
    """The cut that blocks most of the blocked rows of held_out (url, blocked), none of which the model was fitted on, while at least least_precision of what it
    blocks is so labelled; with its precision and recall. 1.0, 1.0 and 0.0 if there is none. The cut lies halfway to the next lower probability."""
    rows = held_out.where("blocked is not null").select(F.struct("url", F.col("blocked").cast("int").alias("y")).alias("page_id"), "url")
    told = judge_urls(rows, model, rules=[]).groupBy("p_block").agg(F.sum("page_id.y").alias("hit"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("p_block"))  # a bounded table of labelled rows
    sums = told.select("p_block", F.lead("p_block", 1, 0.0).over(down).alias("below"), F.sum("hit").over(down).alias("hit"), F.sum("n").over(down).alias("n"), F.sum("hit").over(Window.partitionBy()).alias("all"))
    best = sums.where(F.col("hit") >= least_precision * F.col("n")).select(((F.col("p_block") + F.col("below")) / 2).alias("cut"), F.col("hit") / F.col("n"), F.col("hit") / F.col("all"), "hit").orderBy(F.desc("hit"), F.desc("cut")).first()
    return (best[0], best[1], best[2]) if best and best[3] else (1.0, 1.0, 0.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without a "://"."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def ngram_buckets(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """0-based bucket of each character n-gram of host and of path, both with their ends marked; repeats stay."""

    def grams(marked: Column, n: int) -> Column:
        last = F.length(marked) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substr(marked, i, F.lit(n))), F.lit(buckets)).cast("int"))

    marked = [F.concat(F.lit(f"{m}^"), x, F.lit("$")) for m, x in (("h", host), ("p", path))]
    return F.concat(*[grams(x, n) for x in marked for n in sizes])


def fit(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), buckets: int = 4096, steps: int = 24, rate: float = 30.0, ridge: float = 1e-4, max_labelled: int = 2000) -> tuple[list[float], float]:
    """Weights, and as bias the log odds of a block, from rows (url, blocked), of which at most max_labelled are used, those of the least hash."""
    host, path = url_parts(F.col("url"))
    few = labelled.where("blocked is not null").select("url", F.col("blocked").cast("double").alias("y")).distinct().orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled)
    few = few.select("y", ngram_buckets(host, path, sizes, buckets).alias("b"))
    few = materialize(few.withColumn("v", 1 / F.sqrt(F.greatest(F.size("b"), F.lit(1)))), "url-labelled").coalesce(1)  # a bounded table: one task, no shuffle
    n, positive = few.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    bias = math.log((positive + 1) / (n - positive + 1))
    weights = [0.0] * buckets
    if not 0 < positive < n:
        return weights, bias
    for _ in range(steps):
        told = few.select("y", "b", "v", _score(F.col("b"), F.col("v"), weights, bias).alias("p"))
        pushed = told.select(((F.col("p") - F.col("y")) * F.col("v") / n).alias("g"), F.explode("b").alias("at"))
        for at, g in pushed.groupBy("at").agg(F.sum("g")).collect():  # at most buckets rows
            weights[at] -= rate * (g + ridge * weights[at])
    return weights, bias


def calibrated_model(spark: SparkSession, steps: int = 60) -> tuple[tuple[list[float], float], float]:
    """The model fitted on the framed labelled table (some 900 URLs), and its cut, calibrated on the framed part that is held out, with made names of its own."""
    model = fit(framed(labelled_urls(spark)), steps=steps)
    return model, calibrated_cut(framed(labelled_urls(spark, held_out=True), series=1), model)[0]


def _score(b: Column, v: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a literal
    total = F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(table, k))
    return 1 / (1 + F.exp(-(F.lit(bias) + v * total)))


def judge_urls(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES, sizes: tuple[int, ...] = (3, 4), cut: float = 0.5) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and p_block, the model's probability of a block."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    b = ngram_buckets(F.col("host"), F.col("path"), sizes, len(model[0]))
    parts = parts.withColumn("b", b).withColumn("p_block", _score(F.col("b"), 1 / F.sqrt(F.greatest(F.size("b"), F.lit(1))), *model))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("p_block") >= cut, "block").otherwise("allow"))
    return parts.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("p_block", 6).alias("p_block"))
