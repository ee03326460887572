"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

Features of a url are the character n-grams (3 to 5) of `^host$` and those of its path (3 and 4),
each kind hashed with its own seed into one table of weights; a url's value is the bias plus the weights
of its host n-grams over the root of their number, and a quarter of the same for its path. The weights are learned by
gradient descent over LABELLED, in one SQL expression over a table of that fixed size; scoring is a
sum over array functions. Everything on the main path is DataFrame operations.

Defined results: a null url, or one without ://, has an empty host and path, and an url without any n-gram
is allowed with score 0; repeated rows each give a row; an empty table gives an empty result; long urls are
read whole; columns other than the id and the url are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The rules, as host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The labelled urls: what is blocked (1) and what is allowed (0). Hosts and paths of both kinds have the same forms, so
#: that words tell them apart.
BLOCKED = """
casino-win.example.org/en/7 best-casino.example.biz/win/now casino-bonus.example.org/play free-casino.example.info/es/slots
www.casino-royal.example.net/en/1 online-casino.example.org/fr/88 poker-win.example.info/table/2 m.poker-stars.example.biz/en/310
big-jackpot.example.org/de/9 jackpot-slots.example.net/es/4 win-prize.example.org/claim free-prize.example.net/en/61
free-win.example.net/en/lottery lottery-winner.example.org/fr/17 free-bets.example.org/es/31 m.free-bets.example.net/en/640
bets-live.example.org/en/odds sports-bets.example.info/de/204 blog.bets.example.biz/en/2 cheap-pills.example.org/en/450
cheap-pills.example.net/de/20 m.cheap-pills.example.org/fr/410 pills-online.example.biz/en/offer pills.example.info/de/1
cheap-meds.example.info/buy/4 meds-discount.example.org/es/76 www.diet-pills.example.net/fr/3 cheap-viagra.example.biz/en/5
cheap-loans.example.biz/apply payday-loans.example.org/en/12 fast-loans.example.net/de/44 cheap.example.org/en/300
cheap-watches.example.info/fr/8 replica-watches.example.org/es/92 adult-x.example.org/en/99 blog.adult-x.example.net/en/8
adult-video.example.info/x/1 adult.example.biz/fr/6 www.adult-cams.example.org/de/55 xxx-adult.example.biz/en/55
xxx-video.example.net/es/18 hot-xxx.example.org/en/7200 ads-track.example.org/fr/5 ads-track.example.net/en/3
www.ads-track.example.org/en/903 track-ads.example.info/click adserver-track.example.biz/pixel ads.example.org/en/61
popup-ads.example.net/de/31 click-track.example.org/es/6 m.ads-click.example.info/en/19 banner-ads.example.biz/fr/250
spam-farm.example.org/en/12 spam-farm.example.net/en/77 www.spam-farm.example.org/de/19 spam.example.org/en/853
link-farm.example.info/en/9 farm-spam.example.info/fr/8 spam-links.example.biz/en/14 blog.link-spam.example.net/es/73
""".split()
ALLOWED = """
library.example.org/en/7 www.library.example.net/de/204 museum.example.net/en/visit/hours museum.example.biz/fr/17
university.example.org/en/courses/55 m.university.example.info/es/31 weather.example.org/forecast/today weather.example.net/en/640
recipes.example.net/soup/2 blog.recipes.example.org/fr/5 garden.example.org/plants/14 www.garden.example.biz/en/12
railway.example.net/timetable railway.example.org/de/9 history.example.org/archive/1912 history.example.info/en/3
news.example.net/en/world/99 m.news.example.org/es/4 health.example.org/advice/6 hospital.example.net/en/853
maps.example.net/de/region maps.example.org/en/61 school.example.org/en/term blog.school.example.net/fr/88
science.example.net/journal/12 science.example.biz/en/450 music.example.org/concerts/5 www.music.example.net/es/76
theatre.example.info/tickets/3 theatre.example.org/en/19 travel.example.net/islands/8 m.travel.example.org/fr/410
kitchen.example.org/bread/4 kitchen.example.net/de/44 cinema.example.org/en/99 books.example.net/novels/21
www.books.example.org/en/903 poetry.example.biz/fr/6 bicycle.example.org/routes/9 bicycle.example.info/en/2
football.example.net/league/table tennis.example.org/en/310 chess.example.org/openings/7 chess.example.net/en/14
mountain.example.info/trails/11 ocean.example.org/tides/2 river.example.net/en/8 forest.example.org/de/1
astronomy.example.org/en/planets/5 biology.example.net/cells/3 chemistry.example.biz/en/9 physics.example.org/es/92
mathematics.example.net/en/300 geometry.example.org/fr/8 language.example.info/grammar/4 dictionary.example.org/en/7200
parliament.example.net/laws/31 council.example.org/en/12 police.example.biz/advice/2 court.example.net/de/55
village.example.org/en/5 city-hall.example.net/offices/6 town-market.example.org/en/20 old-bridge.example.info/fr/3
blue-house.example.net/en/18 red-stone.example.org/de/31 green-hill.example.biz/es/6 white-river.example.org/en/250
north-wind.example.net/en/73 my-family.example.info/photos/1 open-source.example.org/docs/2 data-tables.example.net/en/77
software.example.org/manual/10 hardware.example.net/fr/250 wiki.example.info/en/article/88 forum.example.org/topic/19
bakery.example.net/de/20 butcher.example.org/en/1 tailor.example.biz/es/18 carpenter.example.net/en/55
teacher.example.org/lessons/6 doctor.example.net/en/44 nurse.example.info/fr/61 lawyer.example.org/de/853
painter.example.net/gallery/9 sculpture.example.org/en/204 pottery.example.biz/en/17 orchestra.example.net/es/73
bibliothek.example.org/de/7 strasse.example.net/de/3 gesundheit.example.info/de/12 montagne.example.org/fr/76
bonjour.example.net/fr/19 jardin.example.biz/fr/2 biblioteca.example.org/es/99 escuela.example.net/es/5
ciudad.example.info/es/640 zeitung.example.org/de/450 journal.example.net/fr/31 revista.example.biz/es/88
blog.ernest.example.org/en/4 m.thornton.example.net/fr/14 www.anders.example.info/en/92 edith.example.org/de/410
""".split()
LABELLED = [*((f"http://{u}", 1.0) for u in BLOCKED), *((f"http://{u}", 0.0) for u in ALLOWED)]

BUCKETS = 1 << 14
#: What a path counts beside a host: paths are mostly numbers.
PATH = 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and what it says; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, sizes: tuple[int, ...], seed: int) -> Column:
    """Buckets (from 1) of the character n-grams of text."""

    def of(chars: Column, k: int) -> Column:
        n = F.size(chars)
        gram = lambda i: F.concat(*[F.element_at(chars, i + F.lit(j)) for j in range(k)])
        bucket = lambda i: (F.pmod(F.xxhash64(gram(i), F.lit(seed)), F.lit(BUCKETS)) + 1).cast("int")
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), bucket)).otherwise(F.array().cast("array<int>"))

    # the characters are bound once, as a lambda's argument: written out, they would be split again for every n-gram
    return F.transform(F.array(F.split(text, "")), lambda chars: F.concat(*[of(chars, k) for k in sizes]))[0]


def features(host: Column, path: Column) -> tuple[Column, Column]:
    """Buckets of host and path; an empty host or path has none."""
    none = F.array().cast("array<int>")
    a = F.when(host != "", grams(F.concat(F.lit("^"), host, F.lit("$")), (3, 4, 5), 1)).otherwise(none)
    return a, F.when(path != "", grams(path, (3, 4), 2)).otherwise(none)


def trained(spark: SparkSession, labelled: list[tuple[str, float]] = LABELLED, rounds: int = 40, rate: float = 100.0, decay: float = 0.005) -> tuple[list[float], float]:
    """The weight of each bucket and the bias, from urls and their labels (1: to block).

    Gradient descent on the mean logistic loss, in the dual: the weights are a sum of the labelled
    urls' features, so each round updates one number a url from the table of their inner products,
    whose size is the square of the fixed number of labelled urls.
    """
    t = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "i int, url string, y double").coalesce(1)
    t = t.select("i", "y", *[c.alias(k) for c, k in zip(features(host(F.col("url")), path(F.col("url"))), ("a", "b"), strict=True)])
    x = t.select("i", F.explode("a").alias("f"), (1 / F.sqrt(F.size("a"))).alias("v")).union(t.select("i", F.explode("b"), PATH / F.sqrt(F.size("b"))))
    x = x.groupBy("i", "f").agg(F.sum("v").alias("v"))
    pairs = x.alias("p").join(x.alias("q"), F.col("p.f") == F.col("q.f")).select(F.col("p.i").alias("i"), F.col("q.i").alias("j"), (F.col("p.v") * F.col("q.v")).alias("k"))
    products = pairs.groupBy("i", "j").agg(F.round(F.sum("k"), 12).alias("k"))
    n = len(labelled)
    by_j = products.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("m"))
    row = by_j.select("i", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0))).alias("ks"))
    data = row.join(t.select("i", "y"), "i").agg(F.array_sort(F.collect_list(F.struct("i", "ks", "y"))).alias("rows"))
    zero = F.array_repeat(F.lit(0.0), n + 1)

    def step(alpha: Column, _: Column) -> Column:
        def gradient(r: Column) -> Column:
            margin = F.aggregate(F.zip_with(r["ks"], F.slice(alpha, 1, n), lambda k, a: k * a), F.element_at(alpha, n + 1), lambda s, z: s + z)
            return r["y"] - 1 / (1 + F.exp(-margin))

        g = F.transform(F.col("rows"), gradient)
        new = F.zip_with(F.slice(alpha, 1, n), g, lambda a, d: a * F.lit(1 - decay) + d * F.lit(rate / n))
        bias = F.element_at(alpha, n + 1) + F.aggregate(g, F.lit(0.0), lambda s, z: s + z) * F.lit(1.0 / n)
        return F.concat(new, F.array(bias))

    alpha = data.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, step).alias("al"))
    learned = alpha.first()["al"]  # one number for each labelled url, and the bias
    per_url = spark.createDataFrame(list(enumerate(learned[:n])), "i int, a double").coalesce(1)
    by_bucket = x.join(per_url, "i").groupBy("f").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    weights = [0.0] * BUCKETS
    for f, w in by_bucket.collect():  # BUCKETS rows at most
        weights[f - 1] = round(w, 9)
    return weights, learned[n]


def score(host: Column, path: Column, weights: Column, bias: Column) -> Column:
    """The chance, 0 to 1, that the url should be blocked; 0 for an url without a feature."""
    total = lambda fs: F.aggregate(fs, F.lit(0.0), lambda s, f: s + F.element_at(weights, f)) / F.sqrt(F.greatest(F.size(fs), F.lit(1)))
    norm = lambda fs: F.transform(F.array(fs), total)[0]  # noqa: E731  (bound once, as in grams)
    a, b = features(host, path)
    return F.when((host == "") & (F.length(path) < 3), 0.0).otherwise(1 / (1 + F.exp(-(bias + norm(a) + F.lit(PATH) * norm(b)))))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: list[tuple[str, float]] = LABELLED) -> DataFrame:
    """id_col, host, path, rule, verdict, score of each row. labelled: the urls to learn from."""
    spark = pages.sparkSession
    learned, bias = trained(spark, labelled)
    weights = F.split(F.lit(",".join(map(repr, learned))), ",").cast("array<double>")
    url = F.col("__url")
    t = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("__url")).select(id_col, host(url).alias("host"), path(url).alias("path"))
    rule, says = rule_and_verdict(F.col("host"), F.col("path"))
    t = t.select(id_col, "host", "path", rule.alias("rule"), says.alias("says"), score(F.col("host"), F.col("path"), weights, F.lit(bias)).alias("score"))
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return t.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
