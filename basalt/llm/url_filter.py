"""URL filter: prefix rules, and for URLs that no rule fits a logistic regression, in DataFrame operations only.

Features are character n-grams of host and path, hashed into a fixed number of buckets. The regression is trained by
stochastic gradient steps, written as one fold over a small labelled table; its weights (a fixed number of doubles) become a
literal of the scoring expression. Judging a URL reads its row alone: no shuffle, no hot host.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule whose path is not empty and scores
like an empty string; of rules of equal length the one that sorts first wins; repeated rows are judged alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BUCKETS, SIZES, EPOCHS, RATE, DECAY = 1 << 15, (3, 4, 5), 16, 2.0, 1e-4
#: Score from which a URL without a rule is blocked.
CUT = 0.65
#: Hosts of the labelled table; every host stands there with every path, so that paths alone decide little.
BLOCKED = (
    "spam-farm.example.net", "spam-links.example.com", "spamhub.example.org", "link-farm.example.org", "content-farm.example.com", "casino-bonus.example.net",
    "best-casino.example.org", "casino-spins.example.com", "win-big.example.net", "win-prizes.example.org", "cheap-pills.example.org", "pills-online.example.net",
    "cheap-meds.example.com", "adult-video.example.net", "adult-chat.example.org", "xxx-cams.example.com", "free-spins.example.org", "free-bets.example.com",
    "sports-bets.example.net", "free-download.example.net", "torrent-crack.example.org", "payday-loans.example.com", "fast-loans.example.net", "lottery-winner.example.org",
    "click-here.example.com", "login-verify.example.net",
)
ALLOWED = (
    "www.example.com", "blog.example.net", "m.example.org", "news.example.com", "docs.example.org", "library.example.net", "university.example.org",
    "museum.example.com", "weather.example.net", "city.example.org", "recipes.example.com", "gardening.example.net", "history.example.org", "science.example.com",
    "travel.example.net", "wiki.example.org", "health.example.com", "school.example.net", "music.example.org", "forum.example.com", "books.example.net",
    "maps.example.org", "shop.example.com", "trains.example.net", "farmers-market.example.org", "freedom-press.example.com", "winter-sports.example.net", "wind-energy.example.org",
)
PATHS = ("/en/128", "/de/305/", "/fr/47.html", "/es/9")
#: (1 = block, host, path); bare and blog hosts of both kinds
LABELLED = tuple(
    (y, lead + host, PATHS[(i + k) % len(PATHS)]) for y, hosts in ((1, BLOCKED), (0, ALLOWED)) for i, host in enumerate(hosts) for k, lead in enumerate(("", "blog."))
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Rules are a short list and become one CASE."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), *[-ord(c) for c in r[1]])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def buckets_of(host: Column, path: Column, buckets: int, sizes) -> Column:
    """Bucket numbers of the n-grams of ^host$ and ^path$, repeats included."""

    def grams(text: Column, n: int, part: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part * 8 + n), marked.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*[grams(text, n, part) for part, text in enumerate((host, path)) for n in sizes])


def train(spark: SparkSession, labelled, buckets: int = BUCKETS, sizes=SIZES, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights of the buckets and, last, the bias, from (label, host, path) rows: one row of one small table.

    Steps follow a hash of the row numbers, so that labels alternate however the table is ordered.
    """
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {float(y)}D, {quote(h)}, {quote(p)})" for i, (y, h, p) in enumerate(labelled)) + " AS t(i, y, host, path)")
    found = rows.withColumn("at", buckets_of(F.col("host"), F.col("path"), buckets, sizes))
    found = found.select("i", "y", F.size("at").alias("n"), F.explode("at").alias("b")).groupBy("i", "y", "n", "b").count()
    found = found.groupBy("i", "y", "n").agg(F.collect_list(F.struct("b", "count")).alias("counts"))
    # steps run over the buckets that the table uses; the others keep weight zero
    table = found.agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("i").alias("h"), "y", "n", "counts"))).alias("rows"))
    table = table.withColumn("used", F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["counts"]["b"])))))

    def dense(r: Column) -> Column:
        values = F.transform(
            F.array(F.map_from_entries(r["counts"])),
            lambda m: F.transform("used", lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0)).cast("double") / F.sqrt(r["n"].cast("double"))),
        )[0]
        return F.struct(r["y"].alias("y"), F.concat(values, F.array(F.lit(1.0))).alias("x"))

    examples = table.select("used", F.transform("rows", dense).alias("rows"))

    def step(w: Column, e: Column) -> Column:
        margin = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        error = F.array(e["y"] - 1 / (1 + F.exp(-margin)))  # held in an array so that it is computed once
        return F.transform(error, lambda r: F.zip_with(w, e["x"], lambda a, b: a * (1 - rate * decay) + b * r * rate))[0]

    start = F.transform("used", lambda b: F.lit(0.0))
    fold = F.aggregate(F.flatten(F.array_repeat("rows", epochs)), F.concat(start, F.array(F.lit(0.0))), step)
    got = examples.select("used", fold.alias("w")).first()
    weights = [0.0] * buckets + [got["w"][-1]]
    for b, w in zip(got["used"], got["w"], strict=False):
        weights[b] = w
    return weights


def score_of(host: Column, path: Column, weights: list[float], sizes) -> Column:
    table = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    at = buckets_of(host, path, len(weights) - 1, sizes)
    total = F.aggregate(at, F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(at).cast("double")) + F.lit(float(weights[-1])))))


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, weights: list[float] | None = None, threshold: float = CUT
) -> DataFrame:
    """(id_col, host, path, rule, verdict, block_score), one row per page."""
    weights = weights or train(pages.sparkSession, labelled)
    url = pages[url_col].cast("string")
    split = pages.select(pages[id_col].alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = split.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("block_score", score_of(F.col("host"), F.col("path"), weights, SIZES))
    own = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "block_score")


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
