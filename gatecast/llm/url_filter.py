"""URL filters: block and allow rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host and the start of a path. One fits its host and all subdomains if the url's path
starts with the rule's path; the longest wins. The rules (at most ``MOST_RULES``) are literals in the
plan, so judging is one projection without a join or a shuffle.

Other urls are judged by boosted trees (Spark ML) over: lengths, depth of the path, labels and
hyphens of the host, share of digits, entropy of the host's characters, parameter count, and suffix
statistics: the smoothed log odds of being bad of the host's top-level label and of its worst part
(parts lie between dots and hyphens). Statistics and trees come from a table of labelled urls
(url, bad) alone, at most ``LABELLED`` of them by least MD5, so both are bounded and broadcast safely.

Nulls: a null url, or one without "://", has an empty host and an empty path, fits no rule and is
judged by its features. Rules of equal length that both fit cannot exist (they would be the same
rule). Repeated rows are judged each. Empty tables give empty results. Without urls of both classes
every url that no rule fits is allowed. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.llm.common import lower_ascii

LABELLED = 20_000
MOST_RULES = 1_000
TREES, DEPTH = 20, 3
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_share", "entropy", "parameters", "top_odds", "part_odds"]

# Fixed values: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# A small labelled table: names of hosts of each class, the suffixes they stand under, and paths: those of one class, and some that
# both have. No host of it needs to be among the judged ones.
BAD_NAMES = """
best-casino online-casino-bonus slots-win poker-free-chips sport-bets bets-bonus roulette-king24 pills-online cheap-meds24 pharma-discount
buy-viagra-cheap adult-cams xxx-video sex-chat hot-adult-dates track-click ads-server adclick tracker-pixel popup-ads link-farm seo-spam mail-spam
free-prize-win win-iphone-free cheap-loans payday-loans24 fast-cash-win crypto-double malware-drop phish-login warez-crack free-keygen torrent-free-hd
cheap-replica-watches verify-account-7781 secure-login-update lucky-spin777 hot-offers4u
"""
GOOD_NAMES = """
news daily-herald the-times city-library university physics-notes open-data health-advice garden kitchen-recipes travelnotes mountain-weather
open-source code-review python-guide mathforum history-museum art-gallery local-council parliament court-records school-board language-course
dictionary encyclopedia book-club poetry music-lessons chess bicycle-repair river-trust birdwatch astronomy theatre filmreview railway-times
bus-routes weather24 therapist thinkers
"""
BAD_SUFFIXES = ["example.com", "example.org", "example.net", "pages.top", "pages.click", "host.xyz", "host.info"]
GOOD_SUFFIXES = ["example.com", "example.org", "example.net", "site.edu", "site.org", "site.gov", "pages.net"]
BOTH_PATHS = ["/", "/en/12", "/de/345/", "/en/678.html", "/fr/901?page=2&ref=x", "/es/23?utm_source=feed", "/en/4#top", "/en/84230.html", "/fr/7817?page=2&ref=x", "/de/59062/"]
BAD_PATHS = [
    "/go/out/8841290375?aff=5531&cid=99120&sub=a1&clk=77", "/win/now/free/claim.php?id=7745120&u=9f31&src=pop&n=1&z=88", "/x/1/2/3/4/5/6/index.php?sid=0a9f8e7d6c5b&q=1",
    "/click?r=84756102938475&aff=12&to=//pay", "/p/90817263/54637281/9182?gclid=81726354&cid=5&t=1&s=2",
]
GOOD_PATHS = ["/about", "/news/spring-floods", "/articles/2021/how-to-mend-a-chair", "/wiki/River", "/archive/issue-12/letters.html"]
PREFIXES = ["", "www.", "blog.", "m."]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, bad): every name under every path of its class, with suffixes and prefixes in turn."""
    classes = [(1, BAD_NAMES.split(), BAD_SUFFIXES, BAD_PATHS), (0, GOOD_NAMES.split(), GOOD_SUFFIXES, GOOD_PATHS)]
    names = [(bad, k, name, suffixes, [*BOTH_PATHS, *paths]) for bad, listed, suffixes, paths in classes for k, name in enumerate(listed)]
    rows = spark.createDataFrame(names, "bad int, k int, name string, suffixes array<string>, paths array<string>")
    rows = rows.select("bad", "k", "name", "suffixes", F.posexplode("paths").alias("p", "path"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("k") + F.col("p")) % len(PREFIXES) + 1)
    suffix = F.element_at("suffixes", (F.col("k") * 3 + F.col("p")) % F.size("suffixes") + 1)
    return rows.select(F.concat(F.lit("https://"), prefix, "name", F.lit("."), suffix, "path").alias("url"), "bad")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before_query = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    return host, F.substr(before_query, F.length(host) + 1)


def winning_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; match them by a join on the host's suffixes instead")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def parts(host: Column) -> Column:
    """Parts of a host between dots and hyphens, without its last two labels."""
    return F.split(F.regexp_replace(host, r"(^|\.)[^.]*\.[^.]*$", ""), "[.-]")


def top(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def odds(labelled: DataFrame, terms: Column) -> dict[str, float]:
    """Smoothed log odds of being bad per term of the (bounded) labelled urls."""
    rows = labelled.select("bad", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    return {r["term"]: r["value"] for r in rows.select("term", F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)).alias("value")).collect()}


def looked_up(table: dict[str, float]) -> Column:
    if not table:
        return F.create_map(F.lit(""), F.lit(0.0))
    return F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*[F.lit(v) for v in table.values()]))


def features(url: Column, host: Column, path: Column, top_odds: dict[str, float], part_odds: dict[str, float]) -> dict[str, Column]:
    """The values of ``FEATURES``."""
    text = F.coalesce(url, F.lit(""))
    length = F.greatest(F.length(host), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(host, ""))
    share = F.transform(letters, lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / length)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    known = looked_up(part_odds)
    worst = F.array_max(F.transform(parts(host), lambda p: F.coalesce(F.try_element_at(known, p), F.lit(0.0))))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    values = {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "labels": F.size(F.split(host, r"\.")),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "digit_share": digits / F.greatest(F.length(text), F.lit(1)),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "top_odds": F.coalesce(F.try_element_at(looked_up(top_odds), top(host)), F.lit(0.0)),
        "part_odds": F.coalesce(worst, F.lit(0.0)),
    }
    return {name: value.cast("double") for name, value in values.items()}


def with_features(rows: DataFrame, tables: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    found = features(F.col("url"), F.col("host"), F.col("path"), *tables)
    return rows.withColumn("features", array_to_vector(F.array(*[found[f] for f in FEATURES])))


def train(labelled: DataFrame):
    """(model, suffix statistics) from labelled urls; the model is None unless both classes occur."""
    from pyspark.ml.classification import GBTClassifier

    host, path = host_and_path(F.col("url"))
    clean = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select("url", F.col("bad").cast("double").alias("bad"))
    rows = clean.orderBy(F.md5("url"), "url").limit(LABELLED).select("url", host.alias("host"), path.alias("path"), "bad").coalesce(1)
    tables = odds(rows, F.array(top(F.col("host")))), odds(rows, F.array_distinct(parts(F.col("host"))))
    if rows.select("bad").distinct().count() < 2:
        return None, tables
    # Half the time the statistics of parts are hidden from the trees, so that they also learn from what needs no known host.
    known, unknown = with_features(rows, tables), with_features(rows, (tables[0], {}))
    trees = GBTClassifier(featuresCol="features", labelCol="bad", maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3)
    return trees.fit(known.unionByName(unknown).coalesce(1)), tables


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the trees' probability of a bad url."""
    from pyspark.ml.functions import vector_to_array

    model, tables = train(labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("won", winning_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = rows.withColumn("bad_probability", F.lit(0.0))
    else:
        scored = model.transform(with_features(rows, tables)).withColumn("bad_probability", vector_to_array("probability")[1])
    own = F.when(F.col("bad_probability") >= 0.5, "block").otherwise("allow")
    verdict = F.coalesce(F.col("won.verdict"), own)
    return scored.select("page_id", "host", "path", F.col("won.rule").alias("rule"), verdict.alias("verdict"), "bad_probability")
