"""Operator 9 - URL filters by a character language-model ratio.  DataFrame functions only.

Rules decide the urls they fit.  Their accepted and rejected urls also train two character models of variable order:
P(c | context) = (n(context c) + BETA * P(c | shorter context)) / (n(context) + BETA), down to single characters.  A url's
score is the mean over its characters of log P(c | longest context seen, accepted) - log P(.. , rejected).  As every suffix
of a seen gram was seen, that longest match is the sum of one difference per gram found, whatever its length: scoring is a
join of a url's grams with the model and a sum.  The threshold lies between the two classes' mean scores on urls that the
models have not seen, weighted by their spreads.

Models learn from and score every character of the whole url as it stands, scheme, query and fragment included; equal urls
are one.  The model is broadcast while it has at most `BROADCAST_GRAMS` grams; larger ones are joined by gram and salt.

Defined results: a null url and an empty one are the empty text (score 0, no rule, empty host and path); a url without `://`
has empty host and path and no rule, and its characters are scored as any; very long urls are cut into grams by the engine,
a row at a time; without accepted or without rejected urls to learn from every score is 0, and where the urls set aside lack
one of the two the threshold is 0; a score at the threshold allows; repeated rows are judged alike; an empty table gives an
empty result; `judge` reads page_id and url alone and returns its five columns, so columns of clashing names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (host, path, verdict); a rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ORDER, BETA = 4, 4.0
ALPHABET = 256
BROADCAST_GRAMS = 400_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    there = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.expr("substr(`__url`, locate('://', `__url`) + 3)")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    # where the host ends at ? or #, there is no path
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def grams(keys: DataFrame, *carry: str) -> DataFrame:
    """All substrings of 1 to ORDER characters of `key`, each with the carried columns."""
    n = F.char_length("key")
    at = keys.where(n > 0).select("key", *carry, F.explode(F.sequence(F.lit(1), n)).alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.char_length("key") - F.col("at") + 1))).alias("size")
    return at.select("key", *carry, "at", sizes).select("key", *carry, F.substr("key", F.col("at"), F.col("size")).alias("gram"))


def fit(train: DataFrame) -> DataFrame:
    """gram, delta: what a seen gram adds to the log ratio beyond its own longest suffix.  `train` has key and accepted."""
    counts = grams(train, "accepted").groupBy("gram").agg(
        F.sum(F.col("accepted").cast("double")).alias("a"), F.sum((~F.col("accepted")).cast("double")).alias("r")
    )
    counts = checkpointed(counts.withColumn("size", F.char_length("gram")))
    total = counts.where("size = 1").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("r")).first()
    if not total["a"] or not total["r"]:
        return counts.select("gram", F.lit(0.0).alias("delta"))
    ones = counts.where("size = 1").select(
        "gram", ((F.col("a") + 1) / (total["a"] + ALPHABET)).alias("pa"), ((F.col("r") + 1) / (total["r"] + ALPHABET)).alias("pr"),
    )
    levels = [ones.select("gram", "pa", "pr", F.log(F.col("pa") / F.col("pr")).alias("delta"))]
    for k in range(2, ORDER + 1):
        own = counts.where(F.col("size") == k).withColumn("context", F.expr(f"substr(gram, 1, {k - 1})")).withColumn("suffix", F.expr("substr(gram, 2)"))
        seen = own.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        low = levels[-1].select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        joined = own.join(seen, "context").join(low, "suffix")
        pa = (F.col("a") + BETA * F.col("la")) / (F.col("na") + BETA)
        pr = (F.col("r") + BETA * F.col("lr")) / (F.col("nr") + BETA)
        levels.append(joined.select("gram", pa.alias("pa"), pr.alias("pr"), (F.log(pa / pr) - F.log(F.col("la") / F.col("lr"))).alias("delta")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return checkpointed(out.select("gram", "delta"))


def score(keys: DataFrame, model: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """key, score: the mean log ratio of the characters of each distinct key."""
    found = grams(keys)
    if model.count() <= broadcast_grams:
        hits = found.join(F.broadcast(model), "gram")
    else:  # common grams stand in most urls: spread them over salts
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return hits.groupBy("key").agg((F.sum("delta") / F.char_length("key")).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    base = pages.select("page_id", F.col("url").alias("__url"))
    host, path = host_path(F.col("__url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules or RULES)
    base = base.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("__ruled", verdict)
    base = base.withColumn("key", F.coalesce("__url", F.lit(""))).drop("__url")
    keys = checkpointed(base.select("key", "__ruled").distinct())
    known = keys.where(F.col("__ruled").isNotNull()).select("key", (F.col("__ruled") == "allow").alias("accepted"))
    aside = F.substr(F.md5(F.col("key").cast("binary")), F.lit(1), F.lit(1)).isin("0", "1", "2", "3")
    model = fit(known.where(~aside))
    scores = checkpointed(score(keys.select("key"), model, broadcast_grams))
    spread = known.where(aside).join(scores, "key").groupBy("accepted").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    got = {r["accepted"]: r for r in spread.collect()}
    bound = 0.0
    if len(got) == 2:
        a, r = got[True], got[False]
        both = a["sd"] + r["sd"]
        bound = (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / both if both > 0 else (a["mean"] + r["mean"]) / 2
    by_key = scores.select("key", F.when(F.col("score") >= bound, "allow").otherwise("block").alias("__scored"))
    empty = "allow" if 0.0 >= bound else "block"
    open_, ruled = base.where("__ruled IS NULL"), base.where("__ruled IS NOT NULL")
    judged = open_.join(by_key, "key", "left").withColumn("verdict", F.coalesce("__scored", F.lit(empty)))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    return ruled.withColumn("verdict", F.col("__ruled")).select(*cols).unionByName(judged.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
