"""URL filters: host and path rules, then a ratio of two character language models.

URLs that a rule allows or blocks train two smoothed variable-order Markov models
over characters. A model's probability of a character mixes the orders from none to
``ORDER``: each order adds its counts to ``BACKOFF`` times the next lower order's
probability. The score of a URL is the difference of its two log-likelihoods per
character. A fifth of the ruled URLs, by checksum, stays out of the counts and
calibrates the threshold. DataFrame functions alone; no table is broadcast by hint.

Rows: one result for each input row, repeated rows alike. A null url or one without
``://`` has empty host and path; it fits no rule and is scored as it is (null: empty).
Where no URL of either kind trains the models, every score is 0 and the method allows.
An empty table gives no row. Extra columns are left behind.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: host and path, verdict
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4
BACKOFF = 2.0
ALPHABET = 256
HOLD_OUT = 5
_START, _END = "\x02", "\x03"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones come later and win
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character of each URL: ``g``, the character after ``ORDER`` others."""
    padded = F.concat(F.lit(_START * ORDER), F.lower("url"), F.lit(_END))
    at = F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER))
    return (
        urls.withColumn("padded", padded)
        .select(*(c for c in urls.columns if c != "url"), "padded", at.alias("at"))
        .withColumn("g", F.substring(F.col("padded"), F.col("at"), F.lit(ORDER + 1)))
        .drop("padded", "at")
    )


def log_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``g``, ``ratio``: log-likelihood ratio of the last character of each distinct gram.

    ``counts`` has ``g``, ``allow`` and ``block``: how often each kind has the gram.
    """
    both = ("allow", "block")
    totals = counts.agg(*(F.sum(c).alias(c) for c in both)).first()
    out = grams.select("g").distinct()
    p = {c: F.lit(1.0 / ALPHABET) for c in both}
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias(f"g{k}")).agg(
            *(F.sum(c).alias(f"{c}_n{k}") for c in both)
        )
        out = out.withColumn(f"g{k}", F.substring("g", ORDER + 1 - k, k + 1)).join(seen, f"g{k}", "left").drop(f"g{k}")
        if k:
            context = counts.groupBy(F.substring("g", ORDER + 1 - k, k).alias(f"c{k}")).agg(
                *(F.sum(c).alias(f"{c}_t{k}") for c in both)
            )
            out = out.withColumn(f"c{k}", F.substring("g", ORDER + 1 - k, k)).join(context, f"c{k}", "left").drop(f"c{k}")
        for c in both:
            total = F.coalesce(F.col(f"{c}_t{k}"), F.lit(0)) if k else F.lit(totals[c] or 0)
            p[c] = (F.coalesce(F.col(f"{c}_n{k}"), F.lit(0)) + BACKOFF * p[c]) / (total + BACKOFF)
    return out.select("g", (F.log(p["allow"]) - F.log(p["block"])).alias("ratio"))


def url_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """``url``, ``score``, ``held_out`` and ``says`` of each distinct URL, in the shared folder."""
    url = F.coalesce(F.col("url"), F.lit(""))
    urls = pages.select(url.alias("url")).distinct()
    host, path = parse(F.col("url"))
    _, says = ruled(host, path, rules)
    checksum = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long")
    # numbers stand for URLs while their grams travel; written with them, so no two share one
    urls = urls.select("url", says.alias("says"), (checksum % HOLD_OUT == 0).alias("held_out"))
    urls = materialize(urls.withColumn("key", F.monotonically_increasing_id()), "urls")
    grams = _grams(urls)
    train = grams.filter("says is not null and not held_out")
    counts = materialize(
        train.groupBy("g").agg(*(F.count_if(F.col("says") == c).alias(c) for c in ("allow", "block"))), "url-grams"
    )
    ratios = materialize(log_ratios(grams, counts), "url-ratios")
    scored = grams.join(ratios, "g").groupBy("key").agg(F.avg("ratio").alias("score"))
    return materialize(urls.join(scored, "key").drop("key"), "url-scores")


def threshold(scores: DataFrame) -> float:
    """Where the held-out scores of both kinds lie equally many deviations off; 0 without any."""
    kinds = {
        r["says"]: (r["mean"], r["deviation"] or 0.0)
        for r in scores.filter("held_out and says is not null")
        .groupBy("says")
        .agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
        .collect()  # two rows
    }
    if len(kinds) < 2:
        return 0.0
    (a, da), (b, db) = kinds["allow"], kinds["block"]
    da, db = max(da, 1e-6), max(db, 1e-6)
    at = (a * db + b * da) / (da + db)
    return at if math.isfinite(at) else 0.0


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of each page."""
    scores = url_scores(pages, rules)
    at = threshold(scores)
    host, path = parse(F.col("url"))
    known = F.coalesce(F.col("url"), F.lit(""))
    out = pages.select("page_id", known.alias("url"), host.alias("host"), path.alias("path"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    out = out.select("page_id", "url", "host", "path", rule.alias("rule"), says.alias("says"))
    method = F.when(F.col("score") >= at, "allow").otherwise("block")
    return out.join(scores.select("url", "score"), "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "score"
    )
