"""URL filters: block and allow rules, and a ratio of two character language models for all other URLs.

Each model is a variable-order Markov model: the probability of a character after its longest context of up to ORDER - 1
characters that was seen, mixed with the shorter contexts' by Witten and Bell's weights. One is learned from accepted URLs, one from
rejected ones: those that a rule decides. A URL's score is the difference of its log likelihoods over its length; the
threshold is calibrated on held-out decided URLs. Contexts are counted over all decided URLs; the tables are joined by
broadcast while they are small, and by a shuffle beyond that.

All work on executors is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import shared_dir, written

ORDER = 4
#: Rows of a model's table that are broadcast at most (about 60 bytes each).
BROADCAST_ROWS = 300_000
#: Decided URLs whose hash has this remainder modulo FOLDS calibrate the threshold; the others are learned from.
FOLDS, HELD = 5, 0
#: Scores are rounded so for calibration; this bounds the histogram that comes to the driver.
BIN = 0.01


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased; empty for a null url or one without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """name or verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), not r.allow)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name if what == "rule" else "allow" if r.allow else "block")).otherwise(out)
    return out


def _positions(urls: DataFrame) -> DataFrame:
    """url, weight and, for each character, what stands before it up to ORDER - 1 characters, and itself."""
    padded = F.concat(F.lit("\u0001" * (ORDER - 1)), F.lower("url"), F.lit("\u0002"))
    at = F.explode(F.sequence(F.lit(1), F.char_length(F.col("padded")) - (ORDER - 1)))
    return urls.withColumn("padded", padded).select("*", at.alias("at")).select(
        *[c for c in urls.columns], F.substring(F.col("padded"), F.col("at"), F.lit(ORDER)).alias("gram")
    )


def fit(spark: SparkSession, decided: DataFrame, scratch: str) -> list[DataFrame]:
    """decided: url, accepted, weight. For each order from ORDER down to 1: gram, ratio of log probabilities."""
    top = _positions(decided).groupBy("accepted", "gram").agg(F.sum("weight").alias("n"))
    top = written(spark, top.select("accepted", "gram", F.col("n").cast("double").alias("n")), f"{scratch}/order-{ORDER}")
    tables, below = [], None
    for k in range(1, ORDER + 1):
        own = top.groupBy("accepted", F.substring("gram", ORDER - k + 1, k).alias("gram")).agg(F.sum("n").alias("n"))
        own = own.withColumn("context", F.substring("gram", 1, k - 1))
        # Witten and Bell: a context's unseen characters get the share of its distinct ones.
        total = own.groupBy("accepted", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        # Both models get a value for every gram that either saw.
        grams = own.select("gram", "context").distinct()
        pairs = [grams.withColumn("accepted", F.lit(a)) for a in (True, False)]
        full = reduce(DataFrame.unionByName, pairs).join(own.select("accepted", "gram", "n"), ["accepted", "gram"], "left").join(total, ["accepted", "context"], "left")
        full = full.withColumn("suffix", F.substring("gram", 2, k - 1))
        if below is None:
            full = full.withColumn("lower", F.lit(1 / 256))
        else:
            full = full.join(below.select("accepted", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["accepted", "suffix"], "left")
        kinds, total_n = F.coalesce("kinds", F.lit(0)), F.coalesce("total", F.lit(0.0))
        p = F.when(total_n > 0, (F.coalesce("n", F.lit(0.0)) + kinds * F.col("lower")) / (total_n + kinds)).otherwise(F.col("lower"))
        below = written(spark, full.select("accepted", "gram", p.alias("p")), f"{scratch}/p-{k}")
        ratio = F.max(F.when(F.col("accepted"), F.log("p"))) - F.max(F.when(~F.col("accepted"), F.log("p")))
        tables.append(written(spark, below.groupBy("gram").agg(ratio.alias("ratio")), f"{scratch}/ratio-{k}"))
    return tables[::-1]


def scores(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """url, score: mean over characters of the ratio under the longest context that either model saw."""
    rows = _positions(urls.select("url"))
    for k, t in zip(range(ORDER, 0, -1), tables, strict=True):
        t = t.select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        t = F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
        rows = rows.withColumn(f"g{k}", F.substring("gram", ORDER - k + 1, k)).join(t, f"g{k}", "left")
    value = F.coalesce(*[F.col(f"r{k}") for k in range(ORDER, 0, -1)], F.lit(0.0))
    return rows.groupBy("url").agg((F.sum(F.round(value * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that splits decided URLs with the least mean of both error rates; scored: score, accepted, weight."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum(F.when(F.col("accepted"), F.col("weight")).otherwise(0)).alias("good"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("weight"))).alias("bad")
    )
    rows = sorted((r["bin"], r["good"], r["bad"]) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    lost, caught, found = 0, 0, []
    for k, g, b in rows:
        found.append(((lost / good + 1 - caught / bad), k * BIN))
        lost, caught = lost + g, caught + b
    least = min(x for x, _ in found)
    ties = [at for x, at in found if x == least]
    return ties[len(ties) // 2]


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", id_column: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the models as an empty
    text. URLs are scored once each, however many pages have them. Where the rules decide no URL one way, the models
    know nothing, scores are 0 and the verdict is allow. Ties with the threshold are allowed. Repeated rows and null ids
    are judged row by row; other columns are not read. An empty table gives an empty result.
    """
    scratch = shared_dir(spark)
    rows = pages.select(pages[id_column].alias("id"), pages[url].alias("own"), F.coalesce(pages[url], F.lit("")).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("own"))).withColumn("path", path_of(F.col("own")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "rule")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    distinct = written(spark, rows.groupBy("url", "ruled").agg(F.count(F.lit(1)).alias("weight")), f"{scratch}/urls")
    fold = F.pmod(F.crc32("url"), F.lit(FOLDS))
    decided = distinct.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"), "weight", fold.alias("fold"))
    both = decided.where(F.col("fold") != HELD).select("accepted").distinct().count() == 2
    if not both:
        return rows.select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    tables = fit(spark, decided.where(F.col("fold") != HELD).drop("fold"), scratch)
    scored = written(spark, scores(distinct, tables), f"{scratch}/scores")
    at = threshold(scored.join(decided.where(F.col("fold") == HELD), "url"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return rows.join(scored, "url").select("id", "host", "path", "rule", verdict.alias("verdict"), "score")
