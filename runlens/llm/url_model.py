"""URL filter: rules first, then two character language models.

Accepted and rejected URLs (those a rule decides) each train a variable-order Markov model with Witten-Bell
smoothing over contexts of up to ORDER characters. A URL's score is its mean log-likelihood ratio per
character; the threshold is fitted on a quarter of the decided URLs that the models have not seen.
Everything is DataFrame operations: grams are counted, the models are tables, scoring is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.staging import broadcast_if_small, staged

#: Longest context in characters.
ORDER = 4
#: Size of the alphabet the lowest order spreads its remaining mass over.
ALPHABET = 256
#: One decided URL in so many calibrates the threshold instead of training.
CALIBRATION = 4
#: A model of at most so many grams (under 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_GRAMS = 400_000

# The rules of the contract, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER),
                              "path": F.coalesce(path, F.lit(""))})


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rule`` and ``verdict`` of the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, told).otherwise(verdict)
    return pages.withColumns({"rule": rule, "verdict": verdict})


def grams(host: Column, path: Column) -> Column:
    """For each character of host, path and an end mark: it and the ORDER characters before it."""
    text = F.concat(F.lit("\x02" * ORDER), host, path, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def ratio_table(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | context) of accepted minus rejected URLs.

    ``counts`` has every gram to be scored once, with its training counts ``a`` and ``r`` (0 where unseen).
    Order k interpolates with order k - 1 by Witten-Bell; an unseen context passes the lower order on.
    """
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr")).first()
    lower = None
    for order in range(ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - order, order + 1)
        level = counts.groupBy(suffix.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if order == 0:
            lower = level.select(
                "g", *(((F.col(c) + 1) / (total[f"n{c}"] + ALPHABET)).alias(f"p{c}") for c in "ar")
            )
            continue
        context = F.substring("g", 1, order)
        contexts = level.groupBy(context.alias("c")).agg(
            *(F.sum(c).alias(f"n{c}") for c in "ar"), *(F.count_if(F.col(c) > 0).alias(f"t{c}") for c in "ar")
        )
        level = level.withColumns({"c": context, "s": F.substring("g", 2, order)})
        below = lower.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        smoothed = {
            f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
            .otherwise(F.col(f"q{c}"))
            for c in "ar"
        }
        lower = level.join(contexts, "c").join(below, "s").select("g", *(e.alias(n) for n, e in smoothed.items()))
    return lower.select(F.col("g").alias("gram"), F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_column: str = "page_id") -> DataFrame:
    """(id, url, host, path, rule, verdict, score): one row per row of ``pages``, repeated rows included.

    A rule's verdict stands; without one the models decide (``score`` is the mean log ratio less the
    threshold, null under a rule). A null url or one without ``://`` has empty host and path and goes to
    the models. If no rule accepts (or rejects) anything to learn from, the other verdict is given; with
    neither, all are allowed. Other columns of ``pages`` are not read.
    """
    judged = with_rule(with_host_and_path(pages.select(id_column, "url")), rules)
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATION))
    known = F.col("verdict").isNotNull()
    train = known & (fold != 0)
    counts = staged(
        judged.select(F.explode(grams(F.col("host"), F.col("path"))).alias("gram"), "verdict", train.alias("train"))
        .groupBy("gram")
        .agg(*(F.count_if(F.col("train") & (F.col("verdict") == v)).alias(n) for v, n in (("allow", "a"), ("block", "r")))),
        "url-grams",
    )
    ratios = broadcast_if_small(staged(ratio_table(counts), "url-ratios"), BROADCAST_GRAMS)

    def scored(rows: DataFrame, *keys: str) -> DataFrame:
        """One row per distinct row, with its mean ratio and how often it came."""
        one = rows.select(*keys, F.posexplode(grams(F.col("host"), F.col("path"))).alias("at", "gram"))
        return one.join(ratios, "gram").groupBy(*keys).agg(
            F.avg("ratio").alias("mean"), F.count_if(F.col("at") == 0).alias("copies")
        )

    held = scored(judged.where(known & (fold == 0)), "host", "path", "verdict")
    spread = {
        r.verdict: r
        for r in held.groupBy("verdict").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"), F.count("*").alias("n")).collect()
    }  # two rows at most
    cut = threshold(spread)
    columns = [id_column, "url", "host", "path", "rule"]
    by_model = scored(judged.where(~known), *columns).select(
        *columns,
        F.when(F.col("mean") >= cut, "allow").otherwise("block").alias("verdict"),
        (F.col("mean") - F.lit(cut if abs(cut) != float("inf") else 0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    by_rule = judged.where(known).withColumn("score", F.lit(None).cast("double"))
    return by_rule.unionByName(by_model.drop("copy"))


def threshold(spread: dict) -> float:
    """Where the two classes' standardised distances meet."""
    if "allow" not in spread or "block" not in spread:
        return float("inf") if "block" in spread else float("-inf")
    a, b = spread["allow"], spread["block"]
    wide = a.s + b.s
    return (a.m * b.s + b.m * a.s) / wide if wide else (a.m + b.m) / 2
