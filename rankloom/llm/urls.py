"""URL filter: host and path rules first, then the ratio of two character language models. DataFrame functions only.

Rules settle what they fit. The models learn from a table of examples (url, rejected) or, without one, from the pages
themselves: urls that a rule blocks or whose host has one of the ``seeds`` as a part between dots and hyphens are
rejected, the others stand for what is accepted. Two variable-order Markov models of the characters of whole urls (all
after the first ``://``, query and fragment too; a url without it as it is), smoothed by interpolation with the number
of distinct continuations of each context, are counted on all examples, four fifths of them by a hash of the url (equal
urls fall on one side). A url's score is the mean log-likelihood difference of its characters; the threshold is
calibrated so that a share ``loss`` of accepted examples falls below it, exactly: of all of the fifth that is not learned
from, or of all accepted ones where that is none. One example of each class is learned from at least. ``per_class`` is for
a caller who wants to fit on less: some so many rows of each class, drawn by a hash of id and url; no query does. A learned
url weighs ``heavy`` characters at most, so that a huge one among few doesn't outweigh all others; None turns that off.

Scoring explodes each url into its characters, looks their contexts up in the model and adds up again; sums are
combined within the task, so that one row per url is shuffled. The model is broadcast only when its rows, counted, are
at most ``BROADCAST_ROWS``; with a larger one each distinct window of characters is looked up once, by shuffles, and the
urls' characters meet it by one join. Each url is judged by itself: repeated rows and null ids get their own rows, and a
third of all urls on one host is no group of anything.

Defined results: an empty table gives no rows; a null url or one without ``://`` has an empty host and path and is no example; a null or empty one is
judged on its end alone; a very long url is read to its end, in time that grows with its length; without examples of
both classes the method allows; further columns are ignored.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.shared import cut, hash_share

#: action, host, path. A rule fits its host and the subdomains, for paths that begin with its own.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SEEDS = ("adult", "bets", "casino", "pills", "spam", "track")
ORDER, FLOOR, LOSS, HEAVY = 4, 1 / 256, 0.01, 200
#: The share of examples that is held back from learning, and how close the bracket of the threshold is: 1 / ACCURACY of the rows.
BACK, ACCURACY = 0.2, 10_000
#: The most rows of a model that is broadcast: some 200 MB.
BROADCAST_ROWS = 2_000_000
#: Stand before and after the text.
BEGIN, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def whole(url: Column) -> Column:
    """What the models read: all after the first ``://`` with the host in lower case, or the whole url where there is none."""
    rest = F.regexp_extract(url, r"(?s)://[^/?#]*(.*)", 1)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(host_and_path(url)[0], rest)).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and action; null if none does."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def windows(text: Column, order: int = ORDER) -> Column:
    """For every character and the end: it and the ``order`` - 1 before. The text is split once for each of those."""
    chars = F.split(F.concat(F.lit(BEGIN * (order - 1)), text, F.lit(END)), "")
    out, *rest = [F.slice(chars, k + 1, F.length(text) + 1) for k in range(order)]
    for shifted in rest:
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, b))
    return F.explode(out)


def learn(examples: DataFrame, order: int = ORDER, heavy: int | None = HEAVY) -> DataFrame:
    """The model of rows (text, rejected): for each string s of up to ``order`` characters the log-probabilities of its
    last character after the others, by class (log_a, log_r), and the logs of what its role as a context leaves to the
    order below (back_a, back_r; 0 where the class never met it). Every character counts one; with ``heavy`` a longer text
    counts whole with the mass of so many characters, so that no single one outweighs the others."""
    weight = F.least(F.lit(1.0), heavy / (F.length("text") + 1)) if heavy else F.lit(1.0)
    mass = lambda side: F.sum(F.when(side, F.col("weight")).otherwise(0.0))
    weighed = examples.select("rejected", weight.alias("weight"), "text")  # before the text is taken apart, or each part would carry it
    seen = weighed.select("rejected", "weight", windows(F.col("text"), order).alias("w")).groupBy("w").agg(mass(~F.col("rejected")).alias("a"), mass(F.col("rejected")).alias("r"))
    suffixes = F.explode(F.array(*[F.right("w", F.lit(k)) for k in range(1, order + 1)]))
    grams = seen.select(suffixes.alias("s"), "a", "r").groupBy("s").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    context = Window.partitionBy(F.length("s"), F.left("s", F.length("s") - 1))
    grams = grams.select("s", F.left("s", F.length("s") - 1).alias("h"), F.right("s", F.length("s") - 1).alias("below"), *[c for x in "ar" for c in (F.col(x), F.sum(x).over(context).alias(f"n_{x}"), F.count_if(F.col(x) > 0).over(context).alias(f"t_{x}"))])
    grams = cut(grams, "url-grams")
    mixed = lambda x, lower: F.when(F.col(f"n_{x}") > 0, (F.col(x) + F.col(f"t_{x}") * lower) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(lower)
    level = grams.where(F.length("s") == 1).select("s", *[mixed(x, F.lit(FLOOR)).alias(f"p_{x}") for x in "ar"])
    every = level
    for k in range(2, order + 1):
        lower = level.select(F.col("s").alias("below"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
        level = grams.where(F.length("s") == k).join(lower, "below").select("s", *[mixed(x, F.col(f"low_{x}")).alias(f"p_{x}") for x in "ar"])
        every = every.unionByName(level)
    left = lambda x: F.coalesce(F.log(F.max(F.when(F.col(f"n_{x}") > 0, F.col(f"t_{x}") / (F.col(f"n_{x}") + F.col(f"t_{x}"))))), F.lit(0.0))
    backs = grams.groupBy(F.col("h").alias("s")).agg(*[left(x).alias(f"back_{x}") for x in "ar"])
    model = every.join(backs, "s", "full").select("s", F.log("p_a").alias("log_a"), F.log("p_r").alias("log_r"), *[F.coalesce(f"back_{x}", F.lit(0.0)).alias(f"back_{x}") for x in "ar"])
    return cut(model, "url-model")


def differences(rows: DataFrame, model: DataFrame, order: int, as_side: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (with windows _w) and _diff: log p(accepted) - log p(rejected) of a window's last character after the
    others. ``as_side`` is given what is joined of the model: the strings and contexts of one length."""
    found = F.lit(0.0)
    for k in range(1, order + 1):  # the longest string known gives the difference; contexts beyond it add what they leave
        backs = model.where(F.length("s") == k - 1).select(F.col("s").alias(f"_h{k}"), (F.col("back_a") - F.col("back_r")).alias(f"_b{k}"))
        logs = model.where((F.length("s") == k) & F.col("log_a").isNotNull()).select(F.col("s").alias(f"_s{k}"), (F.col("log_a") - F.col("log_r")).alias(f"_d{k}"))
        rows = rows.join(as_side(backs), F.left(F.right("_w", F.lit(k)), F.lit(k - 1)) == F.col(f"_h{k}"), "left").join(as_side(logs), F.right("_w", F.lit(k)) == F.col(f"_s{k}"), "left")
        found = F.when(F.col(f"_d{k}").isNotNull(), F.col(f"_d{k}")).otherwise(found + F.coalesce(F.col(f"_b{k}"), F.lit(0.0)))
    return rows.withColumn("_diff", found)


def likelihood_difference(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` (with a column text) and score: the mean over characters of log p(accepted) - log p(rejected)."""
    numbered = cut(urls.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    rows = numbered.select("_row", windows(F.col("text"), order).alias("_w"))  # no column beside a number goes with each character
    if model.count() <= BROADCAST_ROWS:
        met = differences(rows, model, order, F.broadcast)
    else:
        met = rows.join(cut(differences(rows.select("_w").distinct(), model, order).select("_w", "_diff"), "url-windows"), "_w")
    scores = met.groupBy("_row").agg(F.avg("_diff").alias("score"))
    return numbered.drop("text").join(scores, "_row").drop("_row")


def threshold(scored: DataFrame, loss: float) -> float | None:
    """The score below which a share ``loss`` of the accepted rows (score, rejected) falls; None without any.

    It is the exact percentile of all of them, between two neighbours in order. Approximate percentiles only bracket
    those; what lies below the bracket is counted, and the few different scores inside it are sorted.
    """
    scores = cut(scored.where("NOT rejected").select("score"), "url-scores")  # every pass must meet the same last bits
    n = scores.count()
    if not n:
        return None
    place, margin = loss * (n - 1), 2 / ACCURACY
    k = int(place)
    while True:
        low, high = scores.agg(F.percentile_approx("score", [max(0.0, loss - margin), min(1.0, loss + margin)], ACCURACY).alias("ends")).first().ends
        below, upto = scores.agg(F.count_if(F.col("score") < low), F.count_if(F.col("score") <= high)).first()
        if below <= k and upto >= min(k + 2, n):
            break
        margin *= 4
    inside = scores.where(F.col("score").between(low, high)).groupBy("score").count().orderBy("score").limit(k + 2 - below).collect()
    ends = list(accumulate((r["count"] for r in inside), initial=below))[1:]
    first, second = (inside[bisect_right(ends, i)].score for i in (k, min(k + 1, n - 1)))
    return first if first == second else (k + 1 - place) * first + (place - k) * second


def seeded(host: Column, seeds: Sequence[str]) -> Column:
    """Whether a part of the host between dots and hyphens is one of the seeds."""
    return F.coalesce(host.rlike(f"(^|[.-])({'|'.join(map(re.escape, seeds))})([.-]|$)"), F.lit(False)) if seeds else F.lit(False)


def dealt(known: DataFrame, per_class: int | None = None) -> DataFrame | None:
    """text, rejected, learned and judged (for calibration) of every row of ``known`` (id, text, rejected), written; None
    unless both classes are there. Both marks depend on the text and its class alone. With ``per_class`` some so many rows
    of each class are drawn first, by a hash of id and text."""
    if per_class is not None:
        sizes = {r.rejected: min(1.0, per_class / r.n) for r in known.groupBy("rejected").agg(F.count("*").alias("n")).collect()}
        share = hash_share(F.coalesce("id", F.lit("")), "text")
        known = known.where(share < F.when(F.col("rejected"), sizes.get(True, 1.0)).otherwise(sizes.get(False, 1.0)))
    rows = cut(known.select("text", "rejected", hash_share("text", F.lit(5)).alias("at")), "url-examples")
    ends = {r.rejected: r for r in rows.groupBy("rejected").agg(F.min("at").alias("first"), F.max("at").alias("last")).collect()}
    if len(ends) < 2:
        return None
    upto = {side: min(BACK, at.last) for side, at in ends.items()}  # what comes last in a class is learned from in any case
    back = F.col("at") < F.when(F.col("rejected"), upto[True]).otherwise(upto[False])
    judged = ~F.col("rejected") & (back if ends[False]["first"] < upto[False] else F.lit(True))
    return rows.select("text", "rejected", (~back).alias("learned"), judged.alias("judged"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, examples: DataFrame | None = None,
    per_class: int | None = None, loss: float = LOSS, heavy: int | None = HEAVY, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score (null where a rule settled it).

    ``examples`` (url, rejected) replaces what rules and seeds mark; rows with a null in it don't count.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), whole(F.col(f"`{url_col}`")).alias("text"))
    urls = urls.withColumn("of", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "of.rule", "of.action", "text")
    if examples is None:
        rejected = F.coalesce((F.col("action") == "block") | seeded(F.col("host"), seeds), F.lit(False))
        known = urls.where(F.length(F.concat("host", "path")) > 0).select(F.col("page_id").cast("string").alias("id"), "text", rejected.alias("rejected"))
    else:
        known = examples.where("url IS NOT NULL AND rejected IS NOT NULL").select(F.lit("").alias("id"), whole(F.col("url")).alias("text"), F.col("rejected").cast("boolean").alias("rejected"))

    settled = urls.where("action IS NOT NULL").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_urls = urls.where("action IS NULL").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "text")
    dealt_out = dealt(known, per_class)
    if dealt_out is None:
        return settled.unionByName(open_urls.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score")))
    model = learn(dealt_out.where("learned"), heavy=heavy)
    least = threshold(likelihood_difference(dealt_out.where("judged").select("text", "rejected"), model), loss)
    scored = likelihood_difference(open_urls, model)
    verdict = F.when(F.col("score") >= least, "allow").otherwise("block")
    return settled.unionByName(scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))
