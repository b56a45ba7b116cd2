"""The URL filter: hosts, paths and rules case by case; the model against dictionaries of counts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import urls

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.ExAmple.ORG/En/1?q#f", "a.example.org", "/En/1", "org/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("https://x.example.org/es/", "x.example.org", "/es/", "example.org/es/"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("ftp://org/x", "org", "/x", "org/"), ("http://a.com/fr/x://y", "a.com", "/fr/x://y", "com/fr/"),
    ("http://a.com?x=/de/", "a.com", "", None), ("http://a.com/de/#x", "a.com", "/de/", "com/de/"), ("http://a.org", "a.org", "", None), ("x://y://z/", "y:", "//z/", None),
    ("http://ÉA.org/é", "Éa.org", "/é", "org/"), ("http://telecom/fr/", "telecom", "/fr/", None), ("http://a.com/fr", "a.com", "/fr", None), ("://b.com/de/x", "b.com", "/de/x", "com/de/"), ("", "", "", None),
]


def test_host_path_and_rule(spark):
    df = spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(CASES)], "k int, url string")
    host, path = urls.host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path}).withColumn("of", urls.rule_of(F.col("host"), F.col("path"), urls.RULES))
    got = {r.k: (r.host, r.path, r.of and r.of.rule) for r in df.collect()}
    assert got == {k: tuple(x) for k, (_, *x) in enumerate(CASES)}


def brute_model(examples, order):
    grams = [defaultdict(Counter), defaultdict(Counter)]
    for text, rejected in examples:
        s = urls.BEGIN * (order - 1) + text + urls.END
        for i in range(order - 1, len(s)):
            for k in range(order):
                grams[rejected][s[i - k : i]][s[i]] += 1

    def p(side, h, c):
        lower = p(side, h[1:], c) if h else urls.FLOOR
        seen = grams[side].get(h)
        return lower if not seen else (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    def score(text):
        s = urls.BEGIN * (order - 1) + text + urls.END
        return sum(math.log(p(0, s[i - order + 1 : i], s[i]) / p(1, s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s))) / (len(text) + 1)

    return score


def test_scores_match_brute_force(spark):
    examples = [("abc.com/x", False), ("abd.com/y", False), ("casino.net/x", True), ("bets.net", True), ("bets.net", True)]
    df = spark.createDataFrame(examples, "text string, rejected boolean")
    for order in (2, 4):
        model = urls.learn(df, order)
        asked = ["abc.com/x", "zzz", "casino.com", "", "bets.net/abd.com", "abé" * 50]
        got = urls.likelihood_difference(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string"), model, order)
        want = brute_model(examples, order)
        assert {r.k: r.score for r in got.collect()} == {k: pytest.approx(want(t), abs=1e-9) for k, t in enumerate(asked)}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://{'blog' if k % 2 else 'www'}.site{k % 9}.example.net/en/{k}", "x", 0.0) for k in range(300)]
    rows += [(1000 + k, f"http://m.casino-win{k % 3}.example.net/en/{k}", "x", 0.0) for k in range(60)]
    rows += [(2000 + k, u, "x", 0.0) for k, (u, *_) in enumerate(CASES)] + [(None, "http://a.example.net/en/7", None, None), (5, "http://a.example.net/" + "x" * 5000, "x", 1.0), (5, "http://a.org/", "x", 1.0)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, score double")


def test_pages(pages):
    got = urls.judge(pages).toPandas()
    assert list(got.columns) == ["page_id", "host", "path", "rule", "verdict", "score"] and len(got) == pages.count()
    action = {h + p: a for a, h, p in urls.RULES}
    ruled = got[got.rule.notna()]
    assert [action[r] for r in ruled.rule] == ruled.verdict.tolist() and set(got.verdict) == {"allow", "block"}
    assert (got[got.page_id.between(1000, 1999)].verdict == "block").all()
    assert (got[got.page_id < 300].verdict == "allow").mean() > 0.95
    for r in got[got.page_id >= 2000].itertuples():
        assert (r.host, r.path) == CASES[int(r.page_id) - 2000][1:3]


def test_query_fragment_and_urls_without_scheme_are_read(spark, pages):
    asked = ["http://www.site1.example.net/en/7", "http://www.site1.example.net/en/7?m.casino-win1", "http://www.site1.example.net/en/7#m.casino-win1", "www.site1.example.net/en/7", "m.casino-win1.example.net/en/7"]
    # Without the url of 5000 letters: it takes part in the calibration, where it would be one of some sixty.
    more = pages.where("length(url) < 5000 OR url IS NULL").unionByName(spark.createDataFrame([(9000 + k, u, "x", 0.0) for k, u in enumerate(asked)], pages.schema))
    got = {r.page_id - 9000: r for r in urls.judge(more).where("page_id >= 9000").collect()}
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert max(got[1].score, got[2].score) < got[0].score and got[4].score < got[3].score
    texts = spark.createDataFrame([(k, u) for k, u in enumerate([None, "", "no://A.b?Q\nx#Y", "A.b?q", "x://Y://Z", "://"])], "k int, url string")
    assert [r.text for r in texts.select("k", urls.whole(F.col("url")).alias("text")).orderBy("k").collect()] == ["", "", "a.b?Q\nx#Y", "A.b?q", "y:" + "//Z", ""]


def test_one_class_empty_table_and_native_plan(spark, pages):
    plain = pages.where("page_id < 300")
    assert {r.verdict for r in urls.judge(plain).collect()} == {"allow"}
    assert urls.judge(pages.limit(0)).count() == 0
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin|CartesianProduct|NestedLoop", plan)


def test_verdicts_hang_on_ids_and_urls_alone(spark, pages):
    """The sample is a part of each class here, and the same whatever the partitions."""
    some = pages.where("page_id IS NOT NULL")
    got = [{(r.page_id, r.path): (r.verdict, r.score and round(r.score, 9)) for r in urls.judge(some.repartition(n), per_class=40).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len({v for v, _ in got[0].values()}) == 2


def test_very_long_urls_are_learned_and_scored_to_their_end(spark, pages):
    long = "http://www.example.net/" + "a" * 80_000
    more = pages.unionByName(spark.createDataFrame([(9001, long, "x", 0.0), (9002, long + "?" + "casino-win" * 4000, "x", 0.0)], pages.schema))
    got = {r.page_id: r for r in urls.judge(more).where("page_id > 9000").collect()}
    assert got[9002].score < got[9001].score and len(got[9001].path) == 80_001
    w = spark.createDataFrame([("aé\U0001f600b",), ("",)], "t string").select("t", urls.windows(F.col("t"), 3).alias("w")).collect()
    b, e = urls.BEGIN, urls.END
    assert [r.w for r in w if r.t] == [b + b + "a", b + "aé", "aé\U0001f600", "é\U0001f600b", "\U0001f600b" + e] and [r.w for r in w if not r.t] == [b + b + e]


def test_a_large_model_is_not_broadcast(spark, pages, monkeypatch):
    want = {(r.page_id, r.path): r.score for r in urls.judge(pages).where("page_id < 300").collect()}
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 10)
    got = urls.judge(pages)
    assert {(r.page_id, r.path): r.score for r in got.where("page_id < 300").collect()} == {k: pytest.approx(v, abs=1e-12) if v is not None else None for k, v in want.items()}


def test_examples_as_a_table_and_seeds_between_marks(spark, pages):
    hosts = spark.createDataFrame([(h,) for h in ("track.a.net", "soundtrack.net", "x.win-bets.com", "alphabets.org", "pills", None)], "h string")
    assert [r.s for r in hosts.select(urls.seeded(F.col("h"), urls.SEEDS).alias("s")).collect()] == [True, False, True, False, True, False]
    examples = spark.createDataFrame([(f"http://www.site{k % 9}.example.net/en/{k}", k % 2 == 0) for k in range(40)] + [(None, True), ("x", None)] + [(f"http://blog.site{k}.example.net/en/{k}", False) for k in range(60)], "url string, rejected boolean")
    got = urls.judge(pages, examples=examples).where("page_id BETWEEN 1000 AND 1999").toPandas()
    assert len(got) == 60 and got.score.notna().all()


def test_one_long_url_loses_no_class(spark):
    long = "http://good.example.net/" + "a" * 600_000
    every = [long, *[f"http://fine{k}.example.net/page/{k}" for k in range(40)], *[f"http://casino.bad{k}.net/win" for k in range(20)]]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(every)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules=()).collect()}
    assert sum(got[k] == "allow" for k in range(41)) >= 40 and got[0] == "allow" and all(got[k] == "block" for k in range(41, 61))
    unweighed = {r.page_id: r.score for r in urls.judge(pages, rules=(), heavy=None).collect()}
    assert unweighed[0] > 0 > max(unweighed[k] for k in range(41, 61))


@pytest.mark.parametrize("bad", range(4))
def test_one_rejected_example_is_learned_from(spark, bad):
    pages = spark.createDataFrame([(k, f"http://fine{k}.example.net/page/{k}") for k in range(40)] + [(99, f"http://casino.bad{bad}.net/win")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in urls.judge(pages, rules=()).collect()}
    assert got[99][0] == "block" and got[99][1] < min(got[k][1] for k in range(40))


def test_one_accepted_example_is_enough(spark):
    pages = spark.createDataFrame([(k, f"http://casino{k}.casino.net/win") for k in range(9)] + [(9, "http://fine.example.net/page")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules=()).collect()}
    assert got == {**{k: "block" for k in range(9)}, 9: "allow"}


def test_all_examples_are_learned_from_or_calibrate(spark, monkeypatch):
    """Before, 5,000 rows of each class were drawn: what is met in one url of 14,000 was mostly unknown to the model."""
    every = [f"http://fine{k % 90}.example.net/page/{k}" for k in range(8000)] + [f"http://casino.bad{k % 90}.net/win/{k}" for k in range(6000)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(every)], "page_id long, url string").repartition(3)
    given, learn, threshold = {}, urls.learn, urls.threshold
    monkeypatch.setattr(urls, "learn", lambda df, **b: given.update(learned=df.groupBy("rejected").count().collect()) or learn(df, **b))
    monkeypatch.setattr(urls, "threshold", lambda df, loss: given.update(judged=df.count()) or threshold(df, loss))
    got = urls.judge(pages, rules=()).groupBy("verdict").count().collect()
    n = {r.rejected: r["count"] for r in given["learned"]}
    assert n[False] + given["judged"] == 8000 and 1300 < given["judged"] < 1900 and 4500 < n[True] < 5100
    assert 6000 <= {r.verdict: r["count"] for r in got}["block"] < 6160


@pytest.mark.parametrize("n, ties, loss", [(1, 1, 0.01), (2, 1, 0.5), (301, 1, 0.01), (40_000, 1, 0.01), (40_000, 700, 0.01), (40_000, 1, 0.0), (40_000, 1, 1.0)])
def test_threshold_is_the_exact_percentile_of_all(spark, monkeypatch, n, ties, loss):
    monkeypatch.setattr(urls, "ACCURACY", 100)  # as with some hundred times the rows
    scored = spark.range(n).select((F.xxhash64(F.floor(F.col("id") / ties)) / 1e18).alias("score"), F.lit(False).alias("rejected"))
    more = scored.unionByName(scored.select((F.col("score") - 99).alias("score"), F.lit(True).alias("rejected")))
    assert urls.threshold(more, loss) == pytest.approx(scored.agg(F.percentile("score", loss)).first()[0], abs=1e-12)


def test_threshold_without_accepted_rows(spark):
    assert urls.threshold(spark.createDataFrame([(1.0, True)], "score double, rejected boolean"), 0.01) is None
