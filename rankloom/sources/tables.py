"""Price panels, page texts and stand-ins for fundamentals out of the test tables, which have no price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _panel(rows: DataFrame, letter: str, key: str, day: str, close) -> DataFrame:
    """Grouped by the number that keys the table; the ticker is made of it once a group."""
    daily = rows.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key).alias("_key"), F.to_date(day).alias("date")).agg(F.max(close).alias("close"))
    return daily.select(F.concat(F.lit(letter), F.col("_key").cast("string"), F.lit(".NS")).alias("ticker"), "date", "close")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), "S", "l_suppkey", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"))


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), "P", "l_partkey", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"))


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return _panel(rows, "N", "c_nationkey", "o_orderdate", F.col("o_totalprice"))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "events"), "U", "user_id", "ts", F.col("value"))


def supplier_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, symbol, name of every supplier, and of as many that no panel has."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name"))
    gone = rows.select(F.concat(F.lit("X"), "ticker").alias("ticker"), "name")
    return rows.unionByName(gone).withColumn("symbol", F.concat("ticker", F.lit(".NS")))


def quarterly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and cells (quarter, total as text) of each nation's orders."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    sums = rows.groupBy("c_nationkey", period.alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("raw"))
    ticker = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(".NS"))
    return sums.groupBy(ticker.alias("ticker")).agg(F.sort_array(F.collect_list(F.struct("period", "raw"))).alias("cells"))


def weekly_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and table rows: each user's weekly sums of two event types stand for two holders."""
    kinds = {"purchase": "FIIs +", "signup": "DIIs +"}
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds) & F.col("user_id").isNotNull())
    label = F.when(F.col("event_type") == "purchase", kinds["purchase"]).otherwise(kinds["signup"])
    period = F.date_format(F.trunc(F.to_date("ts"), "week"), "yyyy-MM-dd")
    sums = rows.groupBy("user_id", label.alias("label"), period.alias("period")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    cells = sums.groupBy("user_id", "label").agg(F.sort_array(F.collect_list(F.struct("period", F.concat(F.col("total").cast("string"), F.lit("%")).alias("raw")))).alias("cells"))
    row = F.struct(F.lit("shareholding").alias("section"), F.when(F.col("label") == kinds["purchase"], 0).otherwise(1).alias("row_no"), "label", "cells")
    ticker = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return cells.groupBy(ticker.alias("ticker")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company page for every supplier, whose figures come from its key and balance."""
    s = table(spark, sf_dir, "supplier")
    k, cap = F.col("s_suppkey"), F.col("s_acctbal").cast("long").cast("string")
    cell = lambda tag, *values: F.concat(*[F.concat(F.lit(f"<{tag}>"), v if not isinstance(v, str) else F.lit(v), F.lit(f"</{tag}>")) for v in values])
    text = lambda c: c.cast("string")
    html = F.concat(
        F.lit('<ul id="top-ratios"><li>P/E 20<li><span>Market Cap</span> ₹ <b>'), cap, F.lit("</b> Cr.</li></ul>"),
        F.lit('<section id="quarters"><table><thead><tr>'), cell("th", "", "Dec 2023", "Mar 2024"), F.lit("</tr></thead><tbody><tr>"),
        cell("td", "Sales&nbsp;+", text(100 + k % 7), text(100 + k % 31)), F.lit("</tr></tbody></table></section>"),
        F.lit('<section id="profit-loss"><table><tr>'), cell("th", "", "Mar 2023", "Mar 2024", "TTM"), F.lit("<tr>"),
        cell("td", "Revenue +", text(200 + k % 11), text(200 + k % 97), "9,999"), F.lit("</table></section>"),
        F.lit('<section id="shareholding"><table><thead><tr>'), cell("th", "", "Dec 2023", "Mar 2024"), F.lit("</tr></thead><tbody><tr>"),
        cell("td", "Promoters +", F.concat(text(50 + k % 5), F.lit(".10%")), F.concat(text(50 + k % 13), F.lit(".35%"))), F.lit("</tr></tbody></table></section>"),
    )
    ticker = F.concat(F.lit("S"), text(k))
    return s.select(ticker.alias("ticker"), F.concat(F.lit("https://pages.example.com/company/"), ticker, F.lit("/consolidated/")).alias("page_url"), html.alias("html"))
