"""Insider transactions, holders and beneficial-ownership filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import round_half_up
from ledgerline.operators.ranking import top_per_group

# Transaction codes.
TRANSACTION_CODES = {
    "P": "Purchase", "S": "Sale", "A": "Grant/Award", "D": "Disposition (non-open-market)",
    "F": "Tax Payment (shares withheld)", "M": "Option Exercise", "C": "Conversion", "E": "Expiration",
    "G": "Gift", "H": "Expiration (short position)", "I": "Discretionary", "J": "Other", "K": "Equity Swap",
    "U": "Disposition pursuant to tender offer", "V": "Transaction voluntarily reported",
    "W": "Acquisition/disposition by will or laws of descent", "X": "Option Exercise",
    "Z": "Deposit/withdrawal from voting trust",
}


def transaction_type(code: Column) -> Column:
    """Readable type of a code; unknown codes pass through."""
    out = code
    for key, text in TRANSACTION_CODES.items():
        out = F.when(code == key, F.lit(text)).otherwise(out)
    return out


def trade_side(kind: Column) -> Column:
    return (
        F.when(kind == "Purchase", "buy")
        .when(kind.isin("Sale", "Disposition pursuant to tender offer"), "sell")
        .otherwise("other")
    )


def combine_tables(non_derivative: DataFrame, derivative: DataFrame) -> DataFrame:
    """Both transaction tables in one frame, told apart by ``table``."""
    a = non_derivative.withColumn("table", F.lit("non_derivative"))
    b = derivative.withColumn("table", F.lit("derivative"))
    return a.unionByName(b, allowMissingColumns=True)


def insider_summary(transactions: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Buy and sell counts, net shares and sentiment per company.

    ``transactions`` has (cik, txn_date, transaction_type, shares).
    """
    recent = transactions.where(F.col("txn_date") >= F.date_sub(as_of, days))
    buy, sell = F.col("transaction_type") == "Purchase", F.col("transaction_type") == "Sale"
    shares = F.col("shares").cast("decimal(28,2)")
    net = F.sum(F.when(buy, shares).when(sell, -shares).otherwise(F.lit(0).cast("decimal(28,2)")))
    out = recent.groupBy("cik").agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), net.cast("double").alias("net_shares")
    )
    mood = (
        F.when((F.col("buys") > F.col("sells")) & (F.col("net_shares") > 0), "Buying")
        .when((F.col("sells") > F.col("buys")) & (F.col("net_shares") < 0), "Selling")
        .otherwise("Neutral")
    )
    return out.withColumn("sentiment", mood)


def insider_activity(transactions: DataFrame) -> DataFrame:
    """Buy, sell and other counts with net shares per company."""
    side = trade_side(F.col("transaction_type"))
    shares = F.col("shares").cast("decimal(28,2)")
    signed = F.when(side == "buy", shares).when(side == "sell", -shares).otherwise(F.lit(0).cast("decimal(28,2)"))
    return transactions.groupBy("cik").agg(
        F.count_if(side == "buy").alias("buy_count"), F.count_if(side == "sell").alias("sell_count"),
        F.count_if(side == "other").alias("other_count"), F.sum(signed).cast("double").alias("net_shares"),
    )


def notable_transactions(transactions: DataFrame, as_of: Column, days: int = 90, n: int = 5) -> DataFrame:
    """The largest transactions by absolute value in the window."""
    recent = transactions.where((F.col("txn_date") >= F.date_sub(as_of, days)) & F.col("total_value").isNotNull())
    return top_per_group(recent, ["cik"], [F.abs("total_value").desc(), F.col("accn")], n)


def with_total_value(transactions: DataFrame) -> DataFrame:
    """Shares times price in cents."""
    value = F.col("shares").cast("decimal(28,4)") * F.col("price").cast("decimal(28,4)")
    return transactions.withColumn("total_value", round_half_up(value, 2))


def holder_families(holders: DataFrame, keys: tuple[str, ...] = ("cik",)) -> DataFrame:
    """Holders grouped by the first word of their name, families without a stake dropped."""
    name = F.trim("institution")
    word = F.split_part(F.regexp_replace(name, "\\s+", " "), F.lit(" "), F.lit(1))
    df = holders.where(name != "").withColumn("family", F.regexp_replace(F.lower(word), "[.,]+$", ""))
    out = df.groupBy(*keys, "family").agg(
        F.sum(F.col("pct").cast("decimal(28,2)")).cast("double").alias("pct"),
        F.sum(F.col("shares").cast("decimal(28,2)")).cast("double").alias("shares"),
        F.array_sort(F.collect_set(name)).alias("entities"),
    )
    return out.where("pct > 0")


def issuer_positions(holdings: DataFrame) -> DataFrame:
    """Total position per issuer from each filer's newest report."""
    newest = top_per_group(holdings, ["cik", "institution"], [F.col("filed").desc(), F.col("filing_no").desc()], 1)
    return newest.groupBy("cik").agg(
        F.count("*").alias("filers"),
        F.sum(F.col("shares").cast("decimal(28,2)")).cast("double").alias("shares"),
        F.sum(F.col("value").cast("decimal(28,2)")).cast("double").alias("value"),
    )


def beneficial_filings(filings: DataFrame) -> DataFrame:
    """Ownership filings above five percent: activist (D) or passive (G)."""
    form = F.col("form")
    mine = form.rlike("^(SC|SCHEDULE) 13[DG]")
    kind = F.when(form.contains("13D"), "activist").otherwise("passive")
    return filings.where(mine).withColumn("kind", kind)
