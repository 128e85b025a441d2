"""Price bars: breadth, sector roll-ups, windows, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import round_half_up, safe_div, truthy
from ledgerline.operators.ranking import top_per_group

# Fund that tracks each sector.
SECTOR_FUND = {
    "Technology": "XLK", "Consumer Discretionary": "XLY", "Financials": "XLF", "Communication Services": "XLC",
    "Real Estate": "XLRE", "Health Care": "XLV", "Industrials": "XLI", "Utilities": "XLU",
    "Consumer Staples": "XLP", "Materials": "XLB", "Energy": "XLE",
}


def closing_signals(bars: DataFrame, average: int = 50) -> DataFrame:
    """Each symbol's newest close with the one before, range and moving average.

    ``bars`` has (symbol, day, close). Symbols with one close drop out.
    """
    w = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    top = bars.where("close IS NOT NULL").withColumn("n", F.row_number().over(w))
    out = top.groupBy("symbol").agg(
        F.max(F.when(F.col("n") == 1, F.col("close"))).alias("last"),
        F.max(F.when(F.col("n") == 2, F.col("close"))).alias("previous"),
        F.max("close").alias("high"), F.min("close").alias("low"),
        F.avg(F.when(F.col("n") <= average, F.col("close").cast("decimal(28,6)"))).cast("double").alias("sma"),
        F.count("*").alias("n_bars"),
    )
    return out.where("n_bars >= 2")


def market_breadth(bars: DataFrame, constituents: DataFrame) -> DataFrame:
    """Advancers, decliners, new highs and lows and the share above average."""
    s = closing_signals(bars.join(constituents.select("symbol").distinct(), "symbol", "left_semi"))
    up, down = F.count_if(F.col("last") > F.col("previous")), F.count_if(F.col("last") < F.col("previous"))
    total = constituents.agg(F.countDistinct("symbol").alias("__total")).select("__total", F.lit(1).alias("__k"))
    agg = s.agg(
        up.alias("advancers"), down.alias("decliners"),
        F.count_if(F.col("last") >= F.col("high")).alias("new_highs"),
        F.count_if(F.col("last") <= F.col("low")).alias("new_lows"),
        F.count_if(F.col("last") > F.col("sma")).alias("__above"), F.count("*").alias("with_signal"),
    ).withColumn("__k", F.lit(1))
    out = agg.join(total, "__k")
    return out.select(
        "advancers", "decliners", round_half_up(safe_div("advancers", "decliners"), 2).alias("adv_dec_ratio"),
        "new_highs", "new_lows",
        round_half_up(safe_div("__above", "with_signal") * 100, 1).alias("pct_above_average"),
        round_half_up(safe_div("with_signal", "__total"), 3).alias("coverage"),
    )


def sector_rollup(bars: DataFrame, company: DataFrame, members: int = 15) -> DataFrame:
    """Cap-weighted change, weight and top members per sector.

    ``company`` has (symbol, shares, sector).
    """
    w = Window.partitionBy("symbol").orderBy(F.col("day").desc())
    two = bars.where("close IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n <= 2")
    last = two.groupBy("symbol").agg(
        F.max(F.when(F.col("n") == 1, F.col("close"))).alias("last"),
        F.max(F.when(F.col("n") == 2, F.col("close"))).alias("previous"),
    )
    df = last.join(company.where("shares <> 0 AND sector IS NOT NULL"), "symbol")
    change = F.coalesce(safe_div(F.col("last") - F.col("previous"), truthy("previous")) * 100, F.lit(0.0))
    df = df.withColumn("cap", (F.col("last") * F.col("shares")).cast("decimal(28,6)"))
    df = df.withColumn("cap_change", (F.col("cap").cast("double") * change).cast("decimal(28,4)"))
    sums = df.groupBy("sector").agg(
        F.sum("cap").alias("__cap"), F.sum("cap_change").alias("__chg"), F.count("*").alias("n_members")
    )
    total = F.sum("__cap").over(Window.partitionBy(F.lit(0)))
    sums = sums.withColumn("weight_pct", round_half_up(F.col("__cap").cast("double") / total.cast("double") * 100, 2))
    sums = sums.withColumn("avg_change_pct", round_half_up(safe_div("__chg", "__cap"), 2))
    top = top_per_group(df, ["sector"], [F.col("cap").desc(), F.col("symbol").desc()], members)
    names = top.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("rn", "symbol"))).alias("__m"))
    fund = F.lit(None).cast("string")
    for sector, symbol in SECTOR_FUND.items():
        fund = F.when(F.col("sector") == sector, F.lit(symbol)).otherwise(fund)
    return sums.join(names, "sector").select(
        "sector", fund.alias("fund"), "weight_pct", "n_members", "avg_change_pct",
        F.transform("__m", lambda m: m["symbol"]).alias("members"),
    )


def price_window(bars: DataFrame, days: int | None = None) -> DataFrame:
    """First and last close, change, range and count per symbol."""
    df = bars
    if days is not None:
        ends = bars.groupBy("symbol").agg(F.max("day").alias("__end"))
        df = bars.join(ends, "symbol").where(F.col("day") > F.date_sub("__end", days))
    out = df.groupBy("symbol").agg(
        F.min("day").alias("start"), F.max("day").alias("end"),
        F.min_by("close", "day").alias("start_close"), F.max_by("close", "day").alias("end_close"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("n_bars"),
    )
    change = safe_div(F.col("end_close") - F.col("start_close"), F.col("start_close")) * 100
    return out.withColumn("change_pct", round_half_up(change, 2))


def day_change(bars: DataFrame) -> DataFrame:
    """Change against the previous bar, absolute and in percent."""
    w = Window.partitionBy("symbol").orderBy("day")
    previous = F.lag("close").over(w)
    df = bars.withColumn("previous", previous)
    known = truthy("previous")
    return df.select(
        "symbol", "day", "close", (F.col("close") - known).alias("change"),
        (safe_div(F.col("close") - known, known) * 100).alias("change_pct"),
    )


def session_day(now: Column, session: Column) -> Column:
    """The trading day a level belongs to: overnight and weekends go back."""
    local = F.from_utc_timestamp(now, "America/New_York")
    day = F.to_date(local)
    day = F.when((session == "closed") & (F.hour(local) < 9), F.date_sub(day, 1)).otherwise(day)
    weekday = F.dayofweek(day)
    back = F.when(weekday == 7, 1).when(weekday == 1, 2).otherwise(0)
    return F.date_sub(day, back)


def stitch_level(history: DataFrame, level: DataFrame) -> DataFrame:
    """Append the latest level where the history ends before its session day.

    ``history`` is (symbol, day, level); ``level`` is (symbol, level, now,
    session).
    """
    last = history.groupBy("symbol").agg(F.max("day").alias("__last"))
    live = level.where("level IS NOT NULL").select("symbol", "level", session_day(F.col("now"), F.col("session")).alias("day"))
    newer = live.join(last, "symbol").where(F.col("__last") < F.col("day"))
    return history.select("symbol", "day", "level").unionByName(newer.select("symbol", "day", "level"))


def forward_dividend(dividends: DataFrame, prices: DataFrame) -> DataFrame:
    """Newest cash amount times frequency, and its yield on the price."""
    newest = top_per_group(dividends, ["symbol"], [F.col("ex_date").desc()], 1).drop("rn")
    amount = truthy(F.col("cash_amount").cast("double")) * truthy(F.col("frequency").cast("double"))
    out = newest.withColumn("forward_dividend", round_half_up(amount, 4)).join(prices.select("symbol", "price"), "symbol", "left")
    pct = safe_div("forward_dividend", "price") * 100
    return out.select("symbol", "ex_date", "forward_dividend", round_half_up(pct, 2).alias("yield_pct"))


def split_text(to: Column, from_: Column) -> Column:
    return F.concat(to.cast("string"), F.lit("-for-"), from_.cast("string"))
