"""Cross-checks, period and company comparisons, statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import round_half_up, safe_div
from ledgerline.operators.ranges import day_number, window_join
from ledgerline.operators.ranking import top_per_group

CHECKED = ("revenue", "net_income", "total_assets", "eps")


def cross_check(
    own: DataFrame, vendor: DataFrame, *, timeframe: str = "annual", days: int = 14, tolerance: float = 5.0
) -> DataFrame:
    """Compare each company's metrics with a second source.

    ``own`` and ``vendor`` are long (cik, end_date, metric, value), ``vendor``
    with ``timeframe``. The vendor's newest report within ``days`` of our
    period end is aligned; else its newest report of the timeframe is used and
    marked unaligned, else its newest report of any kind.
    """
    # Reports first: one row per company and end, so that metrics of one
    # comparison come from one report.
    ends = own.select("cik", "end_date").distinct()
    # A period of ours has at most one report per end, so keep the kind whose
    # rows are wanted and let the rest be the last resort.
    reports = vendor.select("cik", F.col("end_date").alias("v_end"), "timeframe").distinct()
    wanted = reports.where(F.lower("timeframe") == timeframe)
    day = day_number(F.col("end_date"))
    near = window_join(
        ends, wanted.select("cik", "v_end"), ["cik"], day - days, day + days, day_number(F.col("v_end")), 2 * days + 1
    )
    aligned = near.groupBy("cik", "end_date").agg(F.max("v_end").alias("a_end"))
    newest = wanted.groupBy("cik").agg(F.max("v_end").alias("t_end"))
    any_kind = reports.groupBy("cik").agg(F.max_by("timeframe", F.struct("v_end", "timeframe")).alias("any_kind"),
                                          F.max("v_end").alias("any_end"))
    pick = ends.join(aligned, ["cik", "end_date"], "left").join(newest, "cik", "left").join(any_kind, "cik", "left")
    pick = pick.select(
        "cik", "end_date", F.coalesce("a_end", "t_end", "any_end").alias("v_end"),
        F.when(F.coalesce("a_end", "t_end").isNull(), F.col("any_kind")).otherwise(F.lit(timeframe)).alias("v_kind"),
        F.col("a_end").isNotNull().alias("aligned"),
    )
    v = vendor.select(
        "cik", F.col("end_date").alias("v_end"), F.lower("timeframe").alias("v_kind"), "metric",
        F.col("value").alias("vendor_value"),
    )
    out = own.join(pick, ["cik", "end_date"]).join(v, ["cik", "v_end", "v_kind", "metric"], "left")
    both = F.col("value").isNotNull() & F.col("vendor_value").isNotNull()
    diff = (
        F.when(F.col("vendor_value") == 0, F.when(F.col("value") == 0, 0.0).otherwise(100.0))
        .otherwise(safe_div(F.abs(F.col("value") - F.col("vendor_value")), F.abs("vendor_value")) * 100)
    )
    neither = F.col("value").isNull() & F.col("vendor_value").isNull()
    basis = F.concat(
        F.lit(f"{timeframe}_vs_"), F.coalesce("v_kind", F.lit("none")), F.lit("_"), F.coalesce(F.col("v_end").cast("string"), F.lit("none")),
        F.when(F.col("aligned"), "").otherwise("_unaligned"),
    )
    return out.withColumns({
        "diff_pct": F.when(both, diff).otherwise(0.0),
        "match": F.when(both, diff <= tolerance).otherwise(neither),
        "basis": basis,
    }).select("cik", "end_date", "metric", "value", "vendor_value", "diff_pct", "match", "basis")


def cross_check_status(own: DataFrame, vendor: DataFrame, days: int = 10, tolerance: float = 2.0) -> DataFrame:
    """ok, mismatch or unavailable per company period, from revenue and income."""
    two = F.col("metric").isin("revenue", "net_income")
    mine = own.where(two)
    day = day_number(F.col("end_date"))
    reports = vendor.where(F.lower("timeframe").isin("annual", "ttm")).select("cik", F.col("end_date").alias("v_end")).distinct()
    near = window_join(
        mine.select("cik", "end_date").distinct(), reports, ["cik"], day - days, day + days,
        day_number(F.col("v_end")), 2 * days + 1,
    )
    pick = near.groupBy("cik", "end_date").agg(F.max("v_end").alias("v_end"))
    theirs = vendor.where(two).select("cik", F.col("end_date").alias("v_end"), "metric", F.col("value").alias("v"))
    out = mine.join(pick, ["cik", "end_date"], "left").join(theirs, ["cik", "v_end", "metric"], "left")
    usable = F.col("value").isNotNull() & (F.col("v") != 0)
    ok = F.abs(F.col("value") - F.col("v")) / F.abs("v") * 100 <= tolerance
    per = out.groupBy("cik", "end_date").agg(
        F.count_if(usable).alias("checks"), F.min(F.when(usable, ok)).alias("__ok")
    )
    status = F.when(F.col("checks") == 0, "unavailable").when(F.col("__ok"), "ok").otherwise("mismatch")
    return per.withColumn("status", status).drop("__ok")


def significance(pct: Column, major: float = 20.0, moderate: float = 10.0) -> Column:
    size = F.abs(pct)
    return F.when(size > major, "major").when(size > moderate, "moderate").otherwise("minor")


def metric_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """The metrics present on either side."""
    return a.select("metric").union(b.select("metric")).distinct()


def diff_periods(long: DataFrame, year1: int, year2: int, *, absolute_base: bool = True, keys: Sequence[str] = ("cik", "metric")) -> DataFrame:
    """Every metric of either year: change, percent and significance.

    Missing counts as zero for the change. A zero base gives 0 or 999.9.
    """
    def side(year: int, name: str) -> DataFrame:
        return long.where(F.col("fy") == year).groupBy(*keys).agg(F.max("value").alias(name))

    both = side(year1, "year1").join(side(year2, "year2"), list(keys), "full_outer")
    v1, v2 = F.coalesce("year1", F.lit(0.0)), F.coalesce("year2", F.lit(0.0))
    change = (v2.cast("decimal(28,4)") - v1.cast("decimal(28,4)")).cast("double")
    base = F.abs(v1) if absolute_base else v1
    pct = F.when(v1 != 0, safe_div(change, base) * 100).when(v2 == 0, 0.0).otherwise(999.9)
    return both.withColumns({"change": change, "change_pct": pct}).withColumn(
        "significance", significance(F.col("change_pct"))
    )


def diff_ratios(long: DataFrame, year1: int, year2: int, keys: Sequence[str] = ("cik", "metric")) -> DataFrame:
    """Ratios of two years; changes above 15 percent are notable."""
    a = long.where(F.col("fy") == year1).select(*keys, F.col("value").alias("year1"))
    b = long.where(F.col("fy") == year2).select(*keys, F.col("value").alias("year2"))
    out = a.join(b, list(keys)).where("year1 <> 0")
    pct = safe_div(F.col("year2") - F.col("year1"), F.abs("year1")) * 100
    return out.withColumn("change_pct", pct).withColumn("significance", significance(F.col("change_pct"), 30.0, 15.0))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One line per company that names its major changes."""
    sign = F.when(F.col("change_pct") >= 0, "+").otherwise("")
    text = F.concat("metric", F.lit(": "), sign, F.col("change_pct").cast("decimal(28,1)").cast("string"), F.lit("%"))
    major = F.when(F.col("significance") == "major", F.struct("metric", text.alias("t")))
    names = F.transform(F.array_sort(F.collect_list(major)), lambda x: x["t"])
    per = diff.groupBy("cik").agg(names.alias("__t"))
    line = F.when(F.size("__t") > 0, F.concat(F.lit("Major changes: "), F.array_join("__t", ", ")))
    return per.select("cik", F.coalesce(line, F.lit("No major changes; all metrics shifted < 20%")).alias("summary"))


def compare_companies(long: DataFrame, tickers: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric by ticker for a handful of companies, newest period of each."""
    wanted = long.where(F.col("ticker").isin(*tickers) & F.col("metric").isin(*metrics))
    newest = top_per_group(wanted, ["ticker", "metric"], [F.col("end_date").desc()], 1)
    return newest.groupBy("metric").pivot("ticker", list(tickers)).agg(F.max("value"))


def compare_failures(long: DataFrame, tickers: DataFrame) -> DataFrame:
    """Requested tickers without any figures."""
    return tickers.join(long.select("ticker").distinct(), "ticker", "left_anti")


def chart_series(long: DataFrame, metrics: Sequence[str], limit: int | None = None) -> DataFrame:
    """Ordered arrays per company and metric, oldest first."""
    df = long.where(F.col("metric").isin(*metrics))
    if limit is not None:
        df = top_per_group(df, ["cik", "metric"], [F.col("end_date").desc()], limit)
    points = F.array_sort(F.collect_list(F.struct("end_date", "value")))
    out = df.groupBy("cik", "metric").agg(points.alias("__p"))
    return out.select(
        "cik", "metric", F.transform("__p", lambda p: p["end_date"]).alias("end_dates"),
        F.transform("__p", lambda p: p["value"]).alias("values"),
    )


# Which statement a metric belongs to.
STATEMENTS = {
    "income": ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "eps_diluted"),
    "balance": ("total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents"),
    "cashflow": ("operating_cash_flow", "capital_expenditures", "free_cash_flow"),
}


def assemble_statements(long: DataFrame) -> DataFrame:
    """The three statements of each period side by side, with provenance.

    One conditional aggregation instead of joining three tables by date.
    """
    aggs = []
    for name, metrics in STATEMENTS.items():
        mine = F.col("metric").isin(*metrics)
        aggs.append(F.count_if(mine).alias(f"{name}_lines"))
        aggs += [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return long.groupBy("cik", "end_date").agg(*aggs)


# Income statement lines per industry class, in order; a line
# without a metric is a heading.
TEMPLATES = {
    "bank": """Total Revenue (Net Revenues)|revenue
        Interest Expense|interest_expense
        Provision for Credit Losses|provision_for_credit_losses
        Operating Income|operating_income
        Other Income / (Expense)|other_income_expense
        Income Before Tax|income_before_tax
        Income Tax Expense|income_tax_expense
        Net Income|net_income
        EPS - Basic|eps_basic
        EPS - Diluted|eps_diluted
        Shares Outstanding|shares_outstanding""",
    "insurance": """Total Revenue (Premiums + Investment Income)|revenue
        Operating Expenses (Losses + Underwriting)|operating_expenses
        Operating Income|operating_income
        Interest Expense|interest_expense
        Income Before Tax|income_before_tax
        Income Tax Expense|income_tax_expense
        Net Income|net_income
        EPS - Diluted|eps_diluted""",
    "reit": """Total Revenue (Rental + Other)|revenue
        Operating Expenses|operating_expenses
        Depreciation & Amortization|depreciation_amortization
        Operating Income|operating_income
        Interest Expense|interest_expense
        Net Income|net_income
        FFO Reconciliation|
        Net Income (FFO start)|net_income
        (+) Real Estate D&A|depreciation_amortization
        FFO (Funds From Operations)|reit_ffo""",
    "standard": """Revenue|revenue
        Cost of Revenue|cost_of_revenue
        Gross Profit|gross_profit
        Research & Development|rd_expense
        Selling, General & Administrative|sga_expense
        Operating Expenses|operating_expenses
        Operating Income (EBIT)|operating_income
        Interest Expense|interest_expense
        Other Income / (Expense)|other_income_expense
        Pre-Tax Income|income_before_tax
        Income Tax Expense|income_tax_expense
        Net Income|net_income
        EPS - Basic|eps_basic
        EPS - Diluted|eps_diluted
        Shares Outstanding|shares_outstanding""",
}


def template_lines() -> list[tuple[str, int, str, str]]:
    """(template, line number, label, metric); numbers leave room between lines."""
    out = []
    for name, text in TEMPLATES.items():
        for n, line in enumerate(text.splitlines(), start=1):
            label, metric = line.strip().rsplit("|", 1)
            out.append((name, n * 10, label, metric))
    return out


def industry_statement(wide: DataFrame, prior: DataFrame, industry: DataFrame) -> DataFrame:
    """Income statement lines by industry template, current and prior value.

    ``wide`` and ``prior`` hold one row of metric columns per company. Lines
    without either value drop out, headings stay, and a gross margin line
    follows gross profit.
    """
    spark = wide.sparkSession
    have = [c for c in wide.columns if c != "cik"]
    lines = template_lines()
    table = F.broadcast(spark.createDataFrame(lines, "template string, line_no int, label string, metric string"))
    both = wide.join(prior.select("cik", *[F.col(m).alias(f"p_{m}") for m in have]), "cik", "left")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"p_{m}").alias("prior_value")) for m in have]
    # The heading's empty metric, and the margin under a name of its own.
    cells.append(F.struct(F.lit("").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("prior_value")))
    margin = safe_div("gross_profit", F.nullif(F.col("revenue"), F.lit(0.0))) * 100
    shown = F.col("gross_profit") != 0
    old = F.when(F.col("p_gross_profit") != 0, safe_div("p_gross_profit", "p_revenue") * 100)
    cells.append(F.struct(
        F.lit("gross_profit").alias("metric"), F.when(shown, margin).alias("value"),
        F.when(shown & margin.isNotNull(), old).alias("prior_value"),
    ))
    marks = F.array(*[F.lit(False)] * (len(cells) - 1), F.lit(True))
    kind = F.when(F.col("industry").isin("bank", "insurance", "reit"), F.col("industry")).otherwise("standard")
    flat = both.select("cik", F.explode(F.arrays_zip(F.array(*cells).alias("c"), marks.alias("m"))).alias("z"))
    flat = flat.select("cik", F.col("z.m").alias("is_margin"), "z.c.*")
    out = flat.join(industry.select("cik", kind.alias("template")), "cik").join(table, ["template", "metric"])
    known = F.col("value").isNotNull() | F.col("prior_value").isNotNull()
    standard = F.col("template") == "standard"
    out = out.where((F.col("metric") == "") | (known & (~F.col("is_margin") | standard)))
    return out.select(
        "cik", "template", (F.col("line_no") + F.when(F.col("is_margin"), 1).otherwise(0)).alias("line_no"),
        F.when(F.col("is_margin"), "Gross Margin %").otherwise(F.col("label")).alias("label"), "value", "prior_value",
    )


def export_rows(wide: DataFrame, prior: DataFrame, metrics: Sequence[str], ratios: Sequence[str], keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Long export: metric rows with change, then ratio rows."""
    both = wide.select(*keys, *metrics, *ratios).join(
        prior.select(*keys, *[F.col(m).alias(f"p_{m}") for m in metrics]), list(keys), "left"
    )
    parts = []
    for n, m in enumerate(metrics):
        cur, old = F.col(m), F.col(f"p_{m}")
        change = round_half_up(safe_div(cur - old, F.abs(old)) * 100, 2)
        parts.append(F.struct(F.lit(n).alias("line_no"), F.lit(m).alias("metric_name"), cur.alias("current_value"),
                              old.alias("prior_value"), change.alias("change_pct")))
    empty = F.lit(None).cast("double")
    for n, r in enumerate(ratios, start=len(metrics)):
        parts.append(F.struct(F.lit(n).alias("line_no"), F.lit(f"ratio_{r}").alias("metric_name"),
                              F.col(r).alias("current_value"), empty.alias("prior_value"), empty.alias("change_pct")))
    rows = both.select(*keys, F.explode(F.array(*parts)).alias("r")).select(*keys, "r.*")
    return rows.where("current_value IS NOT NULL OR prior_value IS NOT NULL")
