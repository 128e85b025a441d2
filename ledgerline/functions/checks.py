"""Data-quality rules on wide metrics, balance repair and presentation shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import money_text, or_zero, safe_div, truthy

# Tolerances of the rules, as fractions.
BALANCE_GAP = 0.05
GROSS_PROFIT_GAP = 0.02
TAX_TIE_GAP = 0.05


def balance_gap(assets: Column, liabilities: Column, equity: Column, nci: Column) -> Column:
    """Relative miss of assets = liabilities + equity + minority interest."""
    miss = F.abs(assets - (liabilities + equity + or_zero(nci)))
    return F.when(assets == 0, F.lit(0.0)).otherwise(miss / assets)


def _at_least_one(c: Column) -> Column:
    return F.greatest(F.abs(c), F.lit(1.0))


def balance_repair(assets: Column, liabilities: Column, equity: Column, nci: Column) -> Column:
    """The first repair that applies, as (strategy, equity, liabilities)."""
    derived = assets - liabilities
    share = F.when(assets > 0, derived / assets).otherwise(0.0)
    use_difference = (
        (derived > 0) & (F.abs(derived - equity) / _at_least_one(equity) > 0.05) & (share > 0.01) & (share < 0.9)
    )
    rest = assets - equity
    was_total = (F.abs(liabilities - assets) / _at_least_one(assets) < 0.02) & (rest > 0)
    with_nci = equity + nci
    add_nci = (nci > 0) & (F.abs(assets - (liabilities + with_nci)) / _at_least_one(assets) < 0.05)
    better = (
        F.abs(assets - (rest + equity)) / _at_least_one(assets)
        < F.abs(assets - (liabilities + equity)) / _at_least_one(assets)
    ) & (rest > 0)

    def fix(name: str, eq: Column, tl: Column) -> Column:
        return F.struct(F.lit(name).alias("strategy"), eq.alias("equity"), tl.alias("liabilities"))

    return (
        F.when(use_difference, fix("equity_from_difference", derived, liabilities))
        .when(was_total, fix("liabilities_were_total", equity, rest))
        .when(add_nci, fix("minority_added", with_nci, liabilities))
        .when(better, fix("liabilities_from_difference", equity, rest))
    )


def repair_balance(df: DataFrame) -> DataFrame:
    """Repair rows whose balance sheet misses by more than the tolerance.

    Adds ``repair`` (strategy or NULL), ``gap_before`` and ``gap_after``.
    """
    c = F.col
    known = c("total_assets").isNotNull() & c("total_liabilities").isNotNull() & c("stockholders_equity").isNotNull()
    gap = F.when(known, balance_gap(c("total_assets"), c("total_liabilities"), c("stockholders_equity"), c("minority_interest")))
    nci = truthy("minority_interest")
    out = df.withColumn("gap_before", gap)
    fix = F.when(
        c("gap_before") > BALANCE_GAP,
        balance_repair(c("total_assets"), c("total_liabilities"), c("stockholders_equity"), nci),
    )
    out = out.withColumn("__fix", fix)
    out = out.withColumns({
        "stockholders_equity": F.coalesce(c("__fix.equity"), c("stockholders_equity")),
        "total_liabilities": F.coalesce(c("__fix.liabilities"), c("total_liabilities")),
        "repair": c("__fix.strategy"),
    })
    after = F.when(known, balance_gap(c("total_assets"), c("total_liabilities"), c("stockholders_equity"), c("minority_interest")))
    return out.withColumn("gap_after", after).drop("__fix")


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number((c * 100).cast(f"decimal(28,{digits})"), digits), F.lit("%"))


def validate(df: DataFrame, industry: str = "industry", confidence: dict[str, str] | None = None) -> DataFrame:
    """Add ``warnings``: an array of (rule, severity, message).

    Runs on the output of :func:`repair_balance`. ``confidence`` names the
    confidence columns of revenue and net income, if there are any.
    """
    c = F.col
    rev, ni, gp, cor = c("revenue"), c("net_income"), c("gross_profit"), c("cost_of_revenue")
    pretax, tax = c("income_before_tax"), c("income_tax_expense")

    def warn(cond: Column, rule: str, severity: Column | str, *message: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        parts = [F.lit(p) if isinstance(p, str) else p for p in message]
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(rule).alias("rule"), level.alias("severity"), F.concat(*parts).alias("message")),
        )

    both = (rev > 0) & (ni > 0)
    off = c("gap_before") > BALANCE_GAP
    fixed = off & c("repair").isNotNull() & (c("gap_after") <= BALANCE_GAP)
    expected_gp = rev - F.abs(cor)
    expected_ni = pretax - tax
    margin = safe_div(ni, rev)
    checks = [
        warn(both & (ni > rev), "revenue_gt_net_income", "error",
             "Net income ", money_text(ni), " exceeds revenue ", money_text(rev)),
        warn(fixed, "accounting_equation_repaired", "info", "Balance sheet repaired: ", F.coalesce(c("repair"), F.lit(""))),
        warn(off & ~fixed, "accounting_equation", "warning",
             "Assets ", money_text(c("total_assets")), " miss liabilities plus equity by ",
             percent_text(F.coalesce(c("gap_after"), c("gap_before")))),
        warn(rev.isNull(), "revenue_missing", "warning", "No revenue could be resolved"),
        warn(ni.isNull(), "net_income_missing", "warning", "No net income could be resolved"),
        warn((c(industry) == "bank") & both & (rev < ni * 0.8), "bank_revenue_segment", "error",
             "Revenue ", money_text(rev), " looks like a segment only"),
        warn((c(industry) == "standard") & (rev > 0) & ((gp / rev < 0) | (gp / rev > 1)), "gross_margin_range", "warning",
             "Gross margin ", percent_text(safe_div(gp, rev)), " is outside 0-100%"),
        warn((rev > 0) & (F.abs(margin) > 1), "net_margin_extreme", "warning",
             "Net margin is ", percent_text(margin, 0)),
        warn((rev != 0) & (F.abs(gp - expected_gp) / _at_least_one(rev) > GROSS_PROFIT_GAP), "gross_profit_identity",
             "warning", "Gross profit ", money_text(gp), " is not revenue less cost ", money_text(expected_gp)),
        warn((pretax != 0) & (F.abs(ni - expected_ni) / _at_least_one(pretax) > TAX_TIE_GAP), "pretax_tax_tie",
             "info", "Net income ", money_text(ni), " is not pretax income less tax ", money_text(expected_ni)),
    ]
    for metric, name in (confidence or {}).items():
        low = (c(name) > 0) & (c(name) < 0.50)
        checks.append(warn(low, f"low_confidence_{metric}", "warning", f"{metric} has low confidence ", percent_text(c(name), 0)))
    return df.withColumn("warnings", F.array_compact(F.array(*checks)))


# Statement field names of the outside vocabulary and the metric
# behind each; a minus marks outflows shown as negative amounts.
STATEMENT_FIELDS = {
    "income": (
        ("revenue", "revenue"),
        ("costOfRevenue", "cost_of_revenue"),
        ("grossProfit", "gross_profit"),
        ("operatingExpenses", "operating_expenses"),
        ("depreciationAndAmortization", "depreciation_amortization"),
        ("ebitda", "ebitda"),
        ("ebit", "operating_income"),
        ("operatingIncome", "operating_income"),
        ("interestExpense", "interest_expense"),
        ("incomeBeforeTax", "income_before_tax"),
        ("incomeTaxExpense", "income_tax_expense"),
        ("netIncome", "net_income"),
        ("bottomLineNetIncome", "net_income"),
        ("epsDiluted", "eps_diluted"),
        ("weightedAverageShsOut", "shares_outstanding"),
    ),
    "balance": (
        ("cashAndCashEquivalents", "cash_and_equivalents"),
        ("totalCurrentAssets", "current_assets"),
        ("totalAssets", "total_assets"),
        ("shortTermDebt", "short_term_debt"),
        ("totalCurrentLiabilities", "current_liabilities"),
        ("longTermDebt", "long_term_debt"),
        ("totalLiabilities", "total_liabilities"),
        ("totalStockholdersEquity", "stockholders_equity"),
    ),
    "cashflow": (
        ("operatingCashFlow", "operating_cash_flow"),
        ("netCashProvidedByOperatingActivities", "operating_cash_flow"),
        ("capitalExpenditure", "-capital_expenditures"),
        ("freeCashFlow", "free_cash_flow"),
        ("commonDividendsPaid", "-dividends_paid"),
        ("netDividendsPaid", "-dividends_paid"),
        ("commonStockRepurchased", "-shares_repurchased"),
    ),
}


def statement_shape(df: DataFrame, statement: str, base: tuple[str, ...] = ("cik", "fy", "end_date")) -> DataFrame:
    """Project metrics to one statement of the outside vocabulary."""
    cols = []
    for name, metric in STATEMENT_FIELDS[statement]:
        outflow = metric.startswith("-")
        metric = metric.lstrip("-")
        value = F.col(metric) if metric in df.columns else F.lit(None).cast("double")
        cols.append((-F.abs(value) if outflow else value).alias(name))
    if statement == "balance":
        total = F.col("total_equity") if "total_equity" in df.columns else F.lit(None).cast("double")
        cols.append(F.coalesce(truthy(total), F.col("stockholders_equity")).alias("totalEquity"))
    return df.select(*base, *cols)


def metric_aliases(df: DataFrame) -> DataFrame:
    """Second names some consumers read: total_equity and net_debt."""
    have = set(df.columns)
    equity = F.coalesce(F.col("total_equity"), F.col("stockholders_equity")) if "total_equity" in have else F.col("stockholders_equity")
    debt = F.col("total_debt") - or_zero("cash_and_equivalents")
    net = F.coalesce(F.col("net_debt"), debt) if "net_debt" in have else debt
    return df.withColumns({"total_equity": equity, "net_debt": net})


def camel_projection(df: DataFrame, base: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Snake-case metric columns under camel-case names."""

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(w.capitalize() for w in rest)

    return df.select(*base, *[F.col(m).alias(camel(m)) for m in metrics])


def narrative(df: DataFrame, name: str = "name") -> Column:
    """A short template text per company and year; missing figures drop out."""
    c = F.col

    def piece(value: Column, *parts: Column | str) -> Column:
        text = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(value.isNotNull(), F.concat(*text))

    verb = F.when(c("revenue_growth") > 0, "grew").when(c("revenue_growth") < 0, "fell").otherwise("was flat, changing")
    health = (
        F.when(c("current_ratio") >= 2, "strong").when(c("current_ratio") >= 1, "adequate").otherwise("tight")
    )
    return F.concat_ws(
        " ",
        piece(c(name), c(name), " (fiscal ", c("fy").cast("string"), ")."),
        piece(c("revenue"), "Revenue ", money_text("revenue"), "."),
        piece(c("revenue_growth"), "Revenue ", verb, " ", percent_text(F.abs("revenue_growth")), " from the prior year."),
        piece(c("net_income"), F.when(c("net_income") < 0, "Net loss ").otherwise("Net income "), money_text("net_income"), "."),
        piece(c("net_margin"), "Net margin ", percent_text(c("net_margin")), "."),
        piece(c("free_cash_flow"), "Free cash flow ", money_text("free_cash_flow"), "."),
        piece(c("current_ratio"), "Liquidity is ", health, "."),
    )
