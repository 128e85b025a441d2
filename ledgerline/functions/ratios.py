"""Ratios and valuation multiples as column expressions; ratios are fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import or_zero, positive, safe_div, truthy

STATUTORY_TAX = 0.21

# Fractions shown as percent.
PERCENT_KEYS = (
    "gross_margin", "operating_margin", "net_margin", "return_on_assets", "return_on_equity",
    "roe", "roic", "ebitda_margin", "fcf_margin", "effective_tax_rate",
)

# Metrics without meaning for an industry class.
NOT_APPLICABLE = {
    "bank": (
        "gross_margin", "current_ratio", "ebitda_margin", "ev_ebitda", "ev_to_revenue",
        "fcf_margin", "price_to_fcf", "free_cash_flow", "roic",
    ),
    "insurance": ("gross_margin", "current_ratio", "ebitda_margin", "ev_ebitda", "roic"),
    "reit": ("gross_margin", "current_ratio"),
    "utility": ("current_ratio",),
}

# Names of metrics in the camel-case vocabulary.
CAMEL = {
    "gross_margin": "grossMargin", "operating_margin": "operatingMargin", "net_margin": "netMargin",
    "ebitda_margin": "ebitdaMargin", "fcf_margin": "fcfMargin", "return_on_assets": "roa",
    "return_on_equity": "roe", "roe": "roe", "roic": "roic", "current_ratio": "currentRatio",
    "debt_to_equity": "debtToEquity", "debt_to_assets": "debtToAssets",
    "liabilities_to_equity": "liabilitiesToEquity", "ev_ebitda": "evEbitda",
    "ev_to_revenue": "evToRevenue", "price_to_fcf": "priceToFcf", "free_cash_flow": "freeCashFlow",
    "effective_tax_rate": "effectiveTaxRate",
}

RATIOS = (
    "gross_margin", "operating_margin", "net_margin", "return_on_assets", "return_on_equity", "roe",
    "roe_basis", "roic", "roic_basis", "effective_tax_rate", "current_ratio", "debt_to_equity",
    "debt_to_assets", "liabilities_to_equity", "ebitda_margin", "fcf_margin", "ocf_to_net_income",
)


class _Row:
    """Column access that yields NULL for metrics a frame does not have."""

    def __init__(self, df: DataFrame):
        self._have = set(df.columns)

    def __call__(self, name: str) -> Column:
        return F.col(name) if name in self._have else F.lit(None).cast("double")


def equity_of(m: _Row) -> Column:
    """Parent equity; zero counts as missing and total equity steps in."""
    return F.coalesce(truthy(m("stockholders_equity")), m("total_equity"))


def debt_of(m: _Row) -> Column:
    long, short = m("long_term_debt"), m("short_term_debt")
    legs = F.when(long.isNotNull() | short.isNotNull(), or_zero(long) + or_zero(short))
    return F.coalesce(m("total_debt"), legs)


def effective_tax_rate(tax: Column, pretax: Column) -> Column:
    rate = safe_div(tax, pretax)
    return F.when((pretax > 0) & (tax >= 0) & (rate <= 0.50), rate)


def roic(m: _Row) -> tuple[Column, Column]:
    """Return on invested capital and the basis of its profit figure."""
    equity, debt = equity_of(m), debt_of(m)
    capital = debt + equity - or_zero(m("cash_and_equivalents"))
    rate = effective_tax_rate(m("income_tax_expense"), m("income_before_tax"))
    used = F.coalesce(rate, F.lit(STATUTORY_TAX))
    oi = m("operating_income")
    ebit = m("income_before_tax") + F.abs(m("interest_expense"))
    profit = F.coalesce(oi, ebit) * (1 - used)
    value = F.when(capital > 0, safe_div(profit, capital))
    basis = (
        F.when(oi.isNotNull() & rate.isNotNull(), "oi_effective_tax")
        .when(oi.isNotNull(), "oi_statutory_tax")
        .otherwise("ebit_proxy")
    )
    return value, F.when(value.isNotNull(), basis)


def with_ratios(df: DataFrame, prior_equity: str | None = None, prior_assets: str | None = None) -> DataFrame:
    """Add every ratio; returns use average balances when priors are known."""
    m = _Row(df)
    equity, assets, ni, rev = equity_of(m), m("total_assets"), m("net_income"), m("revenue")
    p_eq = m(prior_equity) if prior_equity else F.lit(None).cast("double")
    p_as = m(prior_assets) if prior_assets else F.lit(None).cast("double")
    averaged = positive(equity) & positive(p_eq)
    eq_base = F.when(averaged, (equity + p_eq) / 2).otherwise(equity)
    as_base = F.when(positive(assets) & positive(p_as), (assets + p_as) / 2).otherwise(assets)
    eq_ok = positive(equity)
    roe = F.when(eq_ok, safe_div(ni, eq_base))
    roic_value, roic_basis = roic(m)
    debt = debt_of(m)
    return df.withColumns({
        "gross_margin": safe_div(m("gross_profit"), rev),
        "operating_margin": safe_div(m("operating_income"), rev),
        "net_margin": safe_div(ni, rev),
        "return_on_assets": safe_div(ni, as_base),
        "return_on_equity": roe,
        "roe": roe,
        "roe_basis": F.when(roe.isNotNull(), F.when(averaged, "avg").otherwise("ending")),
        "roic": roic_value,
        "roic_basis": roic_basis,
        "effective_tax_rate": effective_tax_rate(m("income_tax_expense"), m("income_before_tax")),
        "current_ratio": safe_div(m("current_assets"), m("current_liabilities")),
        "debt_to_equity": F.when(eq_ok, safe_div(debt, equity)),
        "debt_to_assets": safe_div(debt, assets),
        "liabilities_to_equity": F.when(eq_ok, safe_div(m("total_liabilities"), equity)),
        "ebitda_margin": safe_div(m("ebitda"), rev),
        "fcf_margin": safe_div(m("free_cash_flow"), rev),
        "ocf_to_net_income": safe_div(m("operating_cash_flow"), ni),
    })


def to_percent(df: DataFrame) -> DataFrame:
    """Fractions to percent, for the percent-like ratios only."""
    return df.withColumns({k: F.col(k) * 100 for k in PERCENT_KEYS if k in df.columns})


def not_applicable(industry: Column, camel: bool = False) -> Column:
    """Sorted names of metrics that make no sense for the industry."""
    out = F.lit(None).cast("array<string>")
    for name, keys in NOT_APPLICABLE.items():
        words = sorted(CAMEL.get(k, k) if camel else k for k in keys)
        out = F.when(F.lower(industry) == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def with_valuation(
    df: DataFrame,
    price: str = "price",
    shares_override: str | None = None,
    market_cap_override: str | None = None,
) -> DataFrame:
    """Market value, enterprise value and multiples."""
    m = _Row(df)
    p = m(price)
    shares = m("shares_outstanding")
    if shares_override:
        shares = F.coalesce(truthy(m(shares_override)), shares)
    debt, cash = debt_of(m), m("cash_and_equivalents")
    net_debt = F.when(debt.isNotNull(), debt - or_zero(cash)).otherwise(-cash)
    basis = (
        F.when(debt.isNotNull() & cash.isNotNull(), "debt_and_cash")
        .when(debt.isNotNull(), "debt_only")
        .when(cash.isNotNull(), "cash_only")
    )
    cap = F.when((p != 0) & (shares != 0), p * shares)
    if market_cap_override:
        cap = F.coalesce(m(market_cap_override), cap)
    ev = cap + net_debt
    eps = F.coalesce(truthy(m("eps_diluted")), m("eps_basic"))
    ni = m("net_income")
    by_eps = F.when(positive(eps), safe_div(p, eps))
    by_cap = F.when(positive(ni), safe_div(cap, ni))
    apart = by_eps.isNull() | (safe_div(by_eps, by_cap) > 1.8) | (safe_div(by_cap, by_eps) > 1.8)
    switch = by_cap.isNotNull() & F.coalesce(apart, F.lit(False))

    def over(value: Column, base: Column) -> Column:
        return F.when(positive(base), safe_div(value, base))

    return df.withColumns({
        "shares": shares,
        "market_cap": cap,
        "total_debt": debt,
        "net_debt": net_debt,
        "net_debt_basis": basis,
        "enterprise_value": ev,
        "pe_ratio": F.when(switch, by_cap).otherwise(by_eps),
        "pe_basis": F.when(switch, "mcap_ni").when(by_eps.isNotNull(), "eps"),
        "ps_ratio": over(cap, m("revenue")),
        "pb_ratio": over(cap, equity_of(m)),
        "ev_ebitda": over(ev, m("ebitda")),
        "ev_to_revenue": over(ev, m("revenue")),
        "price_to_fcf": over(cap, m("free_cash_flow")),
    })


def bank_block(nii: Column, noninterest: Column, total: Column, assets: Column, prior_assets: Column) -> dict[str, Column]:
    """Net interest income over average assets and the fee share, in percent."""
    both = (assets != 0) & (prior_assets != 0)
    base = F.when(both, (assets + prior_assets) / 2).otherwise(assets)
    return {"nim_proxy": safe_div(nii, base) * 100, "fee_share": safe_div(noninterest, total) * 100}
