"""The facts layer: filters, period selection and latest-filed dedupe.

A facts frame has one row per company, concept, unit, period and filing:
``cik, concept, label, value, start_date, end_date, filed, form, accn, fy, fp,
units, taxonomy`` and, where the source has them, ``dimension``, ``abstract``
and ``level``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import duration_class, duration_days, fits_fiscal_period

FACT_KEY = ("cik", "concept", "taxonomy", "units", "start_date", "end_date")

# Currency codes that count as reporting currencies.
CURRENCIES = (
    "USD", "EUR", "GBP", "JPY", "CNY", "CHF", "CAD", "AUD", "KRW", "HKD", "SGD", "TWD", "INR", "BRL", "MXN", "ZAR",
    "SEK", "NOK", "DKK", "ILS", "NZD", "THB", "PHP", "MYR", "IDR", "RUB", "TRY", "PLN", "CZK", "HUF", "CLP", "COP",
    "PEN", "ARS", "SAR", "AED", "QAR", "KWD", "BHD", "OMR", "EGP", "NGN", "KES",
)

MAX_LEVEL = 2


def _newest_first(*cols: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def keep_or_all(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Rows that pass, or every row of a group in which none passes.

    The group's verdict is a tiny aggregate joined back, so a group that holds
    most of the rows is never gathered in one task.
    """
    flagged = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    verdict = flagged.groupBy(*keys).agg(F.max("__ok").alias("__any"))
    passing = flagged.join(verdict, list(keys)) if all(keys) else flagged
    return passing.where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any").select(*df.columns)


def is_quality_row(facts: DataFrame) -> Column:
    """False for dimensional, abstract, deeply nested and narrative rows."""
    ok = ~(
        F.col("concept").endswith("Axis")
        | F.col("concept").endswith("Member")
        | F.col("concept").contains("TextBlock")
    )
    if "dimension" in facts.columns:
        ok = ok & (F.trim(F.coalesce(F.col("dimension"), F.lit(""))) == "")
    if "abstract" in facts.columns:
        ok = ok & ~F.lower(F.coalesce(F.col("abstract").cast("string"), F.lit("false"))).isin("true", "1", "yes")
    if "level" in facts.columns:
        level = F.col("level").try_cast("double")
        ok = ok & (level.isNull() | (level <= MAX_LEVEL))
    return ok


def quality_filter(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Quality rows only; a company without any keeps all its rows."""
    return keep_or_all(facts, keys, is_quality_row(facts))


def form_filter(facts: DataFrame, forms: Sequence[str] | None = None, accession: str | None = None) -> DataFrame:
    """Plain predicates on form and accession; they reach the scan."""
    if forms:
        facts = facts.where(F.col("form").isin(*forms))
    if accession:
        facts = facts.where(F.col("accn") == accession)
    return facts


def unit_currency(units: Column | str = "units") -> Column:
    """The currency part of a unit, or NULL for shares, pure and the like."""
    u = F.col(units) if isinstance(units, str) else units
    part = F.split_part(F.replace(u, F.lit("iso4217:"), F.lit("")), F.lit("/"), F.lit(1))
    return F.when(part.rlike("^[A-Z]{3}$"), part)


def currency_filter(facts: DataFrame, currency: Column, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Money rows in ``currency`` and all rows without one; all rows if none fit."""
    part = unit_currency()
    return keep_or_all(facts, keys, part.isNull() | (part == currency))


def _currency_mode(rows: Column | None = None) -> Column:
    """Most frequent reporting currency of the rows, smallest code on ties."""
    bare = F.replace(F.col("units"), F.lit("iso4217:"), F.lit(""))
    every = rows if rows is not None else F.lit(True)
    plain = F.mode(F.when(every & F.col("units").isin(*CURRENCIES), F.col("units")), True)
    tagged = F.mode(F.when(every & bare.isin(*CURRENCIES), bare), True)
    return F.coalesce(plain, tagged, F.lit("USD"))


def detect_currency(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """The most frequent reporting currency per company; USD when there is none."""
    return facts.groupBy(*keys).agg(_currency_mode().alias("currency"))


def with_currency(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`detect_currency` as a column of the rows, which are read once: for keys with few rows each, such as filings."""
    bare = F.replace(F.col("units"), F.lit("iso4217:"), F.lit(""))
    plain = F.coalesce(F.col("units").isin(*CURRENCIES), F.lit(False))
    rows = facts.withColumns({"__tagged": ~plain, "__code": F.when(plain, F.col("units")).when(bare.isin(*CURRENCIES), bare)})
    n = F.count("*").over(Window.partitionBy(*keys, "__tagged", "__code"))
    rows = rows.withColumn("__vote", F.when(F.col("__code").isNotNull(), F.struct("__tagged", (-n).alias("n"), "__code")))
    most = F.min("__vote").over(Window.partitionBy(*keys))["__code"]
    return rows.withColumn("currency", F.coalesce(most, F.lit("USD"))).drop("__tagged", "__code", "__vote")


def clean_facts(facts: DataFrame) -> DataFrame:
    """Quality rows in the reporting currency, latest report of each.

    One small per-company profile decides both filters, so the facts are read
    twice and joined once. A detected currency always has rows, and companies
    reporting in dollars are left as they are.
    """
    ok = is_quality_row(facts)
    profile = facts.groupBy("cik").agg(
        F.max(ok).alias("__any"), _currency_mode(ok).alias("__good"), _currency_mode().alias("__all")
    ).select("cik", "__any", F.when(F.col("__any"), F.col("__good")).otherwise(F.col("__all")).alias("__ccy"))
    part = unit_currency()
    joined = facts.join(profile, "cik").where(ok | ~F.col("__any"))
    kept = joined.where((F.col("__ccy") == "USD") | part.isNull() | (part == F.col("__ccy")))
    return dedupe_facts(kept.select(*facts.columns))


def fiscal_period_filter(facts: DataFrame, fp: str, fy: Column | int | None = None, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Rows declared for ``fp`` whose duration fits it; instants pass; else all."""
    ok = F.upper("fp") == fp.upper()
    if fy is not None:
        ok = ok & (F.col("fy").try_cast("int") == fy)
    days = duration_days()
    ok = ok & (F.col("start_date").isNull() | days.isNull() | fits_fiscal_period(fp, days))
    return keep_or_all(facts, keys, ok)


def dedupe_facts(facts: DataFrame, key: Sequence[str] = FACT_KEY) -> DataFrame:
    """The latest filed report of each fact.

    ``row_number() = 1`` lets Spark drop losers before the shuffle, so a fact
    repeated in very many filings never travels whole.
    """
    order = _newest_first("filed", "accn", "value")
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return facts.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def with_period(facts: DataFrame) -> DataFrame:
    return facts.withColumn("ptype", duration_class()).withColumn("dur_days", duration_days())


def select_period(facts: DataFrame, ptype: str, end_date: str | None = None) -> DataFrame:
    """Facts of one duration class and, if given, one exact period end."""
    out = with_period(facts).where(F.col("ptype") == ptype)
    if end_date is not None:
        out = out.where(F.col("end_date") == F.to_date(F.lit(end_date)))
    return dedupe_facts(out).drop("ptype", "dur_days")


def taxonomy_fallback(facts: DataFrame, preferred: str = "us-gaap", enough: int = 10) -> DataFrame:
    """The preferred taxonomy alone where it is well filled, else all of them."""
    n = facts.groupBy("cik").agg(
        F.count(F.when(F.col("taxonomy") == preferred, 1)).alias("__preferred")
    )
    keep = (F.col("taxonomy") == preferred) | (F.col("__preferred") <= enough)
    return facts.join(n, "cik").where(keep).drop("__preferred").select(*facts.columns)


def taxonomy_rank(preferred: str = "us-gaap") -> Column:
    t = F.col("taxonomy")
    return F.when(t == preferred, 0).when(t == "ifrs-full", 1).when(t == "dei", 3).otherwise(2)


def concept_history(facts: DataFrame, concept: str) -> DataFrame:
    """Every value reported for one tag, newest period first."""
    cols = ["cik", "concept", "value", "start_date", "end_date", "filed", "form", "accn", "fy", "units"]
    return facts.where(F.col("concept") == concept).select(*cols)


# A series is one tag of one company. After the dedupe it holds one row per
# period, so windows over it stay small however many rows the company has.
SERIES = ("cik", "concept", "taxonomy", "units")


def _rank_by_length(keys: Sequence[str], longest: bool = True, among: Column | None = None) -> Column:
    """Flows of one series and end, by duration; instants have no rank to lose, rows outside ``among`` come last."""
    days = F.col("dur_days").desc_nulls_last() if longest else F.col("dur_days").asc_nulls_last()
    start = F.col("start_date").asc_nulls_last() if longest else F.col("start_date").desc_nulls_last()
    last = [] if among is None else [~among]
    w = Window.partitionBy(*keys, "end_date").orderBy(*last, F.col("ptype") == "instant", days, start)
    return F.row_number().over(w)


def _any(cond: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(F.max(cond).over(Window.partitionBy(*keys)), F.lit(False))


INSTANT = "ptype = 'instant'"


def annual_facts(facts: DataFrame, keys: Sequence[str] = SERIES, among: Column | None = None) -> DataFrame:
    """Full-year rows per series; the longest per end where a series has none.

    With ``among``, never NULL, the other rows neither count nor drop out.
    """
    is_fy = F.col("ptype") == "FY"
    mine = F.lit(True) if among is None else among
    df = with_period(facts).withColumns({"__has": _any(is_fy & mine, keys), "__rank": _rank_by_length(keys, among=among)})
    keep = ~mine | F.expr(INSTANT) | is_fy | (~F.col("__has") & (F.col("__rank") == 1))
    return df.where(keep).drop("__has", "__rank")


def ytd_facts(facts: DataFrame, keys: Sequence[str] = SERIES, longest: int = 295, among: Column | None = None) -> DataFrame:
    """The year-to-date row per series and end; full years only if nothing else.

    With ``among``, never NULL, the other rows neither count nor drop out.
    """
    short = F.col("dur_days") <= longest
    mine = F.lit(True) if among is None else among
    df = with_period(facts).withColumn("__has", _any(short & mine, keys))
    df = df.where(~mine | F.expr(INSTANT) | short | ~F.col("__has")).withColumn("__rank", _rank_by_length(keys, among=among))
    return df.where(~mine | F.expr(INSTANT) | (F.col("__rank") == 1)).drop("__has", "__rank")


def standalone_quarter_facts(facts: DataFrame, fy: int | None = None, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """At the newest period end, the longest duration of each concept."""
    df = with_period(facts)
    flow = ~F.expr(INSTANT)
    declared = flow & (F.col("fy").try_cast("int") == fy) if fy is not None else flow
    # Newest end among the rows of the wanted year, else among all flows.
    ends = df.groupBy(*keys).agg(
        F.max(F.when(declared, F.col("end_date"))).alias("__wanted"),
        F.max(F.when(flow, F.col("end_date"))).alias("__newest"),
    )
    df = df.join(ends, list(keys))
    declared = F.coalesce(declared, F.lit(False))
    usable = flow & (declared | F.col("__wanted").isNull())
    at_newest = usable & (F.col("end_date") == F.coalesce("__wanted", "__newest"))
    df = df.where(F.expr(INSTANT) | at_newest)
    df = df.withColumn("__rank", _rank_by_length((*keys, "concept")))
    return df.where(F.expr(INSTANT) | (F.col("__rank") == 1)).drop("__wanted", "__newest", "__rank")


def duration_fallback(facts: DataFrame, prefer: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Pick durations by length alone, for frames without fiscal labels."""
    df = with_period(facts)
    if prefer == "quarterly":
        short = F.col("dur_days") <= 115
        df = df.withColumns({"__has": _any(short, keys), "__rank": _rank_by_length(keys, longest=False)})
        keep = short | (~F.col("__has") & (F.col("__rank") == 1))
    else:
        long = F.col("dur_days") > 300
        df = df.withColumns({"__has": _any(long, keys), "__rank": F.lit(1)})
        keep = long | ~F.col("__has")
    return df.where(F.expr(INSTANT) | keep).drop("__has", "__rank")


def nth_period(facts: DataFrame, k: int, keys: Sequence[str] = ("cik", "concept")) -> DataFrame:
    """The k-th newest value of each series, counting from zero."""
    w = Window.partitionBy(*keys).orderBy(*_newest_first("end_date", "start_date", "filed"), F.col("units"))
    ranked = facts.withColumn("__rn", F.row_number().over(w))
    return ranked.where(F.col("__rn") <= k + 1).where(F.col("__rn") == k + 1).drop("__rn")


def filing_profile(facts: DataFrame, forms: Sequence[str] = ("10-K", "10-Q", "20-F", "6-K")) -> DataFrame:
    """One row per filing seen in the facts, in a single pass.

    The report date is the last period end that is bounded by the filing date
    and not a cover-page fact, as far as the company and form have such rows.
    """
    own = F.col("taxonomy") != "dei"
    bounded = F.col("end_date") <= F.col("filed")
    end = F.col("end_date")

    def latest(cond: Column, name: str) -> list[Column]:
        return [F.max(F.when(cond, end)).alias(name), F.min(F.when(cond, F.col("filed"))).alias(f"{name}_filed")]

    per = facts.where(F.col("form").isin(*forms)).groupBy("cik", "form", "accn").agg(
        *latest(own & bounded, "__ob"), *latest(own, "__o"), *latest(bounded, "__b"), *latest(F.lit(True), "__a"),
        F.mode("fp", True).alias("fp"), F.mode("fy", True).alias("fy"),
    )
    w = Window.partitionBy("cik", "form")
    any_own = F.max(F.col("__o").isNotNull()).over(w)
    any_own_bounded = F.max(F.col("__ob").isNotNull()).over(w)
    any_bounded = F.max(F.col("__b").isNotNull()).over(w)
    which = (
        F.when(any_own & any_own_bounded, F.struct(F.col("__ob").alias("r"), F.col("__ob_filed").alias("f")))
        .when(any_own, F.struct(F.col("__o").alias("r"), F.col("__o_filed").alias("f")))
        .when(any_bounded, F.struct(F.col("__b").alias("r"), F.col("__b_filed").alias("f")))
        .otherwise(F.struct(F.col("__a").alias("r"), F.col("__a_filed").alias("f")))
    )
    return per.withColumn("__pick", which).where("__pick.f IS NOT NULL OR __pick.r IS NOT NULL").select(
        "cik", "form", "accn", F.col("__pick.r").alias("report_date"), F.col("__pick.f").alias("filed"), "fp", "fy",
    )


def periodic_filing_index(facts: DataFrame, forms: Sequence[str] = ("10-K", "10-Q", "20-F", "6-K")) -> DataFrame:
    """Filings seen in the facts with report and filing date."""
    return filing_profile(facts, forms).drop("fp", "fy")


def dominant_period(facts: DataFrame) -> DataFrame:
    """Most frequent fp and fy per filing; ties go to the smallest."""
    return facts.groupBy("cik", "accn").agg(F.mode("fp", True).alias("fp"), F.mode("fy", True).alias("fy"))


def statement_lines(facts: DataFrame, concepts: Sequence[str], keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Newest and prior value of the listed tags, in list order, labels unique."""
    order = F.lit(None).cast("int")
    for i, c in enumerate(concepts):
        order = F.when(F.col("concept") == c, F.lit(i)).otherwise(order)
    rows = facts.where(F.col("concept").isin(*concepts)).withColumn("line_no", order)
    w = Window.partitionBy(*keys, "concept").orderBy(*_newest_first("end_date", "filed", "start_date"), F.col("units"))
    top = rows.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    lines = top.groupBy(*keys, "concept", "line_no").agg(
        F.max(F.when(F.col("__rn") == 1, F.col("label"))).alias("label"),
        F.max(F.when(F.col("__rn") == 1, F.col("value"))).alias("value"),
        F.max(F.when(F.col("__rn") == 2, F.col("value"))).alias("prior_value"),
        F.max(F.when(F.col("__rn") == 1, F.col("end_date"))).alias("end_date"),
    )
    first = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("line_no"))
    return lines.withColumn("__first", first).where("__first = 1").drop("__first")
