"""Raw provider documents as frames: JSON, XML and directories.

Each reader takes a frame with the raw text in one column, so the files can be
read by any Spark source, and returns rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ownership import transaction_type
from ledgerline.operators.text import containing

FACT = (
    "struct<val:double,value:double,start:string,end:string,filed:string,form:string,accn:string,fy:int,fp:string>"
)
FACT_DOCUMENT = f"struct<facts:map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>>"


def company_facts(docs: DataFrame, column: str = "json", key: str = "cik") -> DataFrame:
    """Nested fact documents to one row per fact."""
    d = docs.select(key, F.from_json(column, FACT_DOCUMENT).alias("d"))
    d = d.select(key, F.explode("d.facts").alias("taxonomy", "concepts"))
    d = d.select(key, "taxonomy", F.explode("concepts").alias("concept", "body"))
    d = d.select(key, "taxonomy", "concept", F.coalesce("body.label", "concept").alias("label"), F.explode("body.units").alias("units", "rows"))
    d = d.select(key, "taxonomy", "concept", "label", "units", F.explode("rows").alias("f"))
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return d.select(
        key, "concept", "label", F.coalesce("f.val", "f.value").alias("value"), day("f.start").alias("start_date"),
        day("f.end").alias("end_date"), day("f.filed").alias("filed"), "f.form", "f.accn", "f.fy", "f.fp", "units", "taxonomy",
    )


def nest_company_facts(facts: DataFrame) -> DataFrame:
    """The inverse of :func:`company_facts`: one document per company."""
    fact = F.struct(
        F.col("value").alias("val"), F.col("start_date").cast("string").alias("start"),
        F.col("end_date").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"),
        "form", "accn", "fy", "fp",
    )
    units = facts.groupBy("cik", "taxonomy", "concept", "units").agg(
        F.max("label").alias("label"), F.collect_list(fact).alias("rows"))
    tags = units.groupBy("cik", "taxonomy", "concept").agg(
        F.struct(F.max("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("units", "rows"))).alias("units")).alias("body"))
    taxes = tags.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("concept", "body"))).alias("concepts"))
    docs = taxes.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "concepts"))).alias("facts"))
    return docs.select("cik", F.to_json(F.struct("facts")).alias("json"))


def ticker_directory(docs: DataFrame, column: str = "json") -> DataFrame:
    """Field-named rows (``fields`` and ``data``) or keyed objects to companies."""
    table = F.from_json(column, "struct<fields:array<string>,data:array<array<string>>>")
    rows = docs.select(table.alias("t")).where("t.data IS NOT NULL").select("t.fields", F.explode("t.data").alias("row"))

    def field(name: str, fallback: int) -> Column:
        at = F.array_position("fields", name)
        index = F.when(at > 0, at).otherwise(F.lit(fallback + 1)).cast("int")
        return F.try_element_at("row", index)

    listed = rows.where(F.size("row") >= 3).select(
        field("cik", 0).try_cast("long").alias("cik"), field("name", 1).alias("name"),
        F.upper(field("ticker", 2)).alias("ticker"), F.coalesce(field("exchange", 3), F.lit("")).alias("exchange"),
    )
    keyed = docs.where(table["data"].isNull()).select(
        F.explode(F.map_values(F.from_json(column, "map<string,struct<cik_str:string,ticker:string,title:string>>"))).alias("e")
    ).select(
        F.col("e.cik_str").try_cast("long").alias("cik"), F.coalesce("e.title", F.lit("")).alias("name"),
        F.upper("e.ticker").alias("ticker"), F.lit("").alias("exchange"),
    )
    return listed.unionByName(keyed)


def columnar_filings(docs: DataFrame, key: str = "cik") -> DataFrame:
    """Parallel arrays to filings, newest page first, one row per accession.

    ``docs`` has the arrays ``accn, form, filed, description, report_date`` and
    ``page``, where page zero is the recent window. Short arrays are padded.
    """
    z = F.arrays_zip("accn", "form", "filed", "description", "report_date")
    rows = docs.select(key, "page", F.posexplode(z).alias("pos", "f")).select(key, "page", "pos", "f.*").where("accn IS NOT NULL")
    w = Window.partitionBy(key, "accn").orderBy("page", "pos")
    rows = rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    text = F.when(~F.lower("description").isin("nan", "none", ""), F.col("description"))
    return rows.select(
        key, "accn", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("filed", F.lit("")).alias("filed"),
        text.alias("description"), F.coalesce("report_date", F.lit("")).alias("report_date"),
    )


VALUE = "struct<value:string>"
TRADE = (
    "struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    "transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>,"
    "postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>>"
)
FORM4 = (
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:"
    "struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<{TRADE}>>, "
    f"derivativeTable struct<derivativeTransaction:array<{TRADE}>>"
)


def insider_forms(docs: DataFrame, column: str = "xml", carry: Sequence[str] = ("cik", "accn", "filed")) -> DataFrame:
    """Insider forms in XML to transactions of both tables."""
    d = docs.select(*carry, F.from_xml(F.col(column), FORM4).alias("x"))
    owner = F.try_element_at("x.reportingOwner", F.lit(1))
    rel = owner["reportingOwnerRelationship"]
    flag = lambda c: F.lower(F.trim(c)).isin("1", "true")
    given = F.trim(F.coalesce(rel["officerTitle"], F.lit("")))
    title = (
        F.when(given != "", given).when(flag(rel["isDirector"]), "Director")
        .when(flag(rel["isOfficer"]), "Officer").when(flag(rel["isTenPercentOwner"]), "10% Owner").otherwise("")
    )
    name = F.trim(F.coalesce(owner["reportingOwnerId"]["rptOwnerName"], F.lit("")))

    def tagged(path: str, table: str) -> Column:
        rows = F.coalesce(F.col(path), F.array().cast(f"array<{TRADE}>"))
        return F.transform(rows, lambda t: F.struct(t.alias("t"), F.lit(table).alias("table")))

    # Both tables in one pass, so that each document is parsed once.
    every = F.concat(
        tagged("x.nonDerivativeTable.nonDerivativeTransaction", "non_derivative"),
        tagged("x.derivativeTable.derivativeTransaction", "derivative"),
    )
    t = d.select(*carry, name.alias("insider"), title.alias("title"), F.explode(every).alias("e"))
    t = t.select(*carry, "insider", "title", "e.t", "e.table")

    def number(c: str) -> Column:
        return F.regexp_replace(F.trim(F.col(c)), ",", "").try_cast("double")

    shares = number("t.transactionAmounts.transactionShares.value")
    price = number("t.transactionAmounts.transactionPricePerShare.value")
    after = number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value")
    day = F.try_to_date(F.trim("t.transactionDate.value"), "yyyy-MM-dd")
    total = (shares.cast("decimal(18,4)") * price.cast("decimal(18,4)")).cast("decimal(28,2)").cast("double")
    return t.select(
        *carry, "insider", "title", F.coalesce(day, F.col("filed")).alias("txn_date"),
        transaction_type(F.trim(F.coalesce("t.transactionCoding.transactionCode", F.lit("")))).alias("transaction_type"),
        F.coalesce(shares, F.lit(0.0)).alias("shares"), price.alias("price"), total.alias("total_value"),
        F.when(F.col("table") == "non_derivative", after).alias("shares_after"), "table",
    )


HOLDINGS = "infoTable array<struct<nameOfIssuer:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string>>>"


def holding_reports(docs: DataFrame, issuers: DataFrame, column: str = "xml", carry: Sequence[str] = ("filer",)) -> DataFrame:
    """Positions per filer and issuer key; values are in thousands.

    ``issuers`` is (issuer_key), upper case; a row belongs to every key its
    issuer name contains.
    """
    rows = docs.select(*carry, F.from_xml(F.col(column), HOLDINGS).alias("x")).select(*carry, F.explode("x.infoTable").alias("r"))
    rows = rows.select(
        *carry, F.upper(F.trim("r.nameOfIssuer")).alias("issuer"),
        F.regexp_replace("r.shrsOrPrnAmt.sshPrnamt", ",", "").try_cast("long").alias("shares"),
        F.regexp_replace("r.value", ",", "").try_cast("double").alias("value"),
    )
    # Issuer names repeat across reports: match the names once, then join.
    names = rows.select("issuer").distinct()
    match = containing(names, "issuer", issuers, "issuer_key")
    return rows.join(match, "issuer").groupBy(*carry, "issuer_key").agg(
        F.coalesce(F.sum("shares"), F.lit(0)).alias("shares"),
        F.coalesce(F.sum(F.col("value").cast("decimal(28,4)")).cast("double"), F.lit(0.0)).alias("thousands"),
    ).withColumn("value", F.col("thousands") * 1000).drop("thousands")


def price_bars(docs: DataFrame, column: str = "json") -> DataFrame:
    """Bars of one symbol (``symbol``, ``results`` of t, o, h, l, c, v); rows without time or close drop out."""
    schema = "struct<results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>>"
    r = docs.select("symbol", F.explode(F.from_json(column, schema)["results"]).alias("b")).where("b.t IS NOT NULL AND b.c IS NOT NULL")
    return r.select(
        "symbol", F.to_date(F.timestamp_millis("b.t")).alias("day"), F.col("b.o").alias("open"), F.col("b.h").alias("high"),
        F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").cast("long").alias("volume"),
    )


def grouped_bars(docs: DataFrame, column: str = "json") -> DataFrame:
    """One day's bars of the whole market, keyed by ``T``."""
    schema = "struct<results:array<struct<T:string,o:double,h:double,l:double,c:double,v:double>>>"
    r = docs.select("day", F.explode(F.from_json(column, schema)["results"]).alias("b")).where("b.T IS NOT NULL")
    return r.select(
        F.upper("b.T").alias("symbol"), "day", F.col("b.o").alias("open"), F.col("b.h").alias("high"),
        F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").cast("long").alias("volume"),
    )


def news_articles(docs: DataFrame, column: str = "json") -> DataFrame:
    """Articles with the sentiment given for the row's own symbol."""
    schema = (
        "struct<title:string,publisher:struct<name:string>,published_utc:string,article_url:string,"
        "tickers:array<string>,insights:array<struct<ticker:string,sentiment:string>>>"
    )
    d = docs.select("symbol", F.from_json(column, schema).alias("a"))
    mine = F.try_element_at(F.filter("a.insights", lambda i: F.upper(i["ticker"]) == F.upper("symbol")), F.lit(1))
    return d.select(
        "symbol", "a.title", F.col("a.publisher.name").alias("publisher"), F.col("a.published_utc").try_cast("timestamp").alias("published"),
        F.col("a.article_url").alias("url"), F.size("a.tickers").alias("n_tickers"), mine["sentiment"].alias("sentiment"),
    )


def segment_history(docs: DataFrame, column: str = "json") -> DataFrame:
    """Vendor segment documents (date, data by name) to positive members."""
    d = docs.select("symbol", F.from_json(column, "struct<date:string,fiscalYear:int,period:string,data:map<string,double>>").alias("s"))
    rows = d.select("symbol", F.col("s.date").try_cast("date").alias("end_date"), F.col("s.fiscalYear").alias("fy"),
                    F.coalesce("s.period", F.lit("FY")).alias("period"), F.explode("s.data").alias("label", "value"))
    return rows.where("value > 0")


def dividends(docs: DataFrame, column: str = "json") -> DataFrame:
    schema = "struct<cash_amount:double,currency:string,ex_dividend_date:string,pay_date:string,frequency:int>"
    d = docs.select("symbol", F.from_json(column, schema).alias("d"))
    return d.select("symbol", "d.cash_amount", "d.currency", F.col("d.ex_dividend_date").try_cast("date").alias("ex_date"),
                    F.col("d.pay_date").try_cast("date").alias("pay_date"), "d.frequency")


def splits(docs: DataFrame, column: str = "json") -> DataFrame:
    d = docs.select("symbol", F.from_json(column, "struct<execution_date:string,split_from:double,split_to:double>").alias("s"))
    return d.select("symbol", F.col("s.execution_date").try_cast("date").alias("executed"), "s.split_from", "s.split_to")
