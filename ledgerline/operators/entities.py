"""Companies: lookup, search, enrichment, peers and funds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.labels import dot_class, pad_cik, strip_class
from ledgerline.functions.numeric import safe_div, truthy
from ledgerline.operators.ranking import neighbours, rank_within, top_per_group
from ledgerline.operators.text import chief_executive


def resolve_entity(requests: DataFrame, company: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Requests (``query``) to padded company numbers.

    Order: number, override, exact ticker, ticker without share class, then a
    ticker that extends the request by at most two characters.
    """
    q = F.upper(F.trim("query"))
    bare = F.regexp_replace(q, "^CIK0*(?=.)", "")
    r = requests.select("query").distinct().withColumn("__q", bare)
    number = F.when(F.col("__q").rlike("^[0-9]+$"), F.lpad("__q", 10, "0"))
    r = r.withColumn("__number", number).withColumn("__base", strip_class("__q"))

    tickers = company.select(F.upper("ticker").alias("__t"), pad_cik("cik").alias("__c"))
    one = tickers.groupBy("__t").agg(F.min("__c").alias("__c"))
    exact = one.select(F.col("__t").alias("__q"), F.col("__c").alias("__exact"))
    classed = one.select(F.col("__t").alias("__base"), F.col("__c").alias("__classed"))
    # Every ticker under each of its prefixes that are one or two shorter.
    size = F.length("__t")
    stems = one.withColumn(
        "__cut", F.explode(F.filter(F.array(size - 1, size - 2), lambda n: n >= 1))
    )
    stems = stems.select(F.expr("left(__t, __cut)").alias("__q"), "__t", "__c")
    longer = stems.groupBy("__q").agg(F.min_by("__c", "__t").alias("__longer"))
    out = r.join(exact, "__q", "left").join(longer, "__q", "left")
    out = out.join(classed, "__base", "left")
    if overrides is not None:
        fixed = overrides.select(F.upper("ticker").alias("__q"), pad_cik("cik").alias("__fixed"))
        out = out.join(fixed, "__q", "left")
    else:
        out = out.withColumn("__fixed", F.lit(None).cast("string"))
    stripped = F.when(F.col("__base") != F.col("__q"), F.col("__classed"))
    return out.select(
        "query", F.coalesce("__number", "__fixed", "__exact", stripped, "__longer").alias("cik"),
        F.when(F.col("__number").isNotNull(), "number").when(F.col("__fixed").isNotNull(), "override")
        .when(F.col("__exact").isNotNull(), "ticker").when(stripped.isNotNull(), "share_class")
        .when(F.col("__longer").isNotNull(), "prefix").alias("matched"),
    )


def resolve_alias(texts: DataFrame, aliases: DataFrame, key: str, text: str, max_words: int | None = None) -> DataFrame:
    """The ticker of the longest alias found at word boundaries in each text.

    The text's runs of up to ``max_words`` words, by default those of the
    longest alias, meet the aliases in an equi-join. The whole text as an alias
    wins. ``aliases`` is (alias, ticker) with lower-case aliases. Both sides are
    shuffled: by its files' size Spark would take the runs, many times larger
    than their texts, for small enough to broadcast.
    """
    if max_words is None:
        longest = F.max(F.size(F.array_remove(F.split("alias", "[^\\p{L}\\p{N}_]+"), "")))
        max_words = aliases.agg(longest).first()[0] or 1
    low = F.lower(F.trim(F.col(text)))
    words = F.array_remove(F.split(low, "[^\\p{L}\\p{N}_]+"), "")
    n = F.size("__w")
    t = texts.select(key, low.alias("__low"), words.alias("__w"))

    def run_of(k: int):
        return lambda i: F.array_join(F.slice("__w", i, k), " ")

    runs = [F.col("__w")]
    for k in range(2, max_words + 1):
        runs.append(
            F.when(
                n >= k,
                F.transform(F.sequence(F.lit(1), n - (k - 1)), run_of(k)),
            ).otherwise(F.array().cast("array<string>"))
        )
    grams = F.array_distinct(F.concat(F.array("__low"), *runs))
    probe = t.select(key, "__low", F.explode(grams).alias("alias"))
    probe = probe.select(key, (F.col("alias") == F.col("__low")).alias("__whole"), "alias")
    probe = probe.where(F.col("__whole") | (F.length("alias") >= 3))
    hit = probe.join(aliases.select("alias", "ticker").hint("merge"), "alias")
    order = F.struct("__whole", F.length("alias"), F.col("alias"))
    return hit.groupBy(key).agg(F.max_by("ticker", order).alias("ticker"), F.max_by("alias", order).alias("alias"))


def search_score(query: str) -> Column:
    """Exact ticker, ticker prefix, word prefix of the name, substring."""
    q = query.strip().upper()
    if not q:
        return F.lit(1.0)
    ticker, name = F.upper("ticker"), F.upper("name")
    word = F.exists(F.split(name, "\\s+"), lambda w: w.startswith(q))
    return (
        F.when(ticker == q, 100.0)
        .when(ticker.startswith(q), F.lit(60.0) - F.length(ticker))
        .when(word, 40.0)
        .when(name.contains(q), 20.0)
    )


def search_companies(company: DataFrame, query: str = "", limit: int | None = None, **filters) -> DataFrame:
    """Ranked search with optional exact and range filters."""
    allowed = {"sector", "industry", "country", "exchange", "market_cap_min", "market_cap_max", "first_filed_after"}
    unknown = set(filters) - allowed
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    df = company.withColumn("score", search_score(query)).where("score IS NOT NULL")
    for name in ("exchange",):
        if name in filters:
            df = df.where(F.lower(name) == str(filters[name]).lower())
    if "sector" in filters:
        df = df.where(F.col("sector") == filters["sector"])
    for name in ("industry", "country"):
        if name in filters:
            df = df.where(F.lower(name).contains(str(filters[name]).lower()))
    if "market_cap_min" in filters:
        df = df.where(F.col("market_cap") >= filters["market_cap_min"])
    if "market_cap_max" in filters:
        df = df.where(F.col("market_cap") <= filters["market_cap_max"])
    if "first_filed_after" in filters:
        df = df.where(F.col("first_filed") > F.lit(filters["first_filed_after"]).cast("date"))
    df = df.orderBy(F.col("score").desc(), "ticker")
    return df if limit is None else df.limit(limit)


def tiered_search(company: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Exact ticker, then ticker prefix, then containment; one row per company."""
    q = query.strip().upper()
    ticker, name = F.upper("ticker"), F.upper("name")
    tier = (
        F.when(ticker == q, 0).when(ticker.startswith(q), 1)
        .when(name.contains(q) | ticker.contains(q), 2)
    )
    df = company.withColumn("tier", tier).where("tier IS NOT NULL")
    first = top_per_group(df, ["cik"], [F.col("tier"), F.col("ticker")], 1).drop("rn")
    first = first.orderBy("tier", "ticker")
    return first if limit is None else first.limit(limit)


def enrich_profile(
    company: DataFrame, filings: DataFrame | None = None, prices: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Add first-filed date (a listing proxy), price, market value and the chief executive.

    ``texts`` is (cik, form, filed, accn, text); the executive is read from the
    newest annual report of each company, whose name and day are the source.
    """
    out = company
    if filings is not None:
        out = out.join(filings.groupBy("cik").agg(F.min("filed").alias("first_filed")), "cik", "left")
    if prices is not None:
        out = out.join(prices.select("cik", "price"), "cik", "left")
        out = out.withColumn("market_cap", F.col("price") * F.col("shares"))
    if texts is not None:
        # The name is read before the newest report is picked, so that no text is shuffled.
        named = texts.where("form = '10-K'").select("cik", "filed", "accn", chief_executive("text").alias("ceo"))
        newest = named.groupBy("cik").agg(F.max_by(F.struct("ceo", "filed"), F.struct("filed", "accn")).alias("n"))
        source = F.when(F.col("n.ceo").isNotNull(), F.concat(F.lit("10-K filed "), F.col("n.filed").cast("string")))
        out = out.join(newest.select("cik", "n.ceo", source.alias("ceo_source")), "cik", "left")
    return out


def fill_quote(quotes: DataFrame, context: DataFrame, columns: Sequence[str], key: str = "cik") -> DataFrame:
    """Fill the gaps of a quote from slower context data."""
    right = context.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = quotes.join(right, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(
        *[f"__{c}" for c in columns]
    )


def index_members(company: DataFrame, members: DataFrame) -> DataFrame:
    """Companies whose ticker, with a dot for the share class, is in the index."""
    want = members.select(F.upper("ticker").alias("__m"))
    return company.withColumn("__m", dot_class("ticker")).join(want, "__m", "left_semi").drop("__m")


def first_wins(df: DataFrame, keys: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """The earliest row of each key, in the given order."""
    return top_per_group(df, keys, position, 1).drop("rn")


def universe(curated: DataFrame, ranked: DataFrame, n: int, order: Sequence[Column], key: str = "cik") -> DataFrame:
    """The curated rows plus the top n of the others."""
    rest = ranked.join(curated.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)
    return curated.withColumn("origin", F.lit("curated")).unionByName(
        rest.select(*curated.columns).withColumn("origin", F.lit("ranked"))
    )


def work_list(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], max_age_days: int | None = None, as_of=None) -> DataFrame:
    """What is not stored yet, or stored longer ago than ``max_age_days``."""
    fresh = stored
    if max_age_days is not None:
        fresh = stored.where(F.datediff(F.lit(as_of).cast("date"), "stored_on") <= max_age_days)
    return wanted.join(fresh.select(*keys).distinct(), list(keys), "left_anti")


def group_key(name: Column) -> Column:
    """An industry name as the key of a peer group: lower case, words joined by underscores."""
    return F.translate(F.lower(F.trim(name)), " -", "__")


def token_heads(members: DataFrame, n: int) -> DataFrame:
    """(token, peer, place): per word of a group's key its first ``n`` members over all groups that hold the word.

    An inverted index that never grows with a word's use: whatever else holds
    the word comes later in every list that the word can lead to. Members are
    counted once, at their first place; losers are dropped before the shuffle.
    """
    words = members.select(F.explode(F.array_distinct(F.split("key", "_"))).alias("token"), "peer", "place").where("token <> ''")
    firsts = words.groupBy("token", "peer").agg(F.min("place").alias("place"))
    return top_per_group(firsts, ["token"], [F.col("place"), F.col("peer")], n).drop("rn")


def overlapping(names: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """(key, peer, place): per key of ``names`` the first ``n`` members of the groups that share a word with it.

    A member's place is its first in any of these groups, i.e. the first over
    the words' own lists; so the lists' first ``n`` members suffice.
    """
    words = names.select("key", F.explode(F.array_distinct(F.split("key", "_"))).alias("token")).where("token <> ''")
    found = words.join(heads, "token").groupBy("key", "peer").agg(F.min("place").alias("place"))
    return top_per_group(found, ["key"], [F.col("place"), F.col("peer")], n).drop("rn")


def find_peers(
    targets: DataFrame,
    company: DataFrame,
    *,
    curated: DataFrame | None = None,
    custom: DataFrame | None = None,
    universe: DataFrame | None = None,
    group: str = "industry",
    max_peers: int = 5,
    min_relevance: float = 0.0,
) -> DataFrame:
    """Peers per target: a custom list alone, else curated ones, else the industry group.

    ``curated`` and ``custom`` are (ticker, peer, position), ``universe`` is
    (key, peer, place) with places counted over all groups; without one, the
    groups are those of ``company``. A target whose industry has no group takes
    the groups whose key shares a word with its own. At most twice the limit
    of group members come in, in order of place. Several targets of one industry share one short
    list, so neither a large industry nor a frequent word is paired with
    itself. Targets that no step serves give no rows.
    """
    t = targets.select("ticker").distinct()

    def listed(df: DataFrame | None, score: float, reason: str) -> DataFrame | None:
        if df is None:
            return None
        return t.join(df, "ticker").select(
            "ticker", "peer", "position", F.lit(score).alias("relevance"), F.lit(reason).alias("reason")
        )

    chosen = listed(custom, 1.0, "custom")
    known = listed(curated, 0.95, "curated")
    if known is not None and chosen is not None:
        known = known.join(chosen.select("ticker").distinct(), "ticker", "left_anti")
    explicit = [d for d in (chosen, known) if d is not None]
    out = None
    for d in explicit:
        out = d if out is None else out.unionByName(d)
    left = t if out is None else t.join(out.select("ticker").distinct(), "ticker", "left_anti")

    industry = company.select("ticker", group_key(F.col(group)).alias("key")).where("key <> ''")
    # One more than the limit, in case the target is among them.
    limit = 2 * max_peers + 1
    if universe is None:
        members = industry.select("key", F.col("ticker").alias("peer"), F.struct("key", "ticker").alias("place"))
    else:
        members = universe.select("key", "peer", F.struct("place", "peer").alias("place"))
    head = members.groupBy("key", "peer").agg(F.min("place").alias("place"))
    head = top_per_group(head, ["key"], [F.col("place"), F.col("peer")], limit).drop("rn").withColumn("reason", F.lit("same group"))
    wanted = left.join(industry, "ticker")
    bare = wanted.select("key").distinct().join(members.select("key").distinct(), "key", "left_anti")
    near = overlapping(bare, token_heads(members, limit), limit).withColumn("reason", F.lit("shared word"))
    own = wanted.join(head.unionByName(near), "key").where("ticker <> peer")
    own = top_per_group(own, ["ticker"], [F.col("place"), F.col("peer")], 2 * max_peers, "position")
    own = own.select("ticker", "peer", "position", F.lit(0.70).alias("relevance"), "reason")
    out = own if out is None else out.unionByName(own)
    out = out.where(F.col("relevance") >= min_relevance)
    best = top_per_group(out, ["ticker"], [F.col("relevance").desc(), F.col("position"), F.col("peer")], max_peers, "n")
    return best.select("ticker", "peer", "relevance", "reason", "n")


def find_comps(companies: DataFrame, max_comps: int = 5, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Nearest companies by size in the same sector, for every company.

    ``companies`` is (sector, ticker, revenue). The nearest by ratio are next
    to the target in revenue order, so each target meets a few neighbours on
    either side. Peers of unknown size come at distance 1000; fewer than three
    in the size band widens it to the sector; a target of unknown size takes
    its neighbours by name.
    """
    base = companies.where("sector IS NOT NULL").select("sector", "ticker", "revenue")
    sized = rank_within(base.where("revenue > 0"), ["sector"], [F.col("revenue"), F.col("ticker")])
    pairs = neighbours(sized, ["sector"], max_comps, max_comps, {"ticker": "peer", "revenue": "peer_revenue"})
    ratio = F.greatest(F.col("peer_revenue") / F.col("revenue"), F.col("revenue") / F.col("peer_revenue"))
    band = F.col("peer_revenue").between(F.col("revenue") * low, F.col("revenue") * high)
    pairs = pairs.select("sector", "ticker", "peer", ratio.alias("distance"), band.alias("scored"))
    unsized = base.where("revenue IS NULL")
    head = top_per_group(unsized, ["sector"], [F.col("ticker")], max_comps)
    vague = sized.select("sector", "ticker").join(head.select("sector", F.col("ticker").alias("peer")), "sector")
    vague = vague.withColumns({"distance": F.lit(1000.0), "scored": F.lit(True)})
    pool = pairs.unionByName(vague.select(*pairs.columns))
    count = pool.groupBy("ticker").agg(F.count_if("scored").alias("__n"))
    pool = pool.join(count, "ticker").where(F.col("scored") | (F.col("__n") < 3)).drop("__n")

    # Targets without a size: two names before, three after.
    named = rank_within(base, ["sector"], [F.col("ticker")])
    lost = named.where("revenue IS NULL OR revenue <= 0")
    near = lost.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2, 3)])))
    near = near.withColumn("__at", F.col("rank") + F.col("offset"))
    other = named.select("sector", F.col("rank").alias("__at"), F.col("ticker").alias("peer"))
    near = near.join(other, ["sector", "__at"]).select(
        "sector", "ticker", "peer", F.col("offset").cast("double").alias("distance"), F.lit(True).alias("scored")
    )
    out = pool.unionByName(near)
    best = top_per_group(out, ["ticker"], [F.col("distance"), F.col("peer")], max_comps, "n")
    return best.select("sector", "ticker", "peer", "distance", "n")


# Fallback fund peers by asset class.
FUND_PEERS = {
    "Equity": ("VOO", "IVV", "VTI", "QQQ", "DIA"),
    "Fixed Income": ("BND", "AGG", "TLT", "LQD", "HYG"),
    "Commodity": ("GLD", "SLV"),
}

# Security types that are funds.
FUND_TYPES = ("ETF", "ETN", "ETV", "ETS", "FUND", "UNIT")


def fund_profiles(details: DataFrame, seeds: DataFrame, prices: DataFrame) -> DataFrame:
    """Merge provider details with curated seeds; only funds are returned.

    ``details`` has (ticker, type, name, market_cap, shares, list_date) and
    ``seeds`` (ticker, seed_name, asset_class, inception_date).
    """
    d = details.withColumn("__has", F.lit(True))
    s = seeds.withColumn("__seed", F.lit(True))
    out = d.join(s, "ticker", "full_outer").join(prices.select("ticker", "price"), "ticker", "left")
    seeded, known = F.col("__seed").isNotNull(), F.col("__has").isNotNull()
    out = out.where(seeded | F.upper("type").isin(*FUND_TYPES))
    by_shares = truthy("shares") * truthy("price")
    aum = F.coalesce("market_cap", by_shares)
    source = F.when(truthy("market_cap").isNotNull(), "market_cap").when(
        F.col("market_cap").isNull() & by_shares.isNotNull(), "shares_x_price"
    )
    asset = F.coalesce("asset_class", F.lit("Equity"))
    peers = F.lit(None).cast("array<string>")
    for name, pool in FUND_PEERS.items():
        peers = F.when(asset == name, F.array(*[F.lit(p) for p in pool])).otherwise(peers)
    equity = F.array(*[F.lit(p) for p in FUND_PEERS["Equity"]])
    peers = F.filter(F.coalesce(peers, equity), lambda p: p != F.col("ticker"))
    return out.select(
        "ticker", F.coalesce("name", "seed_name", "ticker").alias("name"), aum.alias("aum"),
        source.alias("aum_source"), asset.alias("asset_class"),
        F.coalesce("inception_date", "list_date").alias("inception_date"), peers.alias("peers"),
        F.when(seeded & known, "seed+provider").when(seeded, "seed").otherwise("provider").alias("profile_source"),
    )


def coverage(df: DataFrame, total: int | Column, key: str = "cik", approximate: bool = False) -> DataFrame:
    """Distinct keys and their share of a known total, in percent."""
    count = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    return df.agg(count.alias("covered")).withColumn(
        "coverage_pct", safe_div(F.col("covered"), total if isinstance(total, Column) else F.lit(total)) * 100
    )
