"""Peers by list, by group and by shared words, against plain versions."""

import random

from ledgerline.operators import entities as en


def plain_peers(targets, industry, curated, custom, universe, most, least):
    out = {}
    for t in targets:
        listed = custom.get(t) or curated.get(t)
        if listed:
            found = [(p, 1.0 if t in custom else 0.95, "custom" if t in custom else "curated") for p in listed]
        else:
            key = (industry.get(t) or "").strip().lower().replace(" ", "_").replace("-", "_")
            if not key:
                continue
            groups, why = [k for k in universe if k == key], "same group"
            if not groups:
                words = set(key.split("_")) - {""}
                groups, why = [k for k in universe if words & set(k.split("_"))], "shared word"
            members = list(dict.fromkeys(p for k in groups for p in universe[k] if p != t))
            found = [(p, 0.70, why) for p in members[: 2 * most]]
        found = [f for f in found if f[1] >= least][:most]
        if found:
            out[t] = found
    return out


def run(spark, targets, industry, curated, custom, universe, most, least):
    pairs = lambda lists: spark.createDataFrame([(t, p, k) for t, ps in lists.items() for k, p in enumerate(ps)], "ticker string, peer string, position int")
    place, rows = 0, []
    for key, members in universe.items():
        for p in members:
            rows.append((key, p, place))
            place += 1
    df = en.find_peers(
        spark.createDataFrame([(t,) for t in targets], "ticker string"), spark.createDataFrame(list(industry.items()), "ticker string, industry string"),
        curated=pairs(curated), custom=pairs(custom), universe=spark.createDataFrame(rows, "key string, peer string, place int"), max_peers=most, min_relevance=least)
    out = {}
    for r in df.orderBy("ticker", "n").collect():
        out.setdefault(r.ticker, []).append((r.peer, r.relevance, r.reason))
    return out


def test_all_steps_against_plain(spark):
    rnd = random.Random(3)
    words = ["auto", "parts", "health", "care", "services", "oil", "gas", "retail", "home", "power"]
    tickers = [f"T{k:03d}" for k in range(160)]
    universe = {}
    for _ in range(25):
        universe["_".join(rnd.sample(words, rnd.choice([1, 2, 3])))] = rnd.sample(tickers, rnd.randrange(1, 9))
    # A word that most groups share, in a group of most tickers.
    universe["services_everything"] = rnd.sample(tickers, 120)
    industry = {t: rnd.choice([" ".join(rnd.sample(words, 2)).title(), rnd.choice(list(universe)).replace("_", "-"), "Services", "Nothing Alike", "", None]) for t in tickers}
    curated = {t: rnd.sample(tickers, 6) for t in tickers[:30]}
    custom = {t: rnd.sample(tickers, 2) for t in tickers[20:40]}
    for most, least in ((5, 0.0), (2, 0.0), (5, 0.7), (5, 0.8), (5, 0.97)):
        args = (tickers, industry, curated, custom, universe, most, least)
        assert run(spark, *args) == plain_peers(*args)


def test_own_groups_where_no_universe_is_given(spark):
    company = spark.createDataFrame([("A", "Oil"), ("B", "oil"), ("C", "Oil Gas"), ("D", None)], "ticker string, industry string")
    got = {(r.ticker, r.peer, r.reason) for r in en.find_peers(company, company).collect()}
    assert got == {("A", "B", "same group"), ("B", "A", "same group")}
    assert en.find_peers(company.limit(0), company).count() == 0
