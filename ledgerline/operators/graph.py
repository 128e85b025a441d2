"""Statement trees: depth of concepts, children, role classes, resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir

# Parts of role addresses by statement, and roles left out.
ROLE_PATTERNS = {
    "income": (
        "STATEMENTSOFOPERATIONS|STATEMENTSOFINCOME|INCOMESTATEMENT|STATEMENTOFOPERATIONS|STATEMENTOFINCOME|"
        "RESULTSOFOPERATIONS|STATEMENTSOFEARNINGS|PROFITANDLOSS|PROFITORLOSS"
    ),
    "balance": "BALANCESHEET|STATEMENTSOFFINANCIALPOSITION|STATEMENTOFFINANCIALPOSITION|FINANCIALCONDITION",
    "cashflow": "CASHFLOW|STATEMENTSOFCASHFLOWS|STATEMENTOFCASHFLOWS",
}
ROLE_EXCLUDED = "COMPREHENSIVE|PARENTHETICAL|DETAILS|EQUITY"

# Names of revenue nodes and names that rule a node out.
REVENUE_NODE = "(?i)(Revenue|Revenues|NetSales|SalesNet|Turnover)"
REVENUE_NODE_EXCLUDED = (
    "(?i)(Cost|Deferred|Unearned|Remaining|Expense|Receivable|Guidance|Contract(Asset|Liabilit)|TaxesPayable)"
)


def role_class(role: Column) -> Column:
    """income, balance, cashflow or NULL."""
    upper = F.upper(role)
    out = F.when(upper.rlike(ROLE_EXCLUDED), F.lit(None).cast("string"))
    for name, pattern in ROLE_PATTERNS.items():
        out = out.when(upper.rlike(pattern), F.lit(name))
    return out


def statement_roles(roles: DataFrame, keys: Sequence[str] = ("accn",)) -> DataFrame:
    """The first role of each statement per filing (``role``, ``position``)."""
    df = roles.withColumn("statement", role_class(F.col("role"))).where("statement IS NOT NULL")
    return df.groupBy(*keys, "statement").agg(F.min_by("role", F.struct("position", "role")).alias("role"))


def children_of(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent") == parent)


def _kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _climb(parents: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Where each child's path ends, and the children whose path never does.

    ``parents`` is (keys, child, parent), one row per child. The first frame is
    (keys, child, end, depth); the second (keys, child, at), ``at`` a place on
    the cycle that the path runs into. Every round joins each pointer with that
    of the place it points to, so paths double: a tree of 1,000 levels takes
    ten rounds. Only two counts reach the driver.
    """
    known = parents.select(*keys, F.col("child").alias("parent"), F.lit(True).alias("known"))
    first = _kept(parents.join(known, [*keys, "parent"], "left"))
    parent, is_node = F.col("parent"), F.col("known").isNotNull()
    done = first.where(~is_node).select(
        *keys, "child", F.coalesce(parent, F.col("child")).alias("end"), F.when(parent.isNull(), 0).otherwise(1).alias("depth")
    )
    live = first.where(is_node).select(*keys, "child", parent.alias("at"))
    longest = live.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    steps = 1
    while longest:
        ahead = done.select(*keys, F.col("child").alias("at"), "end", "depth", F.lit(None).cast("string").alias("next")).unionByName(
            live.select(*keys, F.col("child").alias("at"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("int").alias("depth"), F.col("at").alias("next"))
        )
        moved = _kept(live.join(ahead, [*keys, "at"]))
        done = done.unionByName(moved.where("end IS NOT NULL").select(*keys, "child", "end", (F.col("depth") + steps).alias("depth")))
        live = moved.where("end IS NULL").select(*keys, "child", F.col("next").alias("at"))
        steps *= 2
        if live.isEmpty() or steps > longest:
            break
    return done, live


def concept_depths(edges: DataFrame, keys: Sequence[str] = ("statement",)) -> DataFrame:
    """Steps from each concept up to its root; a cycle counts its members once.

    One parent per child, the last edge wins. Depths come by pointer doubling,
    in rounds that grow with the logarithm of the depth, for all trees at once.
    What never reaches a root hangs on a cycle: after as many steps as a tree
    has nodes every pointer lies on one, which gives the cycles' members; their
    smallest member, found by doubling too, tells cycles apart and so their
    lengths, and the rest climbs to its cycle as to a root.
    """
    parents = _kept(edges.groupBy(*keys, "child").agg(F.max_by("parent", F.struct("ord", "parent")).alias("parent")))
    done, live = _climb(parents, keys)
    out = done.select(*keys, "child", "depth")
    if live.isEmpty():
        return out
    members = _kept(live.select(*keys, F.col("at").alias("child")).distinct())
    ring = _kept(parents.join(members, [*keys, "child"], "left_semi").withColumnRenamed("parent", "at").withColumn("low", F.col("child")))
    largest, steps = ring.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0], 1
    while steps < largest:
        ahead = ring.select(*keys, F.col("child").alias("at"), F.col("at").alias("next"), F.col("low").alias("other"))
        ring = _kept(ring.join(ahead, [*keys, "at"]).select(*keys, "child", F.col("next").alias("at"), F.least("low", "other").alias("low")))
        steps *= 2
    sizes = ring.groupBy(*keys, "low").agg(F.count("*").cast("int").alias("around"))
    around = _kept(ring.join(sizes, [*keys, "low"]).select(*keys, "child", "around"))
    tails = parents.join(live, [*keys, "child"], "left_semi").join(members, [*keys, "child"], "left_anti")
    onto, _ = _climb(tails, keys)
    onto = onto.join(around.withColumnRenamed("child", "end"), [*keys, "end"]).select(*keys, "child", (F.col("depth") + F.col("around")).alias("depth"))
    return out.unionByName(around.withColumnRenamed("around", "depth")).unionByName(onto)


# Confidence of a resolution by the tree it came from.
TREE_CONFIDENCE = (("calc", 0.97), ("pres", 0.93))


def graph_resolve(facts: DataFrame, filings: DataFrame, depths: DataFrame, seeds: DataFrame) -> DataFrame:
    """Metrics of each filing through its own statement trees.

    ``facts`` is (cik, end_date, concept, value, filed), ``filings`` is (accn,
    cik, end_date, filed), ``depths`` is (accn, tree, statement, child, depth)
    and ``seeds`` (metric, statement, concept, priority). A filing's candidates
    are the seeds present in its tree in seed order; for revenue, further
    revenue nodes of the tree follow, shallowest first. The calculation tree
    comes before the presentation tree. Values are those known when the filing
    was filed: the latest up to that day of each concept and period.

    Facts meet filings on (cik, end_date), nodes on (accn, concept), so no
    concept that all companies report is a key by itself.
    """
    nodes = depths.withColumnRenamed("child", "concept")
    in_tree = nodes.join(F.broadcast(seeds), ["statement", "concept"]).select(
        "accn", "tree", "metric", "concept", F.lit(False).alias("extra"), F.col("priority").alias("rank")
    )
    name = F.col("concept")
    own = seeds.where("metric = 'revenue'").select("concept").distinct()
    extra = nodes.where((F.col("statement") == "income") & name.rlike(REVENUE_NODE) & ~name.rlike(REVENUE_NODE_EXCLUDED))
    extra = extra.join(F.broadcast(own), "concept", "left_anti").select(
        "accn", "tree", F.lit("revenue").alias("metric"), "concept", F.lit(True).alias("extra"), F.col("depth").alias("rank")
    )
    known = facts.where("value IS NOT NULL").select("cik", "end_date", "concept", "value", F.col("filed").alias("told"))
    known = filings.select("accn", "cik", "end_date", "filed").join(known, ["cik", "end_date"]).where("told <= filed")
    known = known.groupBy("accn", "cik", "end_date", "concept").agg(F.max_by("value", F.struct("told", "value")).alias("value"))
    hits = known.join(in_tree.unionByName(extra), ["accn", "concept"])
    tree = F.when(F.col("tree") == TREE_CONFIDENCE[0][0], 0).otherwise(1)
    order = F.struct(tree, "extra", "rank", "concept")
    best = hits.groupBy("accn", "cik", "end_date", "metric").agg(F.min_by(F.struct("value", "concept", "tree"), order).alias("b"))
    sure = F.when(F.col("b.tree") == "calc", TREE_CONFIDENCE[0][1]).otherwise(TREE_CONFIDENCE[1][1])
    return best.select(
        "accn", "cik", "end_date", "metric", "b.value",
        F.concat("b.concept", F.lit(" (graph_"), "b.tree", F.lit(")")).alias("source"), sure.alias("confidence"),
    )
