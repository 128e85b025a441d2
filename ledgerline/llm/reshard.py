"""Move as few bytes as possible between shards: transfers by minimum-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut
from ledgerline.operators.ranking import rank_within

BLOCKS = 64
NOWHERE = -(1 << 31)
MAX_SHARDS = 256


class _Flow:
    """Minimum-cost flow on a graph of shards and blocks; its size is that of the plan, not of the data."""

    def __init__(self, nodes: int):
        self.out = [[] for _ in range(nodes)]
        self.to, self.left, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        """Fill cheapest paths first until none is left."""
        while True:
            far, via, queue, inside = {s: 0.0}, {}, deque([s]), {s}
            while queue:
                x = queue.popleft()
                inside.discard(x)
                for e in self.out[x]:
                    y, d = self.to[e], far[x] + self.cost[e]
                    if self.left[e] and d < far.get(y, float("inf")) - 1e-9:
                        far[y], via[y] = d, e
                        if y not in inside:
                            inside.add(y)
                            queue.append(y)
            if t not in via:
                return
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            room = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= room
                self.left[e ^ 1] += room


def transfers(old: dict[int, list[tuple[int, int]]], new_shards: int) -> dict[tuple[int, int], int]:
    """Rows to send from old shard i to new shard j, equal to i for those that stay.

    ``old`` has per shard its blocks, lightest rows first, as (rows, bytes). New
    shards hold floor(N / shards) rows, N mod shards of them one more; the flow
    chooses which. A row that stays costs nothing, one that moves costs the mean
    bytes of its block, so the lightest blocks go, and only as many as must.
    """
    shards = sorted(old)
    total = sum(n for blocks in old.values() for n, _ in blocks)
    base, more = divmod(total, new_shards)
    # Nodes: source, sink, shared surplus, old shards, what leaves them, new shards.
    s, t, x = 0, 1, 2
    at, leaves, goes = ({v: 3 + k + i * len(shards) for k, v in enumerate(shards)} for i in (0, 1, 2))
    goes = {j: 3 + 2 * len(shards) + j for j in range(new_shards)}
    g = _Flow(3 + 2 * len(shards) + new_shards)
    arcs = {}
    for i in shards:
        rows = sum(n for n, _ in old[i])
        g.arc(s, at[i], rows, 0)
        if i in goes:
            arcs[i, i] = g.arc(at[i], goes[i], rows, 0)
        for n, size in old[i]:
            if n:
                g.arc(at[i], leaves[i], n, size / n)
        for j in range(new_shards):
            if j != i:
                arcs[i, j] = g.arc(leaves[i], goes[j], rows, 0)
    for j in range(new_shards):
        g.arc(goes[j], t, base, 0)
        g.arc(goes[j], x, 1, 0)
    g.arc(x, t, more, 0)
    g.run(s, t)
    return {k: g.left[e ^ 1] for k, e in arcs.items() if g.left[e ^ 1]}


def reshard(rows: DataFrame, old: Column, new_shards: int, size: str = "size", tie: str = "tie") -> DataFrame:
    """``rows`` with old_shard, shard, slot and moved; counts of new shards differ by one at most.

    Rows are ranked by ``size`` and ``tie`` inside their old shard, over range
    partitions and so whatever a shard holds. Per shard and 64th of its rows one
    count and one sum go to the driver (at most 256 shards), which solves the
    flow. The plan comes back as ranges of ranks; slots follow from them: first
    the rows that stay, then what each old shard sends. Ties and repeated rows
    are placed one by one. Rows whose ``old`` is NULL lie in no shard yet: all
    of them move, and their old_shard stays NULL. No rows give no rows. The
    four result columns replace columns of the same names; all others pass.
    """
    given = F.struct(*[c for c in rows.columns if c not in ("old_shard", "shard", "slot", "moved")]).alias("given")
    slim = rows.select(given, F.coalesce(old.cast("int"), F.lit(NOWHERE)).alias("old_shard"), F.col(size).alias("size"), F.col(tie).alias("tie"))
    ranked = rank_within(slim, ["old_shard"], [F.col("size"), F.col("tie")], "at")
    block = F.ceil(F.col("at") * BLOCKS / F.col("group_size"))
    found = ranked.groupBy("old_shard", block.alias("block")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    found = found.orderBy("old_shard", "block").limit(MAX_SHARDS * BLOCKS + 1).collect()
    if len(found) > MAX_SHARDS * BLOCKS:
        raise ValueError(f"more than {MAX_SHARDS} old shards")
    blocks: dict[int, list] = {}
    for r in found:
        blocks.setdefault(r["old_shard"], []).append((r["n"], r["bytes"]))
    plan = transfers(blocks, new_shards)
    filled = {j: plan.get((j, j), 0) for j in range(new_shards)}
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    ranges = []
    for i in sorted(blocks):
        first = 1  # the lightest rows leave, in blocks of ranks
        for j in range(new_shards):
            n = plan.get((i, j), 0)
            if j != i and n:
                ranges.append((i, j, first, first + n - 1, filled[j]))
                filled[j] += n
                first += n
        if plan.get((i, i), 0):
            ranges.append((i, i, first, first + plan[i, i] - 1, 0))
    for i, j, a, b, start in ranges:
        here = (F.col("old_shard") == i) & F.col("at").between(a, b)
        shard = F.when(here, F.lit(j)).otherwise(shard)
        slot = F.when(here, F.col("at") - a + start).otherwise(slot)
    placed = ranked.select("given", "old_shard", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    was = F.when(F.col("old_shard") != NOWHERE, F.col("old_shard"))
    return placed.select("given.*", was.alias("old_shard"), "shard", "slot", (F.col("shard") != F.col("old_shard")).alias("moved"))


def measures(id: str = "doc_id", text: str = "text") -> list[Column]:
    """id, size (UTF-8 bytes and one), text_crc32 and a hashed tie breaker; a NULL text counts as empty."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return [F.col(id), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
            F.xxhash64(F.col(id), F.col(text)).alias("tie")]


def rewrite(placed: DataFrame, folder: str) -> list[int]:
    """Write the shards that gained or lost rows; return their numbers.

    A shard is a folder of files in rising slot order, one from each partition
    of ``placed``, so rows are written where they are and not shuffled again.
    Shards that the plan leaves as they are keep their files.
    """
    touched = placed.where("moved OR old_shard IS NULL").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    numbers = sorted(r["shard"] for r in touched.where("shard IS NOT NULL").limit(2 * MAX_SHARDS).collect())
    if not numbers:
        return numbers
    placed.where(F.col("shard").isin(numbers)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return numbers


def rewritten(docs: DataFrame, old: Column, new_shards: int, folder: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` resharded, with the affected files written to ``folder`` and read back from there.

    Placement works on ids and sizes; texts move once, to the shard and slot they
    are written to. Rows of shards that nothing leaves or enters are passed on
    from ``docs``. Gives the columns of ``docs``, size, text_crc32, old_shard,
    shard, slot and moved, sizes and checksums those of the texts read back.
    """
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    slim = rows.select(*measures("row", text)[:2], F.xxhash64(F.col(id), F.col(text)).alias("tie"), old.alias("was"))
    placed = cut(reshard(slim, F.col("was"), new_shards).select("row", "old_shard", "shard", "slot", "moved"))
    full = rows.select("row", F.struct(*docs.columns).alias("given")).join(placed, "row").drop("row")
    numbers = rewrite(full, folder)
    back = full.where(~F.col("shard").isin(numbers)) if numbers else full
    if numbers:
        files = docs.sparkSession.read.schema(full.schema).parquet(folder)
        back = files.unionByName(back)
    size, checksum = measures("slot", f"given.{text}")[1:3]
    return back.select("given.*", size, checksum, "old_shard", "shard", "slot", "moved")
