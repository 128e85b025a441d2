"""Mix sources to target weights by exact block quotas and a splitting tree."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACED, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 32
BUCKETS = 1024
SHARDS = 8
SEED = 20250101
# Rounds of the keyed permutation of blocks, and steps within which it is back in range.
ROUNDS, STEPS = 4, 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add weight and target to one row per source (source, source_size).

    Sources in code point order, NULL last, take the weights in turn and share
    ``share`` times all words; a target stops at ``cap`` times its source's size
    and what is over goes to the rest by weight. With sources ordered by cap per
    weight the full ones are a prefix, so running sums give the fixed point at
    once. These windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("full", F.col("source_size") * cap)
    w = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    rest = total - F.coalesce(F.sum("full").over(w), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(w), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("left", left)
    stays = F.col("rest") * F.col("weight") >= F.col("full") * F.col("left")
    rows = rows.withColumn("level", F.max(F.when(~stays, F.col("rest") / F.col("left"))).over(every))
    target = F.when(stays, F.col("full").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "rank", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _draw(marked: str, wanted: str, everyone: str, chance: str) -> str:
    """SQL for one hypergeometric draw: of ``everyone``, ``wanted`` are taken; how many of ``marked``?

    Inverts the distribution over eight deviations around its mode, with the
    ratio of neighbouring probabilities instead of factorials.
    """
    k, n, m = f"double({marked})", f"double({wanted})", f"double({everyone})"
    mode = f"floor(({n} + 1) * ({k} + 1) / ({m} + 2))"
    spread = f"ceil(4 + 8 * sqrt(greatest({n} * ({k} / {m}) * (1 - {k} / {m}) * ({m} - {n}) / greatest({m} - 1, 1), 0)))"
    low = f"bigint(greatest(0, {n} + {k} - {m}, {mode} - {spread}))"
    high = f"bigint(least({n}, {k}, {mode} + {spread}))"
    step = f"v.p * ({k} - i) * ({n} - i) / ((i + 1) * ({m} - {k} - {n} + i + 1))"
    mass = (f"aggregate(sequence({low}, {high}), named_struct('p', 1d, 't', 0d), "
            f"(v, i) -> named_struct('p', {step}, 't', v.t + v.p), v -> v.t)")
    pick = (f"aggregate(sequence({low}, {high}), named_struct('p', 1d, 't', 0d, 'at', bigint(-1)), "
            f"(v, i) -> named_struct('p', {step}, 't', v.t + v.p, 'at', "
            f"if(v.at < 0 and v.t + v.p >= {chance} * z, i, v.at)), v -> if(v.at < 0, {high}, v.at))")
    return f"if({wanted} = 0 or {marked} = 0, 0L, element_at(transform(array({mass}), z -> {pick}), 1))"


def _split(seed: int) -> str:
    """SQL for the quotas that go left, one number per source, drawn one source after the other."""
    chance = f"(shiftrightunsigned(xxhash64({seed}, lo, width, x.rank), 12) / 4503599627370496d)"
    draw = _draw("x.quota", "s.wanted", "s.everyone", chance)
    fold = (f"aggregate(quotas, named_struct('wanted', half, 'everyone', total, 'out', cast(array() AS array<bigint>)), "
            f"(s, x) -> element_at(transform(array({draw}), d -> named_struct("
            f"'wanted', s.wanted - d, 'everyone', s.everyone - x.quota, 'out', array_append(s.out, d))), 1), s -> s.out)")
    return fold


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Split exact quotas (rank, quota) over shards: (rank, cuts), the running ends per shard.

    A binary tree over the shards: a node's draws are parted between its halves
    in proportion to their shards, and how many of each source go left is a
    multivariate hypergeometric draw, so every leaf holds what a random deal of
    all blocks would give it, and sums stay exact. A node is one row of one
    number per source.
    """
    packed = F.sort_array(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(packed.alias("quotas")).select(F.lit(0).alias("lo"), F.lit(shards).alias("width"), "quotas")
    for _ in range(ceil(log2(shards)) if shards > 1 else 0):
        nodes = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (a, x) -> a + x.quota)"))
        nodes = nodes.withColumn("half", F.expr("total * (width div 2) div width"))
        nodes = nodes.withColumn("left", F.expr(_split(seed)))
        part = "zip_with(quotas, `left`, (x, l) -> named_struct('rank', x.rank, 'quota', {}))"
        nodes = nodes.selectExpr(
            "inline(filter(array("
            f"named_struct('lo', lo, 'width', int(width div 2), 'quotas', {part.format('l')}), "
            f"named_struct('lo', int(lo + width div 2), 'width', int(width - width div 2), 'quotas', {part.format('x.quota - l')})"
            "), c -> c.width > 0))"
        )
    leaves = nodes.select("lo", F.explode("quotas").alias("q")).select("lo", "q.rank", "q.quota")
    ends = F.sum("quota").over(Window.partitionBy("rank").orderBy("lo"))
    return leaves.withColumn("end", ends).groupBy("rank").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lo", "end"))), lambda x: x["end"]).alias("cuts")
    )


def permuted(block: str, blocks: str, key: str, seed: int) -> str:
    """SQL for the place of a block in a keyed permutation of ``blocks`` blocks.

    A Feistel network on a grid of a by w cells, a the rounded-up square root of
    the number of blocks and w as few as hold them all: rounds add a hash of one
    coordinate to the other in turn. A place beyond the last block is permuted
    again until it is in range. Fewer than a places lie beyond, so up to 256
    blocks 17 steps are always enough, and with more the chance that they are
    not is below 16^-17 a block.
    """
    a, w = f"bigint(ceil(sqrt({blocks})))", f"bigint(ceil({blocks} / ceil(sqrt({blocks}))))"
    added = "pmod(s.{0} + pmod(xxhash64({1}, {2}, k, s.{3}), {4}), {4})"
    round_ = (f"if(k % 2 = 0, named_struct('l', {added.format('l', seed, key, 'r', 'g.a')}, 'r', s.r), "
              f"named_struct('l', s.l, 'r', {added.format('r', seed, key, 'l', 'g.w')}))")
    once = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v div g.w, 'r', v % g.w), (s, k) -> {round_}, s -> s.l * g.w + s.r)"
    walk = f"aggregate(sequence(1, {STEPS}), bigint({block}), (v, i) -> if(i > 1 AND v < {blocks}, v, {once}))"
    return f"element_at(transform(array(named_struct('a', {a}, 'w', {w})), g -> {walk}), 1)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS,
        shards: int = SHARDS, seed: int = SEED, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_taken and mix_pieces.

    Each source's words, its documents in a hashed order, are cut into blocks. A
    source's quota is the number of blocks whose words make its target: all
    blocks once per whole pass, and for the rest as many as needed from a
    keyed permutation of them (:func:`permuted`). Quotas are dealt to the output shards by
    :func:`shard_quotas`; draws are disjoint, so a word is taken at most ``cap``
    times. mix_pieces lists what is taken of a row: pass, first word, words,
    shard and the place that shuffles the shard.

    Running sums stay within (source, one of 1,024 hash buckets), so a source
    that holds a third of all rows is spread like any other. The same rows
    always give the same mix. NULL or empty texts have size 0 and no pieces;
    NULL is a source of its own; a source without words has target 0; repeated
    rows are separate rows. No rows give no rows. Other columns stay; columns
    named mix_* are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if not c.startswith("mix_")])
    key = F.xxhash64(F.lit(seed), F.col(id), F.col(source), F.col(text))
    rows = docs.withColumn("mix_size", word_count(F.col(text))).withColumn("mix_key", key)
    rows = rows.withColumn("mix_bucket", F.pmod("mix_key", F.lit(BUCKETS)))
    buckets = cut(rows.groupBy(F.col(source).alias("source"), F.col("mix_bucket").alias("bucket")).agg(F.sum("mix_size").alias("words")))
    # One row per source from here to the join: at most 1,024 rows each were summed.
    sized = buckets.groupBy("source").agg(
        F.sum("words").alias("source_size"),
        F.sum(F.ceil(F.col("words") / block_words)).cast("long").alias("blocks"),
    )
    targets = source_targets(sized.select("source", "source_size"), weights, share, cap)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sources = targets.join(sized.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("quota", F.least(quota.cast("long"), F.col("blocks") * cap))
    sources = cut(sources.join(shard_quotas(sources.select("rank", "quota"), shards, seed), "rank"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.ceil(F.col("words") / block_words)).over(before), F.lit(0)).cast("long")
    plan = buckets.withColumn("mix_offset", offset)
    plan = plan.join(sources, same(plan, sources)).select(
        plan["source"].alias("mix_source"), F.col("bucket").alias("mix_in"), "mix_offset",
        F.col("rank").alias("mix_rank"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.col("quota").alias("mix_quota"), F.col("blocks").alias("mix_blocks"), F.col("cuts").alias("mix_cuts"),
    )
    rows = rows.join(plan, F.col(source).eqNullSafe(F.col("mix_source")) & (F.col("mix_bucket") == F.col("mix_in")))
    order = Window.partitionBy("mix_rank", "mix_bucket").orderBy("mix_key", F.col(id), "mix_size")
    end = F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("mix_end", end).withColumn("mix_start", F.col("mix_end") - F.col("mix_size"))
    draw = permuted("mix_offset + b", "mix_blocks", "mix_rank", seed)
    a, z = f"greatest(mix_start, b * {block_words})", f"least(mix_end, (b + 1) * {block_words})"
    pieces = (
        f"filter(flatten(transform(flatten(transform(sequence(mix_start div {block_words}, (mix_end - 1) div {block_words}), b -> "
        f"transform(array({draw}), d -> named_struct('b', b, 'd', d)))), x -> transform(sequence(0L, {cap - 1}L), e -> "
        f"named_struct('pass', int(e), 'first', {a.replace(' b ', ' x.b ')} - mix_start, 'words', {z.replace('(b ', '(x.b ')} - {a.replace(' b ', ' x.b ')}, "
        f"'shard', size(filter(mix_cuts, c -> c <= x.d + e * mix_blocks)), 'draw', x.d + e * mix_blocks)))), p -> p.draw < mix_quota)"
    )
    place = f"transform({pieces}, p -> named_struct('pass', p.pass, 'first', p.first, 'words', p.words, 'shard', p.shard, 'place', xxhash64({seed}, mix_rank, p.draw)))"
    empty = "array<struct<pass:int,first:bigint,words:bigint,shard:int,place:bigint>>"
    rows = rows.withColumn("mix_pieces", F.expr(f"if(mix_size > 0, {place}, cast(array() AS {empty}))"))
    taken = F.expr("aggregate(mix_pieces, 0L, (a, p) -> a + p.words)")
    return rows.withColumn("mix_taken", taken).select(
        *docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_pieces"
    )


def shard_words(shards: int = SHARDS) -> Column:
    """The words of a row's mix_pieces that go to each shard, one number per shard."""
    of = lambda k: F.aggregate(
        F.filter("mix_pieces", lambda p: p["shard"] == k), F.lit(0).cast("long"), lambda a, p: a + p["words"]
    )
    return F.array(*[of(k) for k in range(shards)])


def taken_texts(mixed: DataFrame, text: str = "text", by_shard: bool = False) -> DataFrame:
    """One row per document and pass with the words that were taken, and mix_pass.

    A pass that takes every word keeps the text as it is; else the pieces stand
    in order, each word with the white space after it. With ``by_shard`` there
    is one row per document, pass and output shard, with mix_shard and
    mix_place, the first place of its pieces in the shuffled shard.
    """
    part = (lambda p: F.struct(p["pass"], p["shard"])) if by_shard else (lambda p: F.struct(p["pass"]))
    passes = mixed.withColumn("mix_part", F.explode(F.array_distinct(F.transform("mix_pieces", part))))
    passes = passes.withColumn("mix_pieces", F.filter("mix_pieces", lambda p: part(p) == F.col("mix_part")))
    passes = passes.withColumn("mix_pass", F.col("mix_part.pass"))
    if by_shard:
        passes = passes.withColumn("mix_shard", F.col("mix_part.shard"))
        passes = passes.withColumn("mix_place", F.array_min(F.transform("mix_pieces", lambda p: p["place"])))
    own = F.sort_array(F.transform("mix_pieces", lambda p: F.struct(p["first"].alias("first"), p["words"].alias("words"))))
    passes = passes.withColumn("mix_own", own).drop("mix_part")
    tokens = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = F.element_at(F.transform(F.array(tokens), lambda t: F.array_join(F.flatten(F.transform(
        "mix_own", lambda p: F.slice(t, (p["first"] + 1).cast("int"), p["words"].cast("int"))
    )), "")), 1)
    whole = F.expr("aggregate(mix_own, 0L, (a, p) -> a + p.words)") == F.col("mix_size")
    return passes.withColumn(text, F.when(whole, F.col(text)).otherwise(F.regexp_replace(part, r"[\x20\x09-\x0D]+$", "")))
