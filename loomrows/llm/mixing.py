"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
all words. A source gives at most ``CAP`` times its size; what it can't give is
reshared by weight among the others until none is above its cap. That is solved
in closed form: by rising cap per weight, a source is capped if its cap is at
most its share of what the sources before it leave.

Taking: of a source with target t and size s, every document is taken floor(t/s)
times, and once more by a permuted draw that fills the rest. Documents are
dealt to blocks by a hash (the permutation); whole blocks are drawn until one
would exceed the rest, that block is split again by further bits of the hash,
and so on until a block holds about ``LEAF`` documents. Of these, the largest
that still fit are taken greedily. Documents larger than what is left are set
aside, and the draw is repeated, by another hash, on all others that are not
drawn, until no document fits. Each pass leaves less than the smallest document
that its leaf left, so passes are few. No source is sorted or collected, each
level reads a 256th of the one before, and a plan is one short row per source.

Shards: each copy of a source is cut in blocks of like size by another hash. The
blocks of all sources are dealt to 2^depth output shards by a
multivariate-hypergeometric splitting tree. Each node holds the number of
blocks of each source; its left child gets a draw of half of them, source by
source (inverse transform from hashed uniforms), the right child the rest, so
quotas stay exact. A shard takes the next blocks of each source's permuted
list, disjoint from all others, and its rows are shuffled locally by a hash.

Documents without words are never taken. Rows with a null doc_id have whole
copies like all others and are never drawn for the fraction. Rows with one
doc_id in a source are drawn together, as one unit. Sources meet in one window,
a short row each: a million of them is a few hundred MB. Reruns agree:
everything hangs on hashes of doc_id and ``seed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, let, words_of

WEIGHTS = (5, 2, 1)
CAP = 3
LEAF = 64
FAN_OUT = 256
#: Words of a shard, blocks that a shard gets on average, and the deepest tree.
SHARD, BLOCKS, MOST_DEPTH = 1 << 21, 64, 16
#: Levels of blocks; four reach 64 * 256^4 documents of one source.
LEVELS = 4
SEED = 20_011


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``size``, the number of words of the whole text."""
    return docs.withColumn("size", F.size(words_of(F.col(text))).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, n_docs, source_size and target of each source."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumns({"most": (cap * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(every).cast("double"), "rank": rank})
    before = every.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = every.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    share = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("capped", F.col("most") <= F.col("weight") * share)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * left / open_weight)
    return by.select("source", "n_docs", "source_size", target.alias("target"))


def repeated(sizes: DataFrame) -> DataFrame:
    """(source, doc_id, unit) of doc_ids that a source has several times, where
    unit is the number of words of all their rows."""
    by = sizes.where("doc_id IS NOT NULL").groupBy("source", "doc_id").agg(F.sum("size").alias("unit"), F.count(F.lit(1)).alias("n"))
    return by.where("n > 1").select(F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id"), "unit")


def with_units(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows with ``unit``, the words of all rows of their doc_id and source."""
    on = rows.join(again, F.col("source").eqNullSafe(F.col("_source")) & (F.col("doc_id") == F.col("_doc_id")), "left")
    return on.withColumn("unit", F.coalesce("unit", "size")).drop("_source", "_doc_id")


def block(turn: int, level: int, seed: int) -> Column:
    """A document's block of a pass and level, from 15 bits of its hash."""
    bits = F.pmod(F.shiftright(F.xxhash64(F.lit(seed + turn), F.col("doc_id")), 15 * level), F.lit(1 << 15))
    return F.floor(bits * F.col(f"blocks{turn}_{level}") / (1 << 15)).cast("int")


def mix_plan(sizes: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> Kept:
    """One row per source: target, copies of every document, and what is drawn
    once more: for each pass the largest unit that it draws (``limit``), blocks
    below ``cut`` of each level, and the list ``picks``. ``need`` is what no
    document fits.

    Args:
        sizes: doc_id, source, size; read several times, so written before.
    """
    plan = targets(sizes, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("copies", F.least(copies, F.lit(cap)).cast("int"))
    step = Kept(plan.withColumn("need", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0))))
    rows, turn = Kept(with_units(sizes, repeated(sizes)).where("unit > 0 AND doc_id IS NOT NULL").select("doc_id", "source", "size", "unit")), 0
    while True:
        # each pass writes what is open to it, which is soon little
        open_ = with_plan(rows.df, step.df).where("unit <= need")
        if turn:
            open_ = open_.where(~drawn(step.df, seed, turn - 1))
        rows = _next(rows, open_.select("doc_id", "source", "size", "unit"))
        left = rows.df.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n_open")).collect()
        if not left:
            rows.drop()
            return step
        step = _pass(rows.df, step, left, turn, seed)
        turn += 1


def _next(done: Kept, plan: DataFrame) -> Kept:
    step = Kept(plan)
    done.drop()
    return step


def _pass(rows: DataFrame, before: Kept, left: list, turn: int, seed: int) -> Kept:
    """The plan with one more draw from rows; left has their number by source."""
    most = max(r.n_open for r in left)
    counts = before.df.sparkSession.createDataFrame([tuple(r) for r in left], before.df.select(F.col("source").alias("_source"), F.lit(0).cast("long").alias("n_open")).schema)
    plan = before.df.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    plan = plan.withColumn(f"limit{turn}", F.col("need"))
    n, levels = F.coalesce("n_open", F.lit(0)), 0
    for level in range(LEVELS):
        plan = plan.withColumn(f"blocks{turn}_{level}", F.least(F.greatest(F.ceil(n / LEAF), F.lit(1)), F.lit(FAN_OUT)).cast("int"))
        n = n / F.col(f"blocks{turn}_{level}")
        levels += most > LEAF * FAN_OUT**level
    step = _next(before, plan.drop("n_open"))
    for level in range(levels):
        inside = _inside(rows, step.df, turn, level, seed)
        sums = inside.groupBy("source", block(turn, level, seed).alias("b")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
        first = F.min(F.when(F.col("upto") > F.col("need"), F.struct("b", (F.col("upto") - F.col("words")).alias("before"))))
        cut = sums.groupBy(F.col("source").alias("_source")).agg(first.alias("_cut"), F.sum("words").alias("_all"))
        on = step.df.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
        used = F.when(F.col("_cut").isNotNull(), F.col("_cut.before")).otherwise(F.coalesce("_all", F.lit(0)))
        cut_at = F.coalesce(F.col("_cut.b"), F.col(f"blocks{turn}_{level}"))
        step = _next(step, on.withColumns({f"cut{turn}_{level}": cut_at, "need": F.col("need") - used}).drop("_source", "_cut", "_all"))
    units = _inside(rows, step.df, turn, levels, seed).groupBy("source", "doc_id").agg(F.first("unit").alias("words"))
    return _next(step, _fill(step.df, units, turn))


def _fill(plan: DataFrame, units: DataFrame, turn: int) -> DataFrame:
    """The plan with ``picks`` of units (source, doc_id, words; few per source),
    the largest that still fit first, and ``need`` less by these."""
    lists = units.groupBy(F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(F.struct("words", "doc_id")), asc=False).alias("units"))
    on = plan.join(lists, F.col("source").eqNullSafe(F.col("_source")), "left")
    none = F.struct(F.col("need").alias("left"), F.expr("cast(array() as array<bigint>)").alias("picks"))
    take = lambda a, x: F.when(x["words"] <= a["left"], F.struct((a["left"] - x["words"]).alias("left"), F.concat(a["picks"], F.array(x["doc_id"].cast("long"))).alias("picks"))).otherwise(a)
    on = on.withColumn("_got", F.coalesce(F.aggregate("units", none, take), none))
    return on.withColumns({"need": F.col("_got")["left"], f"picks{turn}": F.col("_got")["picks"]}).drop("_source", "units", "_got")


def _inside(rows: DataFrame, plan: DataFrame, turn: int, levels: int, seed: int) -> DataFrame:
    """Rows open to a pass that are inside the blocks that are split at each of its levels."""
    found = with_plan(rows, plan)
    for level in range(levels):
        found = found.where(block(turn, level, seed) == F.col(f"cut{turn}_{level}"))
    return found


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with their source's row of the plan (small, so Spark broadcasts it
    by its measured size)."""
    return docs.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def drawn(plan: DataFrame, seed: int = SEED, only: int | None = None) -> Column:
    """Whether a row (with ``unit``) is drawn once more, in any pass of the plan
    or in only one."""
    found = F.lit(False)
    for turn in range(sum(c.startswith("picks") for c in plan.columns)) if only is None else [only]:
        last = F.coalesce(F.array_contains(f"picks{turn}", F.col("doc_id").cast("long")), F.lit(False))
        for level in reversed(range(sum(c.startswith(f"cut{turn}_") for c in plan.columns))):
            b, cut = block(turn, level, seed), F.col(f"cut{turn}_{level}")
            last = (b < cut) | ((b == cut) & last)
        found = found | ((F.col("unit") > 0) & (F.col("unit") <= F.col(f"limit{turn}")) & last)
    return F.coalesce(found & F.col("doc_id").isNotNull(), F.lit(False))


def taken(sizes: DataFrame, plan: Kept, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document, as planned."""
    words = F.col("size") * (F.col("copies") + drawn(plan.df, seed).cast("int"))
    out = with_plan(with_units(sizes, repeated(sizes)), plan.df)
    return out.select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"))


def draw_hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` taken from ``total`` are among ``good``: inverse
    transform of the uniform u, terms by their ratios outward from the mode."""
    low, high = F.greatest(F.lit(0), draws - (total - good)), F.least(good, draws)
    mode = F.least(F.greatest(F.floor((good + 1) * (draws + 1) / (total + 2)).cast("long"), low), high)
    # twelve standard deviations and more from the mode nothing is left to draw
    share = good / F.greatest(total, F.lit(1))
    far = F.ceil(12 * F.sqrt(draws * share * (1 - share)) + 40).cast("long")
    low, high = F.greatest(low, mode - far), F.least(high, mode + far)

    def ratio(k: Column) -> Column:
        return (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1))

    def walk(m: Column, start: Column) -> Column:
        up = F.when(m < high, F.sequence(m, high - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        down = F.when(m > low, F.sequence(m - 1, low)).otherwise(F.expr("cast(array() as array<bigint>)"))
        one = lambda a, k, w, at: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when((a["pick"] < 0) & (a["sum"] + w >= a["stop"]), at).otherwise(a["pick"]).alias("pick"), a["stop"].alias("stop"))
        there = F.aggregate(up, start, lambda a, k: one(a, k, a["w"] * ratio(k), k + 1))
        back = let(there, lambda t: F.struct(F.lit(1.0).alias("w"), t["sum"].alias("sum"), t["pick"].alias("pick"), t["stop"].alias("stop")))
        return F.aggregate(down, back, lambda a, k: one(a, k, a["w"] / ratio(k), k))

    def begin(m: Column, stop: Column) -> Column:
        return F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.when(stop <= 1.0, m).otherwise(F.lit(-1).cast("long")).alias("pick"), stop.alias("stop"))

    def draw(m: Column) -> Column:
        whole = walk(m, begin(m, F.lit(float("inf"))))["sum"]
        return let(whole, lambda s: let(walk(m, begin(m, u * s)), lambda r: F.when(r["pick"] < 0, m).otherwise(r["pick"])))

    return let(mode, draw)


def _splitter(level: int, seed: int):
    """One source's draw at a node: (state, its blocks) to the next state."""

    def step(a: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), F.size(a["left"])), F.lit(1 << 40)) / float(1 << 40)
        got = draw_hypergeometric(a["total"], x, a["draws"], u)
        return let(got, lambda g: F.struct(F.concat(a["left"], F.array(g)).alias("left"), (a["total"] - x).alias("total"), (a["draws"] - g).alias("draws")))

    return step


def splitting_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(source, shard, quota): the blocks of each source dealt to 2^depth
    shards. quotas has source and n, its number of blocks, below some thousands."""
    root = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("null"), F.col("source").alias("source"), F.col("n").cast("long").alias("n")))).alias("of"))
    nodes = root.select(F.lit(0).alias("shard"), F.transform("of", lambda x: x["source"]).alias("names"), F.transform("of", lambda x: x["n"]).alias("counts"))
    for level in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.expr("cast(array() as array<bigint>)").alias("left"), total.alias("total"), F.floor(total / 2).cast("long").alias("draws"))
        step = _splitter(level, seed)
        nodes = nodes.withColumn("left", F.aggregate("counts", start, step)["left"])
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        child = F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("counts"))))
        nodes = nodes.select("names", child.alias("c")).select("c.shard", "names", "c.counts")
    pairs = F.explode(F.zip_with("names", "counts", lambda s, n: F.struct(s.alias("source"), n.alias("quota"))))
    return nodes.select("shard", pairs.alias("p")).select("p.source", "shard", "p.quota")


def mix(docs: DataFrame, depth: int | None = None, seed: int = SEED, text: str = "text") -> DataFrame:
    """The mixed rows: documents repeated as often as they are taken, with
    ``shard`` (unless docs have a column of that name). Rows come as the shards have them, in a hashed order within each.

    Args:
        depth: the shards are 2^depth; by default of about SHARD words each.
    """
    sizes = Kept(sized(docs, text).select("doc_id", "source", "size"))
    return _dealt(docs, sizes, mix_plan(sizes.df, seed), depth, seed, text)


def mix_taken(docs: DataFrame, depth: int | None = None, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs, where
    taken is what the words of its rows in the finished mix add up to."""
    docs = docs.select("doc_id", "source", F.col(text).alias("text"))
    sizes = Kept(sized(docs).select("doc_id", "source", "size"))
    plan = mix_plan(sizes.df, seed)
    # counted on the texts as they lie in their shards; only the counts are written
    rows = Kept(sized(_dealt(docs, sizes, plan, depth, seed, "text")).select("doc_id", "source", "size"))
    # words of a document in the mix and in docs, added up side by side
    both = rows.df.select("doc_id", "source", F.col("size").alias("mixed"), F.lit(0).cast("long").alias("own"))
    both = both.unionByName(sizes.df.select("doc_id", "source", F.lit(0).cast("long").alias("mixed"), F.col("size").alias("own")))
    shares = both.groupBy(F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id")).agg(F.sum("mixed").alias("_words"), F.sum("own").alias("_unit"))
    out = with_plan(sizes.df, plan.df).join(shares, F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    words = F.when(F.col("_unit") > 0, F.col("size") * F.col("_words") / F.col("_unit")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", F.round(words).cast("long").alias("taken"))


def _dealt(docs: DataFrame, sizes: Kept, plan: Kept, depth: int | None, seed: int, text: str) -> DataFrame:
    """The rows of ``mix`` by a plan."""
    columns = docs.columns
    words = plan.df.agg(F.sum("target").alias("words")).collect()[0].words or 0.0
    if depth is None:
        depth = min(MOST_DEPTH, max(2, math.ceil(math.log2(max(1.0, words / SHARD)))))
    # each whole copy of a source and what is drawn once more is cut in blocks
    each = max(1.0, words / (BLOCKS << depth))
    copy_words = F.when(F.col("copy") < F.col("copies"), F.col("source_size").cast("double")).otherwise(F.col("target") - F.col("copies") * F.col("source_size"))
    blocks_of = lambda size: F.greatest(F.lit(1), F.ceil(size / each)).cast("int")
    blocks = plan.df.select("source", "copies", "source_size", "target", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("copy"))
    blocks = blocks.select("source", "copy", F.explode(F.sequence(F.lit(0), blocks_of(copy_words) - 1)).alias("b"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "copy", "b"), "copy", "b")
    blocks = blocks.withColumn("place", F.row_number().over(order))
    tree = splitting_tree(blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n")), depth, seed)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    tree = tree.withColumn("to", upto).where("quota > 0").select(F.col("source").alias("_s"), "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, "to")).alias("_place"))
    where = blocks.join(tree, F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_place")))
    shards = Kept(where.select(F.col("source").alias("_s"), F.col("copy").alias("_copy"), F.col("b").alias("_b"), "shard"))
    # the row as one value, so that no column of docs meets one of the plan
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), "doc_id", "source", F.col(text).alias("_text"))
    rows = with_units(sized(rows, "_text").drop("_text"), Kept(repeated(sizes.df)).df)
    rows = with_plan(rows, plan.df).where("size > 0")
    times = F.col("copies") + drawn(plan.df, seed).cast("int")
    # copies are numbered from 0; the one that is drawn has the number of whole copies
    rows = rows.withColumn("_times", times).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    b = F.floor(F.pmod(F.xxhash64(F.lit(seed), F.lit(1), F.col("doc_id"), F.col("copy")), F.lit(1 << 30)) * blocks_of(copy_words) / (1 << 30)).cast("int")
    rows = rows.select("_row", "doc_id", "source", "copy", b.alias("_block"))
    rows = rows.join(shards.df, F.col("source").eqNullSafe(F.col("_s")) & (F.col("copy") == F.col("_copy")) & (F.col("_block") == F.col("_b")))
    # a task a shard, so that none is empty and none holds two
    rows = rows.select("_row", "doc_id", "copy", "shard").repartitionById(1 << depth, F.col("shard").cast("int")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    return rows.select(*(F.col("_row")[c].alias(c) for c in columns), *(["shard"] if "shard" not in columns else []))
