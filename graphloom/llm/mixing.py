"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates r(d) in [0, cap] that give every source its target number of words, take those closest to 1 in
relative entropy, sum r log r - r + 1. Their dual has one multiplier per source, and r(d) = min(cap, exp(lambda * size / mean))
with the mean size of the source's documents. The multipliers are found by Newton steps kept inside a bracket, each a
distributed aggregate over the histogram (source, size, documents), which is far smaller than the corpus. Rates are then
rounded to whole copies: running totals of copies from the longest documents down are rounded, and what a source's words then miss of its target
is made up by single copies of fitting size. Documents take their copies by rank within (source, size). Sums are of decimals, so reruns agree whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, per_bucket, release, word_count

WEIGHTS = (5, 2, 1)


#: Sums of doubles depend on their order, sums of these don't.
EXACT = "decimal(38,9)"


def before(df: DataFrame, by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of sums, its total over the rows before in the order `by`: running totals within ranges of rows, and one of the ranges' totals (a row per range)."""
    d = materialize(df.withColumns({f"v_{n}": c for n, c in sums.items()}).repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("part").agg(*[F.sum(f"v_{n}").alias(f"t_{n}") for n in sums])
    per = per.select("part", *[F.coalesce(F.sum(f"t_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in sums])
    out = d.join(F.broadcast(per), "part").withColumns({n: F.col(f"b_{n}") + F.coalesce(F.sum(f"v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = 3) -> DataFrame:
    """(source, source_size, documents, target) of a histogram (source, size, n): sources by code point, null last, weigh `weights` in turn and
    share `share` of all words; a target stops at cap times its source's words, the excess being shared again by weight. There may be as many sources as there are sites."""
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    s = before(total, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))).drop("nth")
    most = F.col("source_size") * F.lit(cap)
    room = F.col("source_size") / F.col("w")
    s = before(s, [room, F.col("source").asc_nulls_last()], {"most_before": most, "w_before": F.col("w")})
    words, w = s.agg(F.sum("source_size"), F.sum("w")).first()
    s = s.withColumn("level", (F.lit(share) * F.lit(words or 0) - F.col("most_before")) / (F.lit(w or 0) - F.col("w_before"))).withColumn("full", most <= F.col("level") * F.col("w"))
    # The full ones come first in this order; the level of the rest is that of the first that isn't full.
    first = s.where("not full").agg(F.min(F.struct(room.alias("room"), F.col("source").isNull().alias("none"), "source", "level"))).first()[0]
    target = F.when(F.col("full"), most.cast("double")).otherwise(F.lit(first["level"] if first else None).cast("double") * F.col("w"))
    return s.select("source", "source_size", "documents", target.cast("double").alias("target"))


def multipliers(sizes: DataFrame, targets: DataFrame, cap: int = 3, tolerance: float = 1e-9, most_steps: int = 80) -> DataFrame:
    """(source, lam, mean): the dual's solution, by bracketed Newton steps. Each step sums the dual's gradient and second derivative over the histogram."""
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))
    state = targets.select("source", "target", "source_size", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("below"), F.lit(False).alias("above"), F.lit(False).alias("done"))
    # All documents at the cap, or none taken: no finite multiplier.
    state = state.withColumn("done", (F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0))
    state = state.withColumn("lam", F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("done"), F.lit(float("inf"))).otherwise(F.lit(0.0)))
    state = materialize(state, "dual")
    sizes = sizes.where("size > 0")
    for _ in range(most_steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        words = F.col("n") * F.col("size")
        sums = sizes.join(state.where("not done"), F.col("h_source").eqNullSafe(F.col("source"))).groupBy("source").agg(F.sum((words * rate).cast(EXACT)).cast("double").alias("f"), F.sum(F.when(rate < cap, words * rate * x).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        sums = sums.select(F.col("source").alias("s_source"), "f", "slope")
        gap = F.coalesce("f", F.lit(0.0)) - F.col("target")
        s = state.join(sums, F.col("s_source").eqNullSafe(F.col("source")), "left").withColumn("gap", gap)
        s = s.withColumn("done", F.col("done") | (F.abs("gap") <= tolerance * F.col("target")))
        s = s.withColumn("above", F.col("above") | (F.col("gap") > 0)).withColumn("below", F.col("below") | (F.col("gap") <= 0))
        s = s.withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (~F.col("above") | (newton < F.col("hi"))) & (~F.col("below") | (newton > F.col("lo")))
        # Without a bracket, a Newton step goes at most as far as doubling would; within one, halve where Newton leaves it.
        reach = 2 * F.abs("lam") + 1
        step = F.when(inside, F.greatest(F.least(newton, F.col("lam") + reach), F.col("lam") - reach)).when(F.col("above") & F.col("below"), (F.col("lo") + F.col("hi")) / 2).when(F.col("above"), F.col("lam") - reach).otherwise(F.col("lam") + reach)
        s = s.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(step))
        old, state = state, materialize(s.select(*state.columns), "dual")
        release(old)
        if not state.where("not done").head(1):
            break
    return state.select("source", "lam", "mean")


def planned_copies(sizes: DataFrame, duals: DataFrame, targets: DataFrame, cap: int = 3, corrections: int = 4) -> DataFrame:
    """(source, size, copies): copies is how many copies all documents of that source and size get together, within 0 and cap * n.

    Per source, from the longest size down, the running total of rate * n is rounded, and a size gets what that adds. Words then miss the target by at most half the longest document;
    each of `corrections` times, one copy of the size nearest to what is missing is added or taken away, if that brings the total nearer. Documents without words keep one copy each.
    """
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
    h = sizes.join(duals, F.col("h_source").eqNullSafe(F.col("source"))).select("source", "size", "n", (rate * F.col("n")).cast(EXACT).alias("want"))
    upto = F.sum(F.when(F.col("size") > 0, F.col("want")).otherwise(0)).over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))
    copies = F.when(F.col("size") == 0, F.col("n")).otherwise(whole(F.col("upto")) - whole(F.col("upto") - F.col("want"))).cast("bigint")
    plan = materialize(h.withColumn("upto", upto).select("source", "size", "n", copies.alias("copies")), "copies")
    goal = targets.select(F.col("source").alias("g_source"), "target")
    for _ in range(corrections):
        taken = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        gap = taken.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select("g_source", (F.col("target") - F.col("taken")).alias("gap"))
        sized = plan.join(gap, F.col("source").eqNullSafe(F.col("g_source"))).where((F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0))
        miss = F.abs(F.abs("gap") - F.col("size"))
        pick = sized.where(miss < F.abs("gap")).groupBy("g_source", "gap").agg(F.min(F.struct(miss.alias("miss"), "size"))["size"].alias("g_size"))
        pick = pick.select("g_source", "g_size", F.signum("gap").cast("bigint").alias("one"))
        new = plan.join(pick, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")), "left")
        old, plan = plan, materialize(new.select("source", "size", "n", (F.col("copies") + F.coalesce("one", F.lit(0))).alias("copies")), "copies")
        release(old)
    return plan.select("source", "size", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies (0 to cap), and the columns in keep.

    size: number of words; null text: 0. Documents without words keep one copy. Ties (equal source and size) are
    broken by a hash of the id, then the id, so reruns agree; repeated rows are documents of their own. Null sources are one source, the last.
    Sources whose documents all lack words have target 0. An empty table gives an empty result.
    """
    own = [F.col(c) for c in keep]
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *own)
    base = materialize(base, "sizes")
    return _mix(base, weights, share, cap)


def _mix(base: DataFrame, weights, share, cap) -> DataFrame:
    narrow = base.select("id", "source", "size")
    hist = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    h = hist.select(F.col("source").alias("h_source"), "size", "n")
    targets = materialize(source_targets(hist, weights, share, cap), "targets")
    duals = multipliers(h, targets, cap)
    plan = planned_copies(h, duals, targets, cap)
    # Rank within (source, size) in two steps: documents of a bucket, then what the buckets before it hold.
    buckets = per_bucket(hist.agg(F.sum("n")).first()[0] or 0, 2_000)
    # A key without nulls, so that the window and the join below want the same dealing and wide rows are shuffled once.
    key = ["source_key", "size", "bucket"]
    bucket = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(buckets)).cast("int")
    dealt = base.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("bucket", bucket)
    counts = dealt.groupBy("source", *key).agg(F.count("*").alias("in_bucket"))
    earlier = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bins = plan.join(hist.withColumnRenamed("source", "p_source").withColumnRenamed("size", "p_size"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).select("p_source", "p_size", "n", "copies")
    slots = counts.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    slots = slots.join(bins, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    goal = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    slots = slots.join(goal, F.col("source").eqNullSafe(F.col("t_source")))
    slots = materialize(slots.select(*key, "before", "n", F.col("copies").alias("planned"), "source_size", "target"), "slots")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("id"), F.col("id")))
    ranked = dealt.withColumn("nth", nth).join(slots, key)
    rank = F.col("before") + F.col("nth") - 1
    extra = F.when(rank < F.col("planned") % F.col("n"), 1).otherwise(0)
    copies = (F.floor(F.col("planned") / F.col("n")) + extra).cast("int").alias("copies")
    names = [c for c in base.columns if c not in ("id", "source", "size")]
    return ranked.select("id", "source", "size", "source_size", "target", copies, *names)
