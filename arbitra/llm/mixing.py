"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The schedule has 2^k slots.  Slot ``i`` stands at the van der Corput point of ``i`` (its binary
digits mirrored).  The sources' targets, added up and counted in blocks, cut the line of points
into one interval per source; points beyond the last stay empty.  The slots of a source are
ranked in order; the r-th takes the r-th block of the source's token stream, which is its
documents in a seeded order, epoch after epoch.  Any run of slots holds the sources in their
shares, and all slots together hold each source's target to within one block.

All steps are DataFrame operations.  Running totals within a source are those of hash buckets
plus the totals of the buckets before, so a source with a third of all rows is spread as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.llm.tables import SPACE, written

#: Blocks are 1 / 2^17 of all tokens, but never more than this many tokens.
MAX_BLOCK_TOKENS = 4096
SLOT_BITS = 17
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: shares of the total by weight, held at ``max_epochs`` sizes.

    ``sizes`` has one row per source.  Sources in code point order, null last, get the weights in
    turn.  What the limit leaves over is shared out again by weight: the targets are
    ``min(max_epochs * size, level * weight)`` at the one level where they add up to the total.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit([float(x) for x in weights])
    ranked = sizes.select(
        "source", "source_size",
        F.get(cycle, ((F.row_number().over(w) - 1) % len(weights)).cast("int")).alias("weight"),
    ).withColumn("most", F.col("source_size") * max_epochs)
    # In order of the level at which a source is full, the first are full and the others are not.
    full_at = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_at.rowsBetween(Window.unboundedPreceding, -1)
    every = full_at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    open_level = F.when(level * F.col("weight") <= F.col("most"), level)
    # The first source that is not full has the level; for those after it the formula gives less.
    levels = ranked.withColumn("level", open_level)
    target = F.when(F.col("found").isNull(), F.col("most").cast("double")).otherwise(
        F.least(F.col("most").cast("double"), F.col("found") * F.col("weight"))
    )
    return levels.withColumn("found", F.max("level").over(every)).select(
        "source", "source_size", "weight", target.alias("target")
    )


def running_total(rows: DataFrame, key: str, order: Sequence[str | Column], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same key before this one.

    ``bucket`` must rise with the order.  Only rows of one (key, bucket) meet in a task.
    """
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("llm_sum"))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(key).alias("llm_key"), F.col(bucket).alias("llm_bucket"),
        F.coalesce(F.sum("llm_sum").over(earlier), F.lit(0)).alias("llm_offset"),
    )
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, F.col(key).eqNullSafe(F.col("llm_key")) & (F.col(bucket) == F.col("llm_bucket")))
    return joined.select(
        *rows.columns, (F.col("llm_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long").alias(out)
    )


def mirrored(i: Column, bits: int) -> Column:
    """The number whose ``bits`` binary digits are those of ``i`` from last to first."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, source, rank: which source each slot belongs to, and its place among the source's slots.

    ``targets`` has source and target.  Points of one interval come in cells of about the square
    root of their number, so a source with most of the slots is spread over tasks.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = targets.select("source", upto.alias("upto"), "target", every.alias("all")).select(
        "source",
        F.ceil((F.col("upto") - F.col("target")) / block).alias("lo"), F.ceil(F.col("upto") / block).alias("hi"),
        F.length(F.bin(F.greatest(F.lit(0), F.ceil(F.col("all") / block) - 1))).alias("bits"),
    )
    cell = F.pow(F.lit(2), (F.col("bits") / 2).cast("int")).cast("long")
    cells = ends.where("hi > lo").withColumn("cell", cell).select(
        "*", F.explode(F.sequence(F.floor(F.col("lo") / F.col("cell")), F.floor((F.col("hi") - 1) / F.col("cell")))).alias("c")
    ).repartition("source", "c")
    first, last = F.greatest("lo", F.col("c") * F.col("cell")), F.least("hi", (F.col("c") + 1) * F.col("cell")) - 1
    points = cells.select("source", "bits", F.explode(F.sequence(first, last)).alias("point"))
    slots = points.select("source", "bits", mirrored(F.col("point"), F.col("bits")).alias("slot")).select(
        "source", "slot", F.lit(1).alias("one"), F.floor(F.col("slot") / F.pow(F.lit(2), (F.col("bits") / 2).cast("int"))).alias("bucket")
    )
    return running_total(slots, "source", ["slot"], "bucket", "one", "rank").select("slot", "source", "rank")


def mix(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keep: Sequence[str] = (), max_epochs: int = MAX_EPOCHS, max_block: int = MAX_BLOCK_TOKENS, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their part of the mix, and the schedule.

    First: id, size (words; null text 0), source_size, target, taken (words that the mix takes of
    the row, repeats counted) and the columns of ``keep``.  Second: slot, source, rank, row, tokens:
    what each slot takes of which row, where ``row`` numbers the first table's rows.

    A null source is a source of its own.  Rows with the same id are told apart; of equal rows one
    may be taken more often than the other.  Sources without words have target 0; if there are no
    words at all, every target and taken is 0.  An empty table gives empty tables.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^" + SPACE[1:])), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("order"),
            F.struct(F.lit(0).alias("none"), *keep).alias("keep"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, max_epochs))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    block = min(max(total >> SLOT_BITS, 1), max_block)
    slots = schedule(targets, block)

    order = sized.where("size > 0").select("row", "source", "size", "order", F.substring("order", 1, 3).alias("bucket"))
    placed = running_total(order, "source", ["order", "row"], "bucket", "size", "start")
    # An epoch is needed as far as the target reaches, and one block more.
    goal = targets.select(F.col("source").alias("of"), "source_size", "target")
    epochs = F.least(F.lit(max_epochs), F.ceil((F.col("target") + block) / F.col("source_size"))).cast("int")
    streamed = (
        placed.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .select("row", "source", "size", "start", "source_size", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
        .select("row", "source", "size", (F.col("start") + F.col("epoch") * F.col("source_size")).alias("start"))
    )
    end = F.col("start") + F.col("size")
    pieces = streamed.select(
        "row", F.col("source").alias("of"), "start", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    ).select(
        "row", "of", "block",
        (F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("tokens"),
    )
    plan = slots.join(pieces, F.col("source").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("block"))).select(
        "slot", "source", "rank", "row", "tokens"
    )
    taken = plan.groupBy("row").agg(F.sum("tokens").alias("taken"))
    mixed = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .join(taken, "row", "left")
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col("keep")[c].alias(c) for c in keep],
        )
    )
    return mixed, plan
