"""Choosing a balanced set of businesses over (topic, severity) cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import global_row_number, top_per_key
from arbitra.session import materialize

def cells_per_business(hits: DataFrame) -> DataFrame:
    """Sorted cell list, counts and total value per business.

    ``hits`` has one row per (topic, business) with severity and peak scores; a critical row is
    worth its critical peak and a high row its high peak.
    """
    worth = F.when(
        F.col("severity") == "critical", F.coalesce("max_critical_score", F.lit(0.0))
    ).otherwise(F.coalesce("max_high_score", F.lit(0.0)))
    # A business holds at most one entry per cell of the topic dictionary.
    held = hits.groupBy("business_id").agg(
        F.sort_array(F.collect_set(F.struct("topic", "severity"))).alias("cells"),
        F.sum(worth).alias("total_value"),
    )
    topics = F.array_distinct(F.transform("cells", lambda c: c["topic"]))
    return held.select(
        "business_id", "cells", F.size("cells").alias("cell_count"),
        F.size(topics).alias("topic_count"), "total_value",
    )


def cell_histogram(cells: DataFrame) -> DataFrame:
    """A5: how many businesses cover how many cells."""
    return cells.groupBy("cell_count").agg(F.count(F.lit(1)).alias("businesses"))


def cell_coverage(cells: DataFrame, all_cells: DataFrame) -> DataFrame:
    """A5: businesses per cell, cells that nobody covers included with 0."""
    held = (
        cells.select(F.explode("cells").alias("c"))
        .groupBy(F.col("c.topic").alias("topic"), F.col("c.severity").alias("severity"))
        .agg(F.count(F.lit(1)).alias("businesses"))
    )
    return all_cells.join(held, ["topic", "severity"], "left").withColumn(
        "businesses", F.coalesce("businesses", F.lit(0))
    )


def coverage_levels(coverage: DataFrame) -> DataFrame:
    """A5: least and most covered level over all cells."""
    return coverage.agg(
        F.min("businesses").alias("min_level"), F.max("businesses").alias("max_level")
    )


def rank_by_coverage(cells: DataFrame) -> DataFrame:
    """Global rank by (cells, value) falling, business id on ties."""
    return global_row_number(
        cells, [F.desc("cell_count"), F.desc("total_value"), F.col("business_id")], "global_rank"
    )


def with_rank(selected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rank joined back onto a selection, best first."""
    return selected.join(ranked.select("business_id", "global_rank"), "business_id").orderBy(
        "global_rank"
    )


def greedy_cover(cells: DataFrame, all_cells: Sequence[tuple[str, str]], target: int = 100, window: int = 2_000) -> DataFrame:
    """T5: layered greedy cover; returns (pick, business_id, level) in pick order.

    Level n wants every cell to be held by n picks.  Each pick takes the business that helps
    the most cells still short of the level, then the larger value, then the smaller id; a
    level that nobody can help is left behind.

    Lazy greedy: within a level the gain of a business only falls, so its gain at some point bounds
    all later ones.  A query takes the first ``window`` businesses by gain, value and id; picks are
    made among those, in Spark, while they stay ahead of what the last of them had at that point.
    Then the next query starts from the gains as they are by then.  Of businesses with the same
    cells only the next unpicked one by (value, id) can win, so ``target`` rows per cell set are an
    exact reduction.  Picks are written after each query; the driver sees how many cells each of
    the dictionary's cells is short of, no candidates.
    """
    spark = cells.sparkSession
    names = [f"{t}|{s}" for t, s in dict.fromkeys(all_cells)]
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.lit(None).cast("map<string,int>")
    own = F.array_sort(F.array_compact(F.transform("cells", lambda c: place[F.concat_ws("|", c["topic"], c["severity"])])))
    order = [F.desc("total_value"), F.col("business_id")]
    useful = cells.select("business_id", "total_value", F.array_distinct(own).alias("own")).where(F.size("own") > 0)
    keyed = useful.withColumn("_sig", F.array_join(F.col("own").cast("array<string>"), ","))
    heads = materialize(top_per_key(keyed, ["_sig"], order, target).select("business_id", "total_value", "own"))

    schema = "pick int, business_id string, level int"
    picks, done, held, level = spark.createDataFrame([], schema), 0, [0] * len(names), 1
    while names and done < target and level <= target:
        rest = heads.join(picks.select("business_id"), "business_id", "left_anti")
        short = F.array(*[F.lit(n < level) for n in held])
        gain = F.size(F.filter("own", lambda c: F.get(short, c)))
        first = rest.withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), *order).limit(window)
        found = materialize(_cover_steps(first, held, level, target - done, window))
        state = found.select("held", "all_seen", F.size("taken").alias("n")).first()
        if state is not None and state["n"]:
            new = found.select(F.posexplode("taken").alias("i", "business_id"), F.lit(level).alias("level"))
            picks = materialize(picks.unionByName(new.select((F.col("i") + done + 1).cast("int").alias("pick"), "business_id", "level")))
            done, held = done + state["n"], list(state["held"])
            if state["all_seen"]:
                level += 1
            continue
        # Nobody helps at this level: the next one at which an unpicked business does.
        lowest = F.array_min(F.transform("own", lambda c: F.get(F.array(*[F.lit(n) for n in held]), c)))
        ahead = rest.agg(F.min(lowest).alias("n")).first()["n"]
        if ahead is None:
            break
        level = max(level + 1, ahead + 1)
    return picks


def _cover_steps(first: DataFrame, held: list[int], level: int, wanted: int, window: int):
    """One row: taken (ids in order), held after them, and whether the level has no more to give.

    Candidates stand in the order of gain, value and id, so of equal gains the first by value and id
    is found by its place in that second order.
    """
    ranked = first.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), (-F.col("total_value")).alias("v"), F.col("business_id").alias("id"), "own"))).alias("c")
    )
    # The order among equal gains: by value, then id.
    by_value = F.transform(F.array_sort(F.transform("c", lambda x: F.struct(x["v"].alias("v"), x["id"].alias("id"), x["own"].alias("own")))), lambda x: F.struct(x["id"].alias("id"), x["own"].alias("own"), x["v"].alias("v")))
    rows = ranked.where(F.size("c") > 0).select(
        by_value.alias("c"), F.when(F.size("c") >= window, F.element_at("c", -1)).alias("bound"),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("taken"), F.array(*[F.lit(n) for n in held]).cast("array<int>").alias("held"),
        F.lit(True).alias("going"), F.lit(False).alias("all_seen"),
    )

    def step(state: Column, _: Column) -> Column:
        helped = lambda x: F.size(F.filter(x["own"], lambda c: F.get(state["held"], c) < level))
        # The least of (falling gain, place by value and id); taken ones help no more.
        best = F.array_min(F.transform("c", lambda x, i: F.struct(
            F.when(F.array_contains(state["taken"], x["id"]), 0).otherwise(-helped(x)).alias("g"), i.alias("i"))))
        chosen = F.get("c", best["i"])
        ahead = F.col("bound").isNull() | (
            F.struct(best["g"], chosen["v"], chosen["id"]) <= F.struct(F.col("bound.g"), F.col("bound.v"), F.col("bound.id"))
        )
        some = best["g"] < 0
        grown = F.transform(state["held"], lambda n, i: n + F.array_contains(chosen["own"], i.cast("int")).cast("int"))
        took = F.struct(F.concat(state["taken"], F.array(chosen["id"])).alias("taken"), grown.alias("held"), F.lit(True).alias("going"), F.lit(False).alias("all_seen"))
        stopped = F.struct(state["taken"].alias("taken"), state["held"].alias("held"), F.lit(False).alias("going"), (~some & F.col("bound").isNull()).alias("all_seen"))
        return F.when(~state["going"], state).when(some & ahead, took).otherwise(stopped)

    most = min(wanted, len(held)) + 1
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, i: F.when(F.size(s["taken"]) >= wanted, s).otherwise(step(s, i)))
    return rows.select(folded.alias("s")).select("s.taken", "s.held", "s.all_seen")


def sample_slice(
    samples: DataFrame, ids: Sequence[str] | None = None, skip: int = 0, n: int | None = None,
    order: str = "pos", seed: int | None = None,
) -> DataFrame:
    """given ids win over skip/n; a seed shuffles by hash before slicing."""
    if ids:
        return samples.where(F.col("sample_id").isin(list(ids)))
    by = [F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id"))] if seed is not None else []
    out = samples.orderBy(*by, order).offset(skip)
    return out if n is None else out.limit(n)


def sample_per_verdict(verdicts: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """N entities per (policy, k, verdict), in the order of a seeded hash."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("business_id"))), F.col("business_id")]
    return top_per_key(verdicts, ["policy_id", "k", "verdict"], order, n)
