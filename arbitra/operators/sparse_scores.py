"""Scores of reviews under primitives, where most reviews have no score under most primitives.

A gate finds few of all reviews.  Under one primitive all reviews that no gate has found share every
pool's lowest tie, hence one z.  ``SparseScores`` keeps a row per found (primitive, review) and one
counted row per primitive for all others; ranks, bins, quantiles, counts and top lists are computed
on those, so no step holds reviews x primitives.  ``dense`` writes that product out for whoever wants
to read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import global_row_number, prefix_totals, quantile_edges
from arbitra.session import dimension, materialize

POOLS = [("bm25", "pos"), ("bm25", "neg"), ("emb", "pos"), ("emb", "neg")]
KINDS = [f"{p}_{m}" for m, p in POOLS]


@dataclass(frozen=True)
class SparseScores:
    """``scored``: primitive_id, review_id, z[, bin], one row per pair; ``rest``: primitive_id, z, n[, bin],
    the n reviews of ``pool`` (review_id, business_id; one row per review) that have no row there.

    A table with a row for every pair is the case without ``rest`` and ``pool``.
    """

    scored: DataFrame
    rest: DataFrame | None = None
    pool: DataFrame | None = None

    def weighted(self) -> DataFrame:
        """primitive_id, z, w: every z with the number of reviews that have it by this row."""
        own = self.scored.select("primitive_id", "z", F.lit(1).cast("long").alias("w"))
        if self.rest is None:
            return own
        return own.unionByName(self.rest.where("n > 0").select("primitive_id", "z", F.col("n").alias("w")))

    def binned(self, bins: int) -> "SparseScores":
        """Adds ``bin``, the number of inner quantile edges below z, counting every review."""
        edges = quantile_edges(self.weighted(), ["primitive_id"], "z", bins, "w") if bins > 1 else None

        def placed(rows: DataFrame) -> DataFrame:
            if edges is None:
                return rows.withColumn("bin", F.lit(0))
            return rows.join(edges, "primitive_id").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("z")))).drop("edges")

        return replace(self, scored=placed(self.scored), rest=None if self.rest is None else placed(self.rest))

    def bin_sizes(self) -> DataFrame:
        """primitive_id, bin, n."""
        own = self.scored.groupBy("primitive_id", "bin").agg(F.count(F.lit(1)).alias("n"))
        if self.rest is None:
            return own
        return own.unionByName(self.rest.where("n > 0").select(*own.columns)).groupBy("primitive_id", "bin").agg(F.sum("n").alias("n"))

    def written(self) -> "SparseScores":
        return replace(self, scored=materialize(self.scored), rest=None if self.rest is None else materialize(self.rest))

    def looked_up(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows of (primitive_id, review_id, ...) with these columns of their scores; pairs that are in
        neither part are left out."""
        found = rows.join(self.scored.select("primitive_id", "review_id", *columns), ["primitive_id", "review_id"], "inner" if self.rest is None else "left")
        if self.rest is None:
            return found
        other = self.rest.select("primitive_id", *[F.col(c).alias(f"_rest_{c}") for c in columns])
        inside = found.join(self.pool.select("review_id"), "review_id", "left_semi").join(other, "primitive_id")
        return inside.withColumns({c: F.coalesce(c, f"_rest_{c}") for c in columns}).drop(*[f"_rest_{c}" for c in columns])

    def without(self, reviews: DataFrame) -> "SparseScores":
        """The same without these reviews (one column, review_id)."""
        scored = self.scored.join(reviews, "review_id", "left_anti")
        if self.rest is None:
            return SparseScores(scored)
        scored, pool = materialize(scored), materialize(self.pool.join(reviews, "review_id", "left_anti"))
        own = scored.groupBy("primitive_id").agg(F.count(F.lit(1)).alias("_own"))
        n = pool.agg(F.count(F.lit(1))).scalar() - F.coalesce("_own", F.lit(0))
        return SparseScores(scored, self.rest.join(own, "primitive_id", "left").withColumn("n", n).drop("_own"), pool)

    def dense(self, columns: Sequence[str] = ("z",)) -> DataFrame:
        """primitive_id, review_id and these columns for every pair.  Pairs come out of one row per
        review, so only reviews are exchanged."""
        if self.rest is None:
            return self.scored.select("primitive_id", "review_id", *columns)
        # A review has at most one entry per primitive.
        own = self.scored.groupBy("review_id").agg(
            F.map_from_entries(F.collect_list(F.struct("primitive_id", F.struct(*columns)))).alias("_own")
        )
        every = self.rest.agg(F.collect_list(F.struct("primitive_id", F.struct(*columns).alias("s")))).scalar()
        pairs = self.pool.select("review_id").join(own, "review_id", "left").select("review_id", "_own", F.explode(every).alias("e"))
        found = F.coalesce(F.try_element_at("_own", "e.primitive_id"), "e.s")
        return pairs.select(F.col("e.primitive_id").alias("primitive_id"), "review_id", found.alias("f")).select("primitive_id", "review_id", *[F.col(f"f.{c}").alias(c) for c in columns])

    def per_entity(self) -> DataFrame:
        """business_id, primitive_id[, bin], n, z: found reviews by bin with their best z, and where there
        are others one row with their z and bin."""
        by = ["bin"] if "bin" in self.scored.columns else []
        own = self.scored.join(self.pool.select("review_id", "business_id"), "review_id").groupBy("business_id", "primitive_id", *by).agg(
            F.count(F.lit(1)).alias("n"), F.max("z").alias("z")
        )
        own = materialize(own)
        held = own.groupBy("business_id", "primitive_id").agg(F.sum("n").alias("_held"))
        entities = self.pool.groupBy("business_id").agg(F.count(F.lit(1)).alias("_all"))
        every = self.rest.agg(F.collect_list(F.struct("primitive_id", "z", *by))).scalar()
        pairs = entities.select("business_id", "_all", F.explode(every).alias("e")).select("business_id", "_all", "e.*")
        others = pairs.join(held, ["business_id", "primitive_id"], "left").withColumn("n", F.col("_all") - F.coalesce("_held", F.lit(0)))
        return own.unionByName(others.where("n > 0").select(*own.columns))

    def first_unscored(self, k: int, order: Sequence[Column]) -> DataFrame:
        """primitive_id, review_id and the columns of ``rest``: per primitive the first k reviews in this
        order that have no row of their own.

        With reviews numbered in that order, the k-th such review of a primitive stands at place k plus
        the number of scored ones before it, so only as many places are looked at as there are scored rows.
        """
        numbered = materialize(global_row_number(self.pool, order, "_g").select("review_id", "_g"))
        own = materialize(self.scored.select("primitive_id", "review_id").join(numbered, "review_id").select("primitive_id", "_g"))
        before = prefix_totals(own, ["primitive_id"], "_g", {"_n": F.count(F.lit(1))})
        passed = before.where(F.col("_g") - 1 - F.col("before__n") < k).groupBy("primitive_id").agg(F.count(F.lit(1)).alias("_passed"))
        last = F.least(F.lit(k) + F.coalesce("_passed", F.lit(0)), numbered.agg(F.count(F.lit(1))).scalar())
        ends = self.rest.where("n > 0").drop("n").join(passed, "primitive_id", "left").withColumn("_last", last)
        places = ends.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last").cast("long"))).alias("_g")).drop("_passed", "_last")
        return places.join(own, ["primitive_id", "_g"], "left_anti").join(numbered, "_g").drop("_g")


def as_sparse(z: DataFrame | SparseScores) -> SparseScores:
    return z if isinstance(z, SparseScores) else SparseScores(z)


def contrast(gates: DataFrame, gate_scores: DataFrame, pool: DataFrame, primitive_ids: Sequence[str], gamma: float = 0.5) -> SparseScores:
    """z = max(rank of positive pools) - gamma * max(rank of negative pools).

    A review without a score in a pool counts there with 0, so an empty pool ranks 0.5 throughout.
    Those reviews enter the ranks as one row per pool with their number as weight.
    """
    spark = pool.sparkSession
    grid = dimension(spark, [(p, kind) for p in primitive_ids for kind in KINDS], "primitive_id string, kind string")
    members = gates.select("gate_id", F.concat_ws("_", "polarity", "modality").alias("kind"), F.explode("primitive_ids").alias("primitive_id"))
    wanted = members.join(grid, ["primitive_id", "kind"], "left_semi")
    inside = gate_scores.where("score IS NOT NULL").join(pool.select("review_id"), "review_id", "left_semi")
    best = materialize(
        inside.join(wanted, "gate_id").groupBy("primitive_id", "kind", "review_id").agg(F.max("score").alias("score"))
    )
    n = pool.agg(F.count(F.lit(1))).scalar()
    found = best.groupBy("primitive_id", "kind").agg(F.count(F.lit(1)).alias("_found"))
    missing = grid.join(found, ["primitive_id", "kind"], "left").select(
        "primitive_id", "kind", F.lit(0.0).alias("score"), (n - F.coalesce("_found", F.lit(0))).alias("w")
    )
    weighted = best.select("primitive_id", "kind", "score", F.lit(1).cast("long").alias("w")).unionByName(missing.where("w > 0"))
    table = prefix_totals(weighted, ["primitive_id", "kind"], "score", {"_n": F.sum("w")})
    rank = (F.col("before__n") + (F.col("_n") - 1) / 2) / F.greatest(F.col("total__n") - 1, F.lit(1))
    ranks = materialize(table.select("primitive_id", "kind", "score", rank.alias("r")))

    of = lambda kind, c="r": F.max(F.when(F.col("kind") == kind, F.col(c)))
    lowest = ranks.where("score = 0").groupBy("primitive_id").agg(*[of(kind).alias(f"_{kind}") for kind in KINDS])
    side = lambda p: F.greatest(*[F.col(kind) for kind in KINDS if kind.startswith(p)])
    z = (side("pos") - gamma * side("neg")).alias("z")
    own = best.join(ranks, ["primitive_id", "kind", "score"]).groupBy("primitive_id", "review_id").agg(*[of(kind).alias(kind) for kind in KINDS])
    filled = own.join(lowest, "primitive_id", "left").withColumns({kind: F.coalesce(kind, f"_{kind}") for kind in KINDS})
    scored = materialize(filled.select("primitive_id", "review_id", z))
    held = scored.groupBy("primitive_id").agg(F.count(F.lit(1)).alias("_held"))
    every = grid.select("primitive_id").distinct().join(lowest, "primitive_id", "left").join(held, "primitive_id", "left")
    rest = every.select("primitive_id", *[F.col(f"_{kind}").alias(kind) for kind in KINDS], "_held").select(
        "primitive_id", z, (n - F.coalesce("_held", F.lit(0))).alias("n")
    )
    return SparseScores(scored, materialize(rest), pool.select("review_id", "business_id"))
