"""Calibrated scores that decide which reviews to check next, and when to stop.

Long tables: ``gates`` (gate_id, primitive_ids, modality, polarity), ``gate_scores`` (gate_id,
review_id, score), ``pool`` (review_id, business_id), ``z`` (primitive_id, review_id, z[, bin]),
``tags`` (review_id, business_id, primitive_id, y).  Wherever a ``z`` is taken it may also be a
``SparseScores``, which has no rows for pairs that no gate has found.  ``primitives`` is configuration: a list of
``{"primitive_id", "label", "conditions", "min_count", "logic"}``; ``rules`` a list of
``{"label", "connective", "primitive_ids"}``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions import scoring as sc
from arbitra.functions.conditions import event_matches
from arbitra.functions.ranking import prefix_totals, quantile_bins, quantiles, top_per_key
from arbitra.operators.sparse_scores import SparseScores, as_sparse
from arbitra.operators.sparse_scores import contrast as sparse_contrast
from arbitra.session import dimension, materialize


def _literal_rows(*structs: Column) -> Column:
    return F.explode(F.array(*structs))


def max_pool(gates: DataFrame, gate_scores: DataFrame) -> DataFrame:
    """Best score per (primitive, modality, polarity, review) of the scored reviews."""
    members = gates.select("gate_id", "modality", "polarity", F.explode("primitive_ids").alias("primitive_id"))
    return (
        gate_scores.join(members, "gate_id")
        .groupBy("primitive_id", "modality", "polarity", "review_id")
        .agg(F.max("score").alias("score"))
    )


def contrast(
    gates: DataFrame, gate_scores: DataFrame, pool: DataFrame, primitive_ids: Sequence[str], gamma: float = 0.5
) -> DataFrame:
    """Z of every (primitive, review) pair, written out from its sparse form."""
    return sparse_contrast(gates, gate_scores, pool, primitive_ids, gamma).dense()


def binned(z: DataFrame | SparseScores, bins: int) -> DataFrame | SparseScores:
    """W7 per primitive."""
    return z.binned(bins) if isinstance(z, SparseScores) else quantile_bins(z, ["primitive_id"], "z", bins, "bin")


def score_statistics(z: DataFrame | SparseScores) -> DataFrame:
    """Min, mean, p50, p90, max of z per primitive."""
    every = as_sparse(z).weighted()
    plain = every.groupBy("primitive_id").agg(
        F.min("z").alias("z_min"), (F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z_mean"), F.max("z").alias("z_max")
    )
    q = quantiles(every, ["primitive_id"], "z", [0.5, 0.9], "w").groupBy("primitive_id").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("z_p50"),
        F.max(F.when(F.col("p") == 0.9, F.col("quantile"))).alias("z_p90"),
    )
    return plain.join(q, "primitive_id")


def top_reviews(z: DataFrame | SparseScores, n: int = 10) -> DataFrame:
    """T4."""
    z = as_sparse(z)
    rows = z.scored.select("primitive_id", "review_id", "z")
    if z.rest is not None:
        rows = rows.unionByName(z.first_unscored(n, [F.col("review_id")]).select(*rows.columns))
    return top_per_key(rows, ["primitive_id"], [F.desc("z"), F.col("review_id")], n, "rank")


def entity_ranks(z: DataFrame | SparseScores, pool: DataFrame) -> DataFrame:
    """Rank of each entity by its best z, per primitive; equal scores share a rank."""
    if isinstance(z, SparseScores):
        best = z.per_entity().groupBy("primitive_id", "business_id").agg(F.max("z").alias("max_z"))
    else:
        best = z.join(pool.select("review_id", "business_id"), "review_id").groupBy("primitive_id", "business_id").agg(F.max("z").alias("max_z"))
    keyed = best.withColumn("_neg", -F.col("max_z"))
    table = prefix_totals(keyed, ["primitive_id"], "_neg", {"_n": F.count(F.lit(1))})
    ranks = table.select("primitive_id", "_neg", (F.col("before__n") + 1).alias("rank"))
    return keyed.join(ranks, ["primitive_id", "_neg"]).drop("_neg")


def positive_entities(truth: DataFrame) -> DataFrame:
    """F21."""
    return truth.where(~F.col("verdict").isin("Low Risk", "Unknown"))


def positive_ranks(z: DataFrame | SparseScores, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranks of the entities with a positive true verdict."""
    return entity_ranks(z, pool).join(positive_entities(truth).select("business_id", "verdict"), "business_id")


def event_tags(reviews: DataFrame, primitives: Sequence[Mapping]) -> DataFrame:
    """Matching events per (review, primitive), zero counts included.

    ``events`` is array<struct<event_id, snippet, fields map<string, array<string>>>>.
    """
    def tagged(p: Mapping) -> Column:
        match = lambda e: event_matches(e["fields"], p["conditions"], p.get("logic", "ALL"))
        events = F.filter(F.coalesce("events", F.array().cast(reviews.schema["events"].dataType)), match)
        return F.struct(
            F.lit(p["primitive_id"]).alias("primitive_id"), F.size(events).alias("y"), events.alias("evidence")
        )

    return reviews.select(
        "review_id", "business_id", _literal_rows(*[tagged(p) for p in primitives]).alias("t")
    ).select("review_id", "business_id", "t.primitive_id", "t.y", "t.evidence")


def verdict_evidence(tags: DataFrame, verdicts: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """F20, tag form: events behind the verdict's rule, one row per field value."""
    spark = tags.sparkSession
    members = dimension(spark, [(r["label"], p) for r in rules for p in r["primitive_ids"]], "verdict string, primitive_id string")
    wanted = verdicts.select("business_id", "verdict").join(members, "verdict")
    rows = tags.where(F.col("y") > 0).join(wanted, ["business_id", "primitive_id"])
    events = rows.select("business_id", "review_id", "primitive_id", F.explode("evidence").alias("e"))
    fields = events.select(
        "business_id", "review_id", "primitive_id", "e.event_id", "e.snippet",
        F.explode_outer("e.fields").alias("field", "values"),
    )
    return fields.select("*", F.explode_outer("values").alias("judgement")).drop("values")


def calibrate(
    tags: DataFrame, z: DataFrame | SparseScores, primitive_ids: Sequence[str], bins: int, delta: float | None = None
) -> DataFrame:
    """A23 + J21: Beta counts per (primitive, bin) with the current bins of verified reviews.

    theta is the mean; with ``delta`` an upper confidence bound ``u`` is added (X24), otherwise
    ``u`` is theta.  Bins without tags keep the uniform prior.
    """
    current = as_sparse(z).looked_up(tags.select("primitive_id", "review_id", "y"), ["bin"])
    counted = current.groupBy("primitive_id", "bin").agg(
        F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg")
    )
    grid = dimension(
        tags.sparkSession, [(p, b) for p in primitive_ids for b in range(bins)], "primitive_id string, bin int"
    )
    full = grid.join(counted, ["primitive_id", "bin"], "left")
    alpha, beta = 1.0 + F.coalesce("pos", F.lit(0)), 1.0 + F.coalesce("neg", F.lit(0))
    out = full.select("primitive_id", "bin", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("theta"))
    bound = sc.beta_upper(F.col("alpha"), F.col("beta"), delta) if delta is not None else F.col("theta")
    return out.withColumn("u", bound)


def positive_counts(tags: DataFrame) -> DataFrame:
    """A24."""
    return tags.where(F.col("y") > 0).groupBy("business_id", "primitive_id").agg(F.sum("y").alias("n"))


def tag_summary(tags: DataFrame) -> DataFrame:
    """Tags, positives and negatives per primitive."""
    return tags.groupBy("primitive_id").agg(
        F.count(F.lit(1)).alias("tags"), F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg")
    )


def gate_summary(gates: DataFrame) -> DataFrame:
    """Gates per primitive and kind."""
    return gates.select(F.explode("primitive_ids").alias("primitive_id"), "modality", "polarity").groupBy(
        "primitive_id", "modality", "polarity"
    ).agg(F.count(F.lit(1)).alias("gates"))


def _rule_members(rules: Sequence[Mapping], primitives: Sequence[Mapping]) -> list[tuple]:
    need = {p["primitive_id"]: p.get("min_count") or 1 for p in primitives}
    return [
        (order, r["label"], r.get("connective", "ANY"), p, need.get(p, 1))
        for order, r in enumerate(rules)
        for p in r["primitive_ids"]
    ]


def _entity_rules(entities: DataFrame, counts: DataFrame, rules, primitives) -> DataFrame:
    """One row per (entity, rule, primitive) with its positive count and deficit."""
    members = [
        F.struct(
            F.lit(o).alias("rule_ord"), F.lit(label).alias("label"), F.lit(c).alias("connective"),
            F.lit(p).alias("primitive_id"), F.lit(n).alias("min_count"),
        )
        for o, label, c, p, n in _rule_members(rules, primitives)
    ]
    grid = entities.select("business_id", _literal_rows(*members).alias("m")).select("business_id", "m.*")
    return (
        grid.join(counts, ["business_id", "primitive_id"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("deficit", F.greatest(F.lit(0), F.col("min_count") - F.col("n")))
    )


def rule_verdicts(entities: DataFrame, counts: DataFrame, rules, primitives) -> DataFrame:
    """Label of the first rule (in the given order) that the counts satisfy, else null."""
    grid = _entity_rules(entities, counts, rules, primitives)
    met = F.col("deficit") == 0
    per_rule = grid.groupBy("business_id", "rule_ord", "label").agg(
        F.when(F.first("connective") == "ALL", F.bool_and(met)).otherwise(F.bool_or(met)).alias("ok")
    )
    return per_rule.groupBy("business_id").agg(
        F.min_by("label", F.when(F.col("ok"), F.col("rule_ord"))).alias("_l"), F.bool_or("ok").alias("_any")
    ).select("business_id", F.when(F.col("_any"), F.col("_l")).alias("verdict"))


def unverified(z: DataFrame | SparseScores, tags: DataFrame) -> DataFrame | SparseScores:
    """Scores of reviews without any tag."""
    verified = tags.select("review_id").distinct()
    return z.without(verified) if isinstance(z, SparseScores) else z.join(verified, "review_id", "left_anti")


def bin_counts(open_z: DataFrame | SparseScores, pool: DataFrame) -> DataFrame:
    """Unverified reviews per (entity, primitive, bin)."""
    key = ["business_id", "primitive_id", "bin"]
    if isinstance(open_z, SparseScores):
        return open_z.per_entity().groupBy(*key).agg(F.sum("n").alias("n"))
    placed = open_z.join(pool.select("review_id", "business_id"), "review_id")
    return placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def bin_counts_all(open_z: DataFrame | SparseScores, pool: DataFrame) -> DataFrame:
    """A27 in one pass: per entity and over all entities (business_id null)."""
    return bin_counts(open_z, pool).groupingSets(
        [[F.col("primitive_id"), F.col("bin"), F.col("business_id")], [F.col("primitive_id"), F.col("bin")]],
        F.col("primitive_id"), F.col("bin"), F.col("business_id"),
    ).agg(F.sum("n").alias("n"))


def default_bound(
    entities: DataFrame, counts: DataFrame, open_bins: DataFrame, calibration: DataFrame, rules, primitives
) -> DataFrame:
    """Bound on the chance that unverified reviews still overturn the default verdict.

    Works on bin counts, not on reviews.  Clauses that are met drop out; a bin without
    calibration counts with 1.
    """
    mu = (
        open_bins.join(calibration.select("primitive_id", "bin", "u"), ["primitive_id", "bin"], "left")
        .groupBy("business_id", "primitive_id")
        .agg(F.sum(F.col("n") * F.coalesce("u", F.lit(1.0))).alias("mu"))
    )
    grid = _entity_rules(entities, counts, rules, primitives).join(mu, ["business_id", "primitive_id"], "left")
    part = F.when(
        F.col("deficit") > 0, F.least(F.lit(1.0), F.coalesce("mu", F.lit(0.0)) / F.col("deficit"))
    )
    per_rule = grid.groupBy("business_id", "rule_ord").agg(
        F.when(F.first("connective") == "ALL", F.min(part)).otherwise(F.least(F.lit(1.0), F.sum(part))).alias("rho")
    )
    return per_rule.groupBy("business_id").agg(
        F.least(F.lit(1.0), F.sum(F.coalesce("rho", F.lit(0.0)))).alias("rho")
    )


def stop_check(verdicts: DataFrame, bounds: DataFrame, default_label: str, epsilon: float = 0.01, exhausted: bool = False) -> DataFrame:
    """Verdict and reason per entity; an entity that must go on has a null verdict."""
    joined = verdicts.join(bounds, "business_id", "left")
    found, low = F.col("verdict").isNotNull(), F.col("rho") <= epsilon
    reason = F.when(found, "rule_satisfied").when(low, "bound")
    verdict = F.when(found, F.col("verdict")).when(low, F.lit(default_label))
    if exhausted:
        reason, verdict = reason.otherwise("exhausted"), verdict.otherwise(F.lit(default_label))
    return joined.select("business_id", verdict.alias("verdict"), reason.alias("stop_reason"), "rho")


def candidate_scores(
    open_z: DataFrame | SparseScores, pool: DataFrame, counts: DataFrame, calibration: DataFrame,
    primitives: Sequence[Mapping], label_order: Sequence[str],
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), mask: DataFrame | None = None,
) -> DataFrame:
    """T6, scores: hunt + local + global value of checking each unverified review.

    hunt: best positive z of an unmet clause of the most severe label; local and global: share
    of the review's bin in its entity and overall, times the expected variance drop.

    A review starts from its entity's sums over the bins of unfound reviews and corrects them for
    the primitives whose gates have found it.  ``top_primitive`` has the largest z, of equal ones
    the least id.
    """
    rank = {label: i for i, label in enumerate(label_order)}
    worst = min(rank.get(p["label"], 999) for p in primitives)
    dims = dimension(
        pool.sparkSession,
        [
            (p["primitive_id"], p.get("min_count") or 1, rank.get(p["label"], 999) == worst,
             math.exp(-rank.get(p["label"], 999)))
            for p in primitives
        ],
        "primitive_id string, min_count int, top boolean, w double",
    )
    z = as_sparse(open_z)
    reviews = z.pool if z.rest is not None else pool.join(z.scored.select("review_id").distinct(), "review_id", "left_semi")
    reviews = reviews.select("review_id", "business_id")
    local = materialize(bin_counts(open_z, pool).withColumnRenamed("n", "c_local"))
    overall = local.groupBy("primitive_id", "bin").agg(F.sum("c_local").alias("c_all"))
    per_entity = reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("open_local"))
    total = reviews.agg(F.count(F.lit(1))).scalar()
    drop = calibration.select("primitive_id", "bin", sc.variance_drop(F.col("alpha"), F.col("beta")).alias("dv"))
    cells = (
        local.join(overall, ["primitive_id", "bin"])
        .join(drop, ["primitive_id", "bin"])
        .join(per_entity, "business_id")
        .join(dims, "primitive_id")
        .join(counts, ["business_id", "primitive_id"], "left")
    )
    unmet = F.col("top") & (F.col("min_count") > F.coalesce("n", F.lit(0)))
    cells = materialize(cells.select(
        "business_id", "primitive_id", "bin",
        F.when(unmet, F.col("w")).otherwise(F.lit(0.0)).alias("hunt_w"),
        (F.col("c_local") / F.col("open_local") * F.col("dv")).alias("v_local"),
        (F.col("c_all") / F.greatest(total, F.lit(1)) * F.col("dv")).alias("v_global"),
    ))
    hunt = F.greatest(F.lit(0.0), F.col("z")) * F.col("hunt_w")
    own = z.scored.join(reviews, "review_id").join(cells, ["business_id", "primitive_id", "bin"]).withColumn("v_hunt", hunt)
    none = F.lit(0.0)
    if z.rest is None:
        own = own.withColumns({"rest_local": none, "rest_global": none})
    else:
        others = z.rest.drop("n").join(cells, ["primitive_id", "bin"]).withColumn("v_hunt", hunt)
        taken_back = others.select("business_id", "primitive_id", F.col("v_local").alias("rest_local"), F.col("v_global").alias("rest_global"))
        own = own.join(taken_back, ["business_id", "primitive_id"], "left")
        # One entry per primitive: the best hunt first.
        base = others.groupBy("business_id").agg(
            F.sum("v_local").alias("base_local"), F.sum("v_global").alias("base_global"),
            F.array_sort(F.collect_list(F.struct((-F.col("v_hunt")).alias("h"), "primitive_id"))).alias("hunts"),
        )
        tops = z.rest.agg(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("z"), F.col("primitive_id").alias("p"))))).scalar()
    mine = own.groupBy("review_id").agg(
        F.max("v_hunt").alias("own_hunt"), F.sum("v_local").alias("own_local"), F.sum("v_global").alias("own_global"),
        F.sum(F.coalesce("rest_local", none)).alias("less_local"), F.sum(F.coalesce("rest_global", none)).alias("less_global"),
        F.collect_set("primitive_id").alias("found"), F.min(F.struct((-F.col("z")).alias("z"), F.col("primitive_id").alias("p"))).alias("own_top"),
    )
    rows = reviews.join(mine, "review_id", "inner" if z.rest is None else "left")
    if z.rest is None:
        scored = rows.select(
            "review_id", "business_id", F.col("own_hunt").alias("v_hunt"), F.col("own_local").alias("v_local"),
            F.col("own_global").alias("v_global"), F.col("own_top.p").alias("top_primitive"),
        )
    else:
        rows = rows.join(base, "business_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
        # Of a sorted list, the first entry that is not found is among the first size(found) + 1.
        first = lambda entries, of: F.get(F.filter(F.slice(entries, 1, F.size("found") + 1), lambda e: ~F.array_contains("found", of(e))), 0)
        other_hunt = -first(F.col("hunts"), lambda e: e["primitive_id"])["h"]
        value = lambda c: F.coalesce(f"base_{c}", none) - F.coalesce(f"less_{c}", none) + F.coalesce(f"own_{c}", none)
        scored = rows.withColumn("_tops", tops).select(
            "review_id", "business_id", F.coalesce(F.greatest(F.col("own_hunt"), other_hunt), none).alias("v_hunt"),
            value("local").alias("v_local"), value("global").alias("v_global"),
            F.least(F.col("own_top"), first(F.col("_tops"), lambda e: e["p"]))["p"].alias("top_primitive"),
        )
    h, lo, g = weights
    score = h * F.col("v_hunt") + lo * F.col("v_local") + g * F.col("v_global")
    if mask is not None:
        scored = scored.join(mask, "review_id", "left")
        score = score * (0.1 + 0.9 * F.coalesce("mask", F.lit(0.0)))
    return scored.withColumn("score", score)


def _first_per_bin(z: SparseScores, free: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """primitive_id, bin, reviews: the first k free reviews of each bin."""
    key = ["primitive_id", "bin"]
    rows = z.scored.select(*key, "review_id").join(free, "review_id")
    if z.rest is not None:
        unfound = SparseScores(z.scored, z.rest, free).first_unscored(k, order)
        rows = rows.unionByName(unfound.select(*key, "review_id").join(free, "review_id"))
    listed = top_per_key(rows, key, order, k)
    return listed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "review_id"))), lambda r: r["review_id"]).alias("reviews"))


def _one_per_bin(lists: DataFrame, bins: DataFrame, order: Column, n: Column | int) -> DataFrame:
    """place, review_id: bins in order each give their first review that no bin before took, up to n.

    One row holds the lists: primitives x bins x the k reviews of each, whatever the data.
    """
    rows = lists.join(bins, ["primitive_id", "bin"]).select(F.struct(order.alias("o"), "primitive_id", "bin", "reviews").alias("b"))
    limit = n if isinstance(n, Column) else F.lit(n)
    one = rows.agg(F.array_sort(F.collect_list("b")).alias("bins")).withColumn("n", limit)
    nothing = F.array().cast("array<string>")
    grown = lambda taken, b: F.when(F.size(taken) >= F.col("n"), taken).otherwise(
        F.concat(taken, F.slice(F.filter(b["reviews"], lambda r: ~F.array_contains(taken, r)), 1, 1))
    )
    return one.select(F.posexplode(F.aggregate("bins", nothing, grown)).alias("place", "review_id"))


def select_batch(
    scores: DataFrame, open_z: DataFrame | SparseScores, calibration: DataFrame, max_reviews: int,
    explore_frac: float = 0.2, coverage: int = 5, seed: int = 0, focus_business: str | None = None,
) -> DataFrame:
    """The next reviews to check, as (pick, review_id, stage).

    Stages in order: closeout of one stalled business, coverage of the bins with most expected
    variance drop, exploit by score, explore of sparse bins in hash order.  A pick excludes the
    review from later stages.  Each stage is a query over the reviews that the written picks of
    the stages before leave free; picks never pass through the driver.
    """
    spark = scores.sparkSession
    z = as_sparse(open_z)
    scores = materialize(scores.select("review_id", "business_id", "score"))
    by_score = [F.desc("score"), F.col("review_id")]
    hashed = [F.md5(F.concat_ws(":", F.lit(str(seed)), "review_id")), F.col("review_id")]
    key = ["primitive_id", "bin"]
    dv = sc.variance_drop(F.col("alpha"), F.col("beta"))
    bins = materialize(z.bin_sizes().join(calibration.select(*key, dv.alias("dv")), key))
    schema = "stage_no int, place int, review_id string, stage string"
    picks = spark.createDataFrame([], schema)

    def picked(rows: DataFrame, number: int, stage: str) -> DataFrame:
        named = rows.select(F.lit(number).alias("stage_no"), F.col("place").cast("int").alias("place"), "review_id", F.lit(stage).alias("stage"))
        return materialize(picks.unionByName(named))

    def free() -> DataFrame:
        return scores.join(picks.select("review_id"), "review_id", "left_anti")

    def head(rows: DataFrame, n: int) -> DataFrame:
        """The first n by score, numbered: the window sees n rows."""
        return rows.orderBy(*by_score).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*by_score)))

    left = lambda n: F.lit(n) - picks.agg(F.count(F.lit(1))).scalar()
    if focus_business is not None:
        picks = picked(head(scores.where(F.col("business_id") == focus_business), max(1, max_reviews // 4)), 0, "closeout")
    if coverage:
        lists = _first_per_bin(z, free(), by_score, coverage)
        picks = picked(_one_per_bin(lists, bins, -F.col("n") * F.col("dv"), coverage), 1, "coverage")
    n_explore = int(max_reviews * explore_frac)
    picks = picked(head(free(), max_reviews).where(F.col("place") <= left(max_reviews - n_explore)), 2, "exploit")
    if n_explore:
        lists = _first_per_bin(z, free(), hashed, n_explore)
        picks = picked(_one_per_bin(lists, bins, F.col("n"), left(max_reviews)), 3, "explore")
    in_order = Window.orderBy("stage_no", "place")
    return picks.withColumn("pick", F.row_number().over(in_order)).where(F.col("pick") <= max_reviews).select("pick", "review_id", "stage")


def discovery_examples(tags: DataFrame, z: DataFrame | SparseScores, reviews: DataFrame, n: int = 5, q: float = 0.7) -> DataFrame:
    """Up to n positive snippets and n hard-negative texts per primitive.

    Hard negatives are verified negatives whose z reaches the q-quantile.
    """
    positive = (
        tags.where(F.col("y") > 0)
        .select("primitive_id", "review_id", F.explode("evidence").alias("e"))
        .where(F.coalesce(F.col("e.snippet"), F.lit("")) != "")
        .select("primitive_id", "review_id", F.lit("positive").alias("kind"), F.col("e.snippet").alias("snippet"))
    )
    z = as_sparse(z)
    at = quantiles(z.weighted(), ["primitive_id"], "z", [q], "w").select("primitive_id", F.col("quantile").alias("threshold"))
    negative = (
        z.looked_up(tags.where(F.col("y") == 0).select("primitive_id", "review_id"), ["z"])
        .join(at, "primitive_id")
        .where(F.col("z") >= F.col("threshold"))
        .join(reviews.select("review_id", "text"), "review_id")
        .select("primitive_id", "review_id", F.lit("negative").alias("kind"), F.col("text").alias("snippet"))
    )
    both = positive.unionByName(negative)
    return top_per_key(both, ["primitive_id", "kind"], [F.col("review_id"), F.col("snippet")], n)
