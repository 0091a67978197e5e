"""Gate scores, calibration, bounds, batch selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import active as ac
from arbitra.plans import adapters as ad
from arbitra.plans import catalog as cat
from arbitra.plans.registry import longs, query, r6


def z_table(spark, sf):
    return ad.sparse_z(spark, sf)


def binned(spark, sf):
    return ac.binned(z_table(spark, sf), cat.BINS).written()


def tags(spark, sf):
    return ac.event_tags(ad.tagged_reviews(spark, sf), cat.PRIMITIVES)


def calibration(spark, sf, zb=None, delta=None):
    z = binned(spark, sf) if zb is None else zb
    return ac.calibrate(tags(spark, sf), z, cat.PRIMITIVE_IDS, cat.BINS, delta)


def entities(spark, sf):
    return ad.businesses(spark, sf).select("business_id")


@query("gate_max_pool", ["bm25", "gate_members"], """
    SELECT primitive_id, modality, polarity, review_id, ROUND(MAX(score), 5) AS score FROM gate_members JOIN bm25 ON query_id = gate_id GROUP BY primitive_id, modality, polarity, review_id""")
def _(spark, sf):
    """A21."""
    out = ac.max_pool(ad.gates(spark), ad.gate_scores(spark, sf))
    return out.select("primitive_id", "modality", "polarity", "review_id", F.round("score", 5).alias("score"))


@query("contrast_score", ["z"], "SELECT primitive_id, review_id, ROUND(z, 6) AS z FROM z")
def _(spark, sf):
    """A22, W6."""
    return z_table(spark, sf).dense().select("primitive_id", "review_id", r6("z"))


@query("quantile_bins", [], """
    SELECT doc_id, len(list_filter(edges, lambda e: e < n_chars)) AS bin FROM documents JOIN (SELECT lang, quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS edges FROM documents GROUP BY lang) USING (lang)""")
def _(spark, sf):
    """W7."""
    from arbitra.functions.ranking import quantile_bins

    docs = ad.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return quantile_bins(docs, ["lang"], "n_chars", 4, "bin").select("doc_id", *longs("bin"))


@query("score_bins", ["zb"], "SELECT primitive_id, bin, COUNT(*) AS n FROM zb GROUP BY primitive_id, bin")
def _(spark, sf):
    """W7 over z."""
    return binned(spark, sf).bin_sizes()


@query("score_statistics", ["z"], """
    SELECT primitive_id, ROUND(MIN(z), 6) AS z_min, ROUND(AVG(z), 6) AS z_mean, ROUND(MAX(z), 6) AS z_max, ROUND(quantile_cont(z, 0.5), 6) AS z_p50, ROUND(quantile_cont(z, 0.9), 6) AS z_p90 FROM z GROUP BY primitive_id""")
def _(spark, sf):
    """A28."""
    out = ac.score_statistics(z_table(spark, sf))
    return out.select("primitive_id", *[r6(c) for c in ("z_min", "z_mean", "z_max", "z_p50", "z_p90")])


@query("top_reviews_by_score", ["z"], """
    SELECT primitive_id, rank, review_id, ROUND(z, 6) AS z FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY primitive_id ORDER BY z DESC, review_id) AS rank FROM z) WHERE rank <= 10""")
def _(spark, sf):
    """T4."""
    return ac.top_reviews(z_table(spark, sf)).select("primitive_id", *longs("rank"), "review_id", r6("z"))


@query("entity_ranks", ["z", "reviews"], """
    SELECT primitive_id, business_id, ROUND(m, 6) AS max_z, RANK() OVER (PARTITION BY primitive_id ORDER BY m DESC) AS rank FROM (
        SELECT primitive_id, business_id, MAX(z) AS m FROM z JOIN reviews USING (review_id) GROUP BY primitive_id, business_id)""")
def _(spark, sf):
    """W9."""
    return ac.entity_ranks(z_table(spark, sf), ad.pool(spark, sf)).select("primitive_id", "business_id", r6("max_z"), *longs("rank"))


@query("positive_entity_ranks", ["z", "reviews", "verdicts"], """
    SELECT primitive_id, business_id, rank, verdict FROM (
        SELECT primitive_id, business_id, RANK() OVER (PARTITION BY primitive_id ORDER BY m DESC) AS rank FROM (
            SELECT primitive_id, business_id, MAX(z) AS m FROM z JOIN reviews USING (review_id) GROUP BY primitive_id, business_id))
    JOIN verdicts USING (business_id) WHERE policy_id = 'S1V3' AND k = 50 AND verdict NOT IN ('Low Risk', 'Unknown')""")
def _(spark, sf):
    """J20, F21."""
    truth = ad.verdict_table(spark, sf).where("policy_id = 'S1V3' AND k = 50").select("business_id", "verdict")
    out = ac.positive_ranks(z_table(spark, sf), ad.pool(spark, sf), truth)
    return out.select("primitive_id", "business_id", *longs("rank"), "verdict")


@query("event_tags", ["tags"], "SELECT review_id, primitive_id, y FROM tags")
def _(spark, sf):
    """A39, F9, D20."""
    return tags(spark, sf).select("review_id", "primitive_id", *longs("y"))


@query("tag_summary", ["tags"], "SELECT primitive_id, COUNT(*) AS tags, COUNT(*) FILTER (WHERE y > 0) AS pos, COUNT(*) FILTER (WHERE y <= 0) AS neg FROM tags GROUP BY primitive_id")
def _(spark, sf):
    """A29."""
    return ac.tag_summary(tags(spark, sf))


@query("gate_summary", ["gate_members", "bm25"], """
    SELECT primitive_id, modality, polarity, COUNT(DISTINCT gate_id) AS gates FROM gate_members WHERE gate_id IN (SELECT query_id FROM bm25) GROUP BY primitive_id, modality, polarity""")
def _(spark, sf):
    """A29 over the gates that found something."""
    used = ad.gate_scores(spark, sf).select("gate_id").distinct()
    return ac.gate_summary(ad.gates(spark).join(used, "gate_id", "left_semi"))


@query("calibration_counts", ["calib"], "SELECT primitive_id, bin, alpha, beta, ROUND(alpha / (alpha + beta), 6) AS theta FROM calib")
def _(spark, sf):
    """A23, J21, S12."""
    return calibration(spark, sf).select("primitive_id", *longs("bin"), "alpha", "beta", r6("theta"))


@query("calibration_upper_bound", ["calib"], """
narrowed AS (
  SELECT primitive_id, bin, alpha, beta, 0e0 AS lo, 1e0 AS hi, 0 AS i FROM calib
  UNION ALL
  SELECT primitive_id, bin, alpha, beta, CASE WHEN tail < 0.95 THEN mid ELSE lo END, CASE WHEN tail < 0.95 THEN hi ELSE mid END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(alpha::BIGINT, (alpha + beta)::BIGINT),
                     lambda j: exp(lgamma(alpha + beta) - lgamma(j + 1) - lgamma(alpha + beta - j) + j * ln(mid) + (alpha + beta - 1 - j) * ln(1 - mid)))) AS tail
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM narrowed WHERE i < 45)))
SELECT primitive_id, bin, ROUND(alpha / (alpha + beta), 6) AS theta, ROUND((lo + hi) / 2, 6) AS u FROM narrowed WHERE i = 45""", recursive=True)
def _(spark, sf):
    """A23 with X24."""
    return calibration(spark, sf, delta=0.05).select("primitive_id", *longs("bin"), r6("theta"), r6("u"))


@query("variance_drop", ["calib"], """
    SELECT primitive_id, bin, ROUND(greatest(0, v - (t * v1 + (1 - t) * v0)), 9) AS dv FROM (
        SELECT primitive_id, bin, alpha / n AS t, alpha * beta / (n * n * (n + 1)) AS v, (alpha + 1) * beta / ((n + 1) * (n + 1) * (n + 2)) AS v1, alpha * (beta + 1) / ((n + 1) * (n + 1) * (n + 2)) AS v0
        FROM (SELECT *, alpha + beta AS n FROM calib))""")
def _(spark, sf):
    """X25."""
    from arbitra.functions.scoring import variance_drop

    c = calibration(spark, sf)
    return c.select("primitive_id", *longs("bin"), F.round(variance_drop(F.col("alpha"), F.col("beta")), 9).alias("dv"))


@query("positive_counts", ["tags"], "SELECT business_id, primitive_id, CAST(SUM(y) AS BIGINT) AS n FROM tags WHERE y > 0 GROUP BY business_id, primitive_id")
def _(spark, sf):
    """A24."""
    return ac.positive_counts(tags(spark, sf)).select("business_id", "primitive_id", *longs("n"))


_RULE_SQL = """SELECT business_id, CASE WHEN BOOL_AND(deficit = 0) FILTER (WHERE label = 'Critical Risk') THEN 'Critical Risk'
    WHEN BOOL_OR(deficit = 0) FILTER (WHERE label = 'High Risk') THEN 'High Risk' END AS verdict FROM deficits GROUP BY business_id"""


@query("rule_verdict_from_counts", ["deficits"], _RULE_SQL)
def _(spark, sf):
    """A25."""
    return ac.rule_verdicts(entities(spark, sf), ac.positive_counts(tags(spark, sf)), cat.RULES, cat.PRIMITIVES)


@query("unverified_bins", ["open_z"], """
    SELECT business_id, primitive_id, bin, COUNT(*) AS n FROM open_z GROUP BY GROUPING SETS ((business_id, primitive_id, bin), (primitive_id, bin))""")
def _(spark, sf):
    """A27, U14."""
    out = ac.bin_counts_all(ac.unverified(binned(spark, sf), tags(spark, sf)), ad.pool(spark, sf))
    return out.select("business_id", "primitive_id", *longs("bin"), "n")


_RHO_SQL = """SELECT business_id, least(1, SUM(COALESCE(rho, 0))) AS rho FROM (
    SELECT business_id, label, CASE label WHEN 'Critical Risk' THEN MIN(part) ELSE least(1, SUM(part)) END AS rho FROM (
        SELECT d.business_id, label, CASE WHEN deficit > 0 THEN least(1, COALESCE(mu, 0) / deficit) END AS part FROM deficits d
        LEFT JOIN (SELECT business_id, primitive_id, SUM(n * alpha / (alpha + beta)) AS mu FROM open_bins JOIN calib USING (primitive_id, bin) GROUP BY business_id, primitive_id) m
             USING (business_id, primitive_id)) GROUP BY business_id, label) GROUP BY business_id"""


def bound(spark, sf):
    zb = binned(spark, sf)
    t = tags(spark, sf)
    open_bins = ac.bin_counts(ac.unverified(zb, t), ad.pool(spark, sf))
    return ac.default_bound(
        entities(spark, sf), ac.positive_counts(t), open_bins, calibration(spark, sf, zb), cat.RULES, cat.PRIMITIVES
    )


@query("default_bound", ["deficits", "open_bins", "calib"], f"SELECT business_id, ROUND(rho, 6) AS rho FROM ({_RHO_SQL})")
def _(spark, sf):
    """A26; the bound of a bin is its mean here."""
    return bound(spark, sf).select("business_id", r6("rho"))


@query("stop_check", ["deficits", "open_bins", "calib"], f"""
    SELECT business_id, CASE WHEN verdict IS NOT NULL THEN verdict WHEN rho <= 0.9 THEN 'Low Risk' END AS verdict,
           CASE WHEN verdict IS NOT NULL THEN 'rule_satisfied' WHEN rho <= 0.9 THEN 'bound' END AS stop_reason FROM ({_RULE_SQL}) JOIN ({_RHO_SQL}) USING (business_id)""")
def _(spark, sf):
    """T9."""
    v = ac.rule_verdicts(entities(spark, sf), ac.positive_counts(tags(spark, sf)), cat.RULES, cat.PRIMITIVES)
    return ac.stop_check(v, bound(spark, sf), "Low Risk", 0.9).select("business_id", "verdict", "stop_reason")


def candidates(spark, sf, zb=None, open_z=None, calibrated=None):
    z = binned(spark, sf) if zb is None else zb
    t = tags(spark, sf)
    return ac.candidate_scores(
        open_z or ac.unverified(z, t), ad.pool(spark, sf), ac.positive_counts(t), calibrated or calibration(spark, sf, z), cat.PRIMITIVES,
        ["Critical Risk", "High Risk", "Low Risk"],
    )


@query("candidate_scores", ["open_z", "open_bins", "calib", "deficits"], """
    SELECT review_id, ROUND(MAX(CASE WHEN top = 1 AND deficit > 0 THEN greatest(0, z) ELSE 0 END), 5) AS v_hunt, ROUND(SUM(o.n / rest * dv), 5) AS v_local, ROUND(SUM(a.n / total * dv), 5) AS v_global
    FROM open_z JOIN deficits USING (business_id, primitive_id)
    JOIN (SELECT business_id, primitive_id, bin, n FROM open_bins) o USING (business_id, primitive_id, bin)
    JOIN (SELECT primitive_id, bin, SUM(n) AS n FROM open_bins GROUP BY primitive_id, bin) a USING (primitive_id, bin)
    JOIN (SELECT business_id, COUNT(*) AS rest FROM (SELECT DISTINCT business_id, review_id FROM open_z) GROUP BY business_id) USING (business_id)
    JOIN (SELECT primitive_id, bin, greatest(0, alpha * beta / (n * n * (n + 1)) - (alpha / n * (alpha + 1) * beta + (1 - alpha / n) * alpha * (beta + 1)) / ((n + 1) * (n + 1) * (n + 2))) AS dv
          FROM (SELECT *, alpha + beta AS n FROM calib)) USING (primitive_id, bin), (SELECT COUNT(DISTINCT review_id) AS total FROM open_z)
    GROUP BY review_id""")
def _(spark, sf):
    """T6, scores."""
    return candidates(spark, sf).select("review_id", *[F.round(c, 5).alias(c) for c in ("v_hunt", "v_local", "v_global")])


_SCORES = """SELECT review_id, any_value(business_id) AS business_id, ROUND(MAX(CASE WHEN top = 1 AND deficit > 0 THEN greatest(0, z) * exp(-ord_of_label) ELSE 0 END) + SUM(o.n / rest * dv) + SUM(a.n / total * dv), 9) AS score
    FROM open_z JOIN (SELECT *, CASE label WHEN 'Critical Risk' THEN 0 WHEN 'High Risk' THEN 1 ELSE 999 END AS ord_of_label FROM deficits) USING (business_id, primitive_id)
    JOIN (SELECT business_id, primitive_id, bin, n FROM open_bins) o USING (business_id, primitive_id, bin)
    JOIN (SELECT primitive_id, bin, SUM(n) AS n FROM open_bins GROUP BY primitive_id, bin) a USING (primitive_id, bin)
    JOIN (SELECT business_id, COUNT(*) AS rest FROM (SELECT DISTINCT business_id, review_id FROM open_z) GROUP BY business_id) USING (business_id)
    JOIN drops USING (primitive_id, bin), (SELECT COUNT(DISTINCT review_id) AS total FROM open_z)
    GROUP BY review_id"""
_DROPS = """SELECT primitive_id, bin, greatest(0, alpha * beta / (n * n * (n + 1)) - (alpha / n * (alpha + 1) * beta + (1 - alpha / n) * alpha * (beta + 1)) / ((n + 1) * (n + 1) * (n + 2))) AS dv
    FROM (SELECT *, alpha + beta AS n FROM calib)"""


def _one_per_bin(name, order, by, taken, limit):
    """Bins in order, each with its first review (by an order) that is not taken, as a recursion."""
    return f"""
{name}_bins AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}, primitive_id, bin) AS i, primitive_id, bin FROM sizes),
{name}_lists AS MATERIALIZED (SELECT i, list(review_id ORDER BY {by}, review_id) AS found FROM {name}_bins JOIN open_z USING (primitive_id, bin) JOIN scores USING (review_id) GROUP BY i),
{name}_steps AS (
  SELECT 0::BIGINT AS i, {taken} AS taken, []::VARCHAR[] AS own
  UNION ALL
  SELECT b.i, s.taken, CASE WHEN len(s.own) >= {limit} THEN s.own
    ELSE list_concat(s.own, list_filter(b.found, lambda r: NOT list_contains(s.taken, r) AND NOT list_contains(s.own, r))[1:1]) END
  FROM {name}_steps s JOIN {name}_lists b ON b.i = s.i + 1),
{name} AS MATERIALIZED (SELECT own FROM {name}_steps ORDER BY i DESC LIMIT 1)"""


def _batch_sql(size, explore, coverage, seed, focus=None):
    closeout = f"SELECT * FROM scores WHERE business_id = '{focus}' ORDER BY score DESC, review_id LIMIT {max(1, size // 4)}" if focus else "SELECT * FROM scores WHERE false"
    n = int(size * explore)
    return f"""
drops AS MATERIALIZED ({_DROPS}),
scores AS MATERIALIZED ({_SCORES}),
sizes AS MATERIALIZED (SELECT primitive_id, bin, COUNT(*) AS n, any_value(dv) AS dv FROM open_z JOIN drops USING (primitive_id, bin) GROUP BY primitive_id, bin),
closeout AS MATERIALIZED (SELECT coalesce(list(review_id ORDER BY score DESC, review_id), []) AS own FROM ({closeout})),
{_one_per_bin("coverage", "-n * dv", "score DESC", "(SELECT own FROM closeout)", coverage)},
before AS MATERIALIZED (SELECT list_concat((SELECT own FROM closeout), (SELECT own FROM coverage)) AS own),
exploit AS MATERIALIZED (SELECT coalesce(list(review_id ORDER BY score DESC, review_id), []) AS own FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, review_id) AS place FROM scores WHERE NOT list_contains((SELECT own FROM before), review_id))
  WHERE place <= {size - n} - (SELECT len(own) FROM before)),
{_one_per_bin("explore", "n", f"md5('{seed}:' || review_id)", "list_concat((SELECT own FROM before), (SELECT own FROM exploit))", f"{size} - len(s.taken)")}
SELECT row_number() OVER (ORDER BY stage_no, place) AS pick, review_id, stage FROM (
  SELECT 0 AS stage_no, 'closeout' AS stage, unnest(own) AS review_id, unnest(range(len(own))) AS place FROM closeout
  UNION ALL SELECT 1, 'coverage', unnest(own), unnest(range(len(own))) FROM coverage
  UNION ALL SELECT 2, 'exploit', unnest(own), unnest(range(len(own))) FROM exploit
  UNION ALL SELECT 3, 'explore', unnest(own), unnest(range(len(own))) FROM explore) QUALIFY pick <= {size}"""


def batch(spark, sf, size, explore, coverage, seed, focus=None):
    zb = binned(spark, sf)
    open_z = ac.unverified(zb, tags(spark, sf))
    c = calibration(spark, sf, zb)
    scored = candidates(spark, sf, zb, open_z, c).withColumn("score", F.round("score", 9))
    return ac.select_batch(scored, open_z, c, size, explore, coverage, seed, focus).select(*longs("pick"), "review_id", "stage")


@query("select_batch", ["open_z", "open_bins", "calib", "deficits"], _batch_sql(20, 0.2, 5, 1), recursive=True)
def _(spark, sf):
    """Coverage, exploit and explore stages."""
    return batch(spark, sf, 20, 0.2, 5, 1)


@query("select_batch_focus", ["open_z", "open_bins", "calib", "deficits"], _batch_sql(40, 0.3, 4, 7, "src3"), recursive=True)
def _(spark, sf):
    """All four stages, with a stalled business to close out."""
    return batch(spark, sf, 40, 0.3, 4, 7, "src3")


@query("discovery_examples", ["tags", "z", "reviews"], """
    SELECT primitive_id, kind, snippet FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY primitive_id, kind ORDER BY review_id) AS rn FROM (
        SELECT primitive_id, review_id, 'positive' AS kind, 'event of ' || review_id AS snippet FROM tags WHERE y > 0
        UNION ALL SELECT primitive_id, review_id, 'negative', text FROM tags JOIN z USING (primitive_id, review_id)
            JOIN (SELECT primitive_id, quantile_cont(z, 0.7) AS t FROM z GROUP BY primitive_id) USING (primitive_id) JOIN reviews USING (review_id) WHERE y = 0 AND z >= t)) WHERE rn <= 5""")
def _(spark, sf):
    """T8."""
    return ac.discovery_examples(tags(spark, sf), z_table(spark, sf), ad.reviews(spark, sf)).select("primitive_id", "kind", "snippet")


@query("verdict_evidence", ["tags", "deficits", "raw"], f"""
    SELECT business_id, review_id, primitive_id, f.k AS field, f.v AS judgement FROM (
        SELECT t.business_id, t.review_id, primitive_id, UNNEST([{{'k': 'incident_severity', 'v': incident_severity}}, {{'k': 'account_type', 'v': account_type}},
               {{'k': 'assurance_claim', 'v': assurance_claim}}, {{'k': 'staff_response', 'v': staff_response}}]) AS f
        FROM tags t JOIN ({_RULE_SQL}) USING (business_id) JOIN raw r ON r.review_id = t.review_id AND model = 'm-large' WHERE y > 0 AND verdict = split_part(primitive_id, '_clause_', 1))""")
def _(spark, sf):
    """F20."""
    t = tags(spark, sf)
    v = ac.rule_verdicts(entities(spark, sf), ac.positive_counts(t), cat.RULES, cat.PRIMITIVES).where("verdict IS NOT NULL")
    return ac.verdict_evidence(t, v, cat.RULES).select("business_id", "review_id", "primitive_id", "field", "judgement")
