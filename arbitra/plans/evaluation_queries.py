"""Verdict and evidence quality, retrieval, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions import jsontext as js
from arbitra.functions import scoring as sc
from arbitra.functions import text as tx
from arbitra.functions import values as vl
from arbitra.functions.ranking import rank_normalize
from arbitra.operators import evaluation as ev
from arbitra.operators import retrieval as rt
from arbitra.operators import usage as us
from arbitra.plans import adapters as ad
from arbitra.plans import catalog as cat
from arbitra.plans.oracle import norm
from arbitra.plans.registry import longs, query, r6
from arbitra.streaming import jobs


def pairs(spark, sf):
    return ev.scored_pairs(ad.predictions(spark, sf), ad.truth(spark, sf), cat.VERDICTS)


@query("scored_pairs", ["pairs"], "SELECT business_id, y_pred, y_true, ROUND(risk_score, 6) AS risk_score FROM pairs")
def _(spark, sf):
    """J8, M4, X12, F13."""
    return pairs(spark, sf).select("business_id", *longs("y_pred", "y_true"), r6("risk_score"))


@query("accuracy", ["predictions", "truth"], """
    SELECT ROUND(AVG(CAST(p.verdict = t.verdict AS INTEGER)), 6) AS accuracy, COUNT(*) AS n FROM predictions p JOIN truth t USING (business_id)""")
def _(spark, sf):
    """M1."""
    return ev.accuracy(ad.predictions(spark, sf), ad.truth(spark, sf)).select(r6("accuracy"), "n")


@query("exact_match", ["predictions", "truth"], "SELECT business_id, p.verdict = t.verdict AS ok FROM predictions p LEFT JOIN truth t USING (business_id)")
def _(spark, sf):
    """X34, UD2: no truth, no validation."""
    joined = ad.predictions(spark, sf).select("business_id", F.col("verdict").alias("p")).join(
        ad.truth(spark, sf).select("business_id", F.col("verdict").alias("t")), "business_id", "left"
    )
    return joined.select("business_id", vl.exact_match(F.col("p"), F.col("t")).alias("ok"))


@query("macro_f1", ["pairs"], """
    SELECT ROUND(AVG(f1), 6) AS macro_f1, COUNT(*) AS classes FROM (
        SELECT c, 2e0 * SUM(hit) / COUNT(*) AS f1 FROM (SELECT y_true AS c, CAST(y_true = y_pred AS INTEGER) AS hit FROM pairs UNION ALL SELECT y_pred, 0 FROM pairs) GROUP BY c)""")
def _(spark, sf):
    """M3."""
    return ev.macro_f1(pairs(spark, sf)).select(r6("macro_f1"), "classes")


@query("ordinal_auprc", ["pairs"], """
    SELECT ROUND(MAX(CASE WHEN level = 1 THEN ap END), 6) AS auprc_ge_high, ROUND(MAX(CASE WHEN level = 2 THEN ap END), 6) AS auprc_ge_critical, ROUND(AVG(ap), 6) AS ordinal_auprc FROM (
        SELECT level, SUM(tp / total * (cum_tp / cum_n)) AS ap FROM (
            SELECT level, tp, SUM(tp) OVER (PARTITION BY level) AS total, SUM(n) OVER w AS cum_n, SUM(tp) OVER w AS cum_tp FROM (
                SELECT level, risk_score, COUNT(*) AS n, SUM(CAST(y_true >= level AS INTEGER)) AS tp FROM pairs, (VALUES (1), (2)) l(level) GROUP BY level, risk_score)
            WINDOW w AS (PARTITION BY level ORDER BY risk_score DESC)) GROUP BY level)""")
def _(spark, sf):
    """M2, W8."""
    return ev.ordinal_auprc(pairs(spark, sf)).select(r6("auprc_ge_high"), r6("auprc_ge_critical"), r6("ordinal_auprc"))


@query("false_positive_rate", ["predictions", "truth", "claims"], """
    SELECT ROUND(AVG(CAST(c.review_id IS NOT NULL AS INTEGER)), 6) AS false_positive_rate, COUNT(c.review_id) AS false_positives, COUNT(*) AS negatives
    FROM predictions p JOIN truth t USING (business_id) LEFT JOIN (SELECT DISTINCT review_id FROM claims) c ON c.review_id = business_id
    WHERE error IS NULL AND t.verdict = 'Low Risk'""")
def _(spark, sf):
    """M11."""
    per_doc = ad.claims(spark, sf).withColumn("business_id", F.col("review_id"))
    out = ev.false_positive_rate(ad.predictions(spark, sf), ad.truth(spark, sf), per_doc, cat.VERDICTS)
    return out.select(r6("false_positive_rate"), "false_positives", "negatives")


@query("evidence_by_entity", ["biz_pred", "claims", "incidents"], """
    SELECT business_id, COALESCE(claimed, 0) AS claimed, COALESCE(truth, 0) AS truth, COALESCE(matched, 0) AS matched, ROUND(matched / claimed, 6) AS evidence_precision,
           CASE WHEN truth > 0 THEN ROUND(matched / truth, 6) END AS evidence_recall FROM biz_pred LEFT JOIN (
        SELECT business_id, NULLIF(COUNT(c), 0) AS claimed, COUNT(t) AS truth, COUNT(c) FILTER (WHERE t IS NOT NULL) AS matched FROM
            (SELECT DISTINCT business_id, review_id, 1 AS c FROM claims) a FULL JOIN (SELECT DISTINCT business_id, review_id, 1 AS t FROM incidents) b USING (business_id, review_id)
        GROUP BY business_id) USING (business_id)""")
def _(spark, sf):
    """M5, J9, U4."""
    out = ev.evidence_by_entity(ad.business_predictions(spark, sf), ad.claims(spark, sf), ad.incidents(spark, sf))
    return out.select("business_id", *longs("claimed", "truth", "matched"), r6("evidence_precision"), r6("evidence_recall"))


@query("evidence_precision_recall", ["claims", "incidents"], """
    SELECT ROUND(COUNT(*) FILTER (WHERE c = 1 AND t = 1) / COUNT(c), 6) AS evidence_precision, ROUND(COUNT(*) FILTER (WHERE c = 1 AND t = 1) / COUNT(t), 6) AS evidence_recall,
           COUNT(c) AS total_claimed, COUNT(*) FILTER (WHERE c = 1 AND t = 1) AS total_matched, COUNT(t) AS total_truth FROM
        (SELECT DISTINCT review_id, 1 AS c FROM claims) a FULL JOIN (SELECT DISTINCT review_id, 1 AS t FROM incidents) b USING (review_id)""")
def _(spark, sf):
    """M5."""
    out = ev.evidence_validity(ev.evidence_by_entity(ad.business_predictions(spark, sf), ad.claims(spark, sf), ad.incidents(spark, sf)))
    return out.select(r6("evidence_precision"), r6("evidence_recall"), *longs("total_claimed", "total_matched", "total_truth"))


@query("snippet_validity_exact", ["claims"], f"SELECT review_id, field, contains({norm('text')}, {norm('snippet')}) AS exact FROM claims WHERE snippet <> ''")
def _(spark, sf):
    """X17 first tier, J11, M6."""
    checked = ev.snippet_checks(ad.claims(spark, sf), ad.reviews(spark, sf))
    return checked.select("review_id", "field", (F.col("match_type") == "exact").alias("exact"))


def _pieces(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {norm('x')}), lambda x: length(x) >= 10)"


# Every tier of the quote check: segments, their first places in the text, shared words.
_QUOTES = rf"""
    SELECT review_id, field, CASE WHEN contains(s, q) THEN 'exact' WHEN spans THEN 'multi_span' WHEN shared >= 0.8 THEN 'word_overlap' ELSE 'no_match' END AS match_type,
           CASE WHEN contains(s, q) THEN 1 ELSE found END AS segments_found, CASE WHEN contains(s, q) THEN 1 ELSE total END AS segments_total,
           CASE WHEN contains(s, q) THEN 1e0 WHEN spans THEN found / total WHEN shared >= 0.8 THEN shared WHEN total > 0 THEN found / total ELSE 0e0 END AS match_ratio,
           CASE WHEN contains(s, q) THEN CAST(strpos(s, q) - 1 AS VARCHAR) ELSE array_to_string(places, ',') END AS positions
    FROM (SELECT *, total > 0 AND found / total >= 0.8 AND present = list_sort(list_distinct(present)) AS spans,
                 CASE WHEN len(words) >= 3 THEN len(list_intersect(words, string_split(s, ' '))) / len(words) END AS shared
          FROM (SELECT *, len(parts) AS total, list_filter(places, lambda x: x >= 0) AS present, len(list_filter(places, lambda x: x >= 0)) AS found FROM (
              SELECT *, list_distinct(string_split(q, ' ')) AS words,
                     list_transform(parts, lambda x: CASE WHEN strpos(s, x) > 0 THEN strpos(s, x) ELSE strpos(s, regexp_replace(x, '[.,!?;:]+$', '')) END - 1) AS places
              FROM (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN contains(snippet, '...') AND len(b) > 0 THEN b ELSE w END AS parts FROM (
                  SELECT review_id, field, snippet, {norm('text')} AS s, {norm('snippet')} AS q,
                         {_pieces(r"string_split(regexp_replace(snippet, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1))")} AS a,
                         {_pieces("string_split(snippet, '...')")} AS b, {_pieces("[snippet]")} AS w FROM claims WHERE snippet <> '')))))"""


@query("snippet_validity_multispan", ["claims"], f"""
    SELECT match_type, COUNT(*) AS snippets, ROUND(AVG(match_ratio), 6) AS match_ratio FROM ({_QUOTES}) GROUP BY match_type""")
def _(spark, sf):
    """X17 all tiers, M6."""
    checked = ev.snippet_checks(ad.claims(spark, sf), ad.reviews(spark, sf))
    return checked.groupBy("match_type").agg(F.count(F.lit(1)).alias("snippets"), F.round(F.avg("match_ratio"), 6).alias("match_ratio"))


@query("snippet_spans", ["claims"], f"""
    SELECT review_id, field, match_type, segments_found, segments_total, ROUND(match_ratio, 6) AS match_ratio, positions FROM ({_QUOTES})""")
def _(spark, sf):
    """The tier, the segments and their places of every quote."""
    checked = ev.snippet_checks(ad.claims(spark, sf), ad.reviews(spark, sf))
    return checked.select(
        "review_id", "field", "match_type", *[F.col(c).cast("long").alias(c) for c in ("segments_found", "segments_total")],
        r6("match_ratio"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
    )


@query("word_overlap", ["claims"], f"""
    SELECT review_id, field, ROUND(len(list_intersect(q, s)) / len(q), 6) AS overlap FROM (
        SELECT review_id, field, list_distinct(string_split({norm('snippet')}, ' ')) AS q, list_distinct(string_split({norm('text')}, ' ')) AS s FROM claims)""")
def _(spark, sf):
    """X17 third tier."""
    rows = ad.claims(spark, sf).join(ad.reviews(spark, sf).select("review_id", "text"), "review_id")
    q = F.array_distinct(F.split(tx.normalize(F.col("snippet")), " "))
    s = F.split(tx.normalize(F.col("text")), " ")
    return rows.select("review_id", "field", F.round(F.size(F.array_intersect(q, s)) / F.size(q), 6).alias("overlap"))


@query("judgement_accuracy_by_field", ["claims", "incidents"], """
    SELECT field, COUNT(*) FILTER (WHERE ok) AS correct, COUNT(*) AS total, ROUND(AVG(CAST(ok AS INTEGER)), 6) AS accuracy FROM (
        SELECT 'INCIDENT_SEVERITY' AS field, COALESCE(c.judgement = value || ' incident', FALSE) AS ok FROM incidents i
            LEFT JOIN (SELECT * FROM claims WHERE field = 'INCIDENT_SEVERITY') c USING (review_id)
        UNION ALL SELECT c.field, assured FROM incidents JOIN claims c USING (review_id) WHERE c.field = 'ASSURANCE_OF_SAFETY'
        UNION ALL SELECT c.field, (judgement = 'dismissive') = dismissed FROM incidents JOIN claims c USING (review_id) WHERE c.field = 'STAFF_RESPONSE') GROUP BY field""")
def _(spark, sf):
    """M7, X11, X14, X15."""
    checks = ev.judgement_checks(ad.claims(spark, sf), ad.incidents(spark, sf))
    return ev.judgement_accuracy(checks).select("field", "correct", "total", r6("accuracy"))


_CLAIM_SQL = """SELECT business_id, SUM(CASE WHEN field = 'INCIDENT_SEVERITY' THEN CASE judgement WHEN 'severe incident' THEN 15 WHEN 'moderate incident' THEN 5 ELSE 2 END
    WHEN field = 'ASSURANCE_OF_SAFETY' THEN 5 WHEN judgement = 'dismissive' THEN 3 ELSE 0 END) AS s FROM claims WHERE is_direct GROUP BY business_id"""


@query("verdict_from_claims", ["biz_pred", "claims"], f"""
    SELECT business_id, COALESCE(s, 0) AS computed_score, CASE WHEN s >= 8 THEN 'Critical Risk' WHEN s >= 4 THEN 'High Risk' ELSE 'Low Risk' END AS computed_verdict
    FROM biz_pred LEFT JOIN ({_CLAIM_SQL}) USING (business_id)""")
def _(spark, sf):
    """M13."""
    out = ev.verdict_from_claims(ad.business_predictions(spark, sf).select("business_id"), ad.claims(spark, sf))
    return out.select("business_id", *longs("computed_score"), "computed_verdict")


@query("verdict_from_program", ["claims", "biz_pred"], """
    SELECT business_id, COALESCE(n, 0) AS n_severe, COALESCE(p, 0) AS points, CASE WHEN p >= 30 THEN 'Critical Risk' WHEN n >= 1 THEN 'High Risk' ELSE 'Low Risk' END AS verdict
    FROM biz_pred LEFT JOIN (SELECT business_id, COUNT(*) FILTER (WHERE judgement = 'severe incident') AS n,
        SUM(CASE judgement WHEN 'severe incident' THEN 10e0 WHEN 'moderate incident' THEN 4e0 ELSE 0e0 END) AS p FROM claims GROUP BY business_id) USING (business_id)""")
def _(spark, sf):
    """M13 by a formula program."""
    program = {
        "compute": [
            {"name": "N_SEVERE", "op": "count", "where": {"INCIDENT_SEVERITY": "severe"}},
            {"name": "POINTS", "op": "sum", "expr": "CASE WHEN INCIDENT_SEVERITY IN ('severe incident') THEN 10 WHEN INCIDENT_SEVERITY IN ('moderate incident') THEN 4 ELSE 0 END"},
            {"name": "VERDICT", "op": "case", "source": "POINTS", "rules": [{"when": ">= 30", "then": "Critical Risk"}, {"when": "N_SEVERE >= 1", "then": "High Risk"}, {"else": "Low Risk"}]},
        ]
    }
    out = ev.verdict_from_program(ad.business_predictions(spark, sf).select("business_id"), ad.claims(spark, sf), program)
    return out.select("business_id", F.col("N_SEVERE").alias("n_severe"), F.col("POINTS").alias("points"), F.col("VERDICT").alias("verdict"))


@query("verdict_support", ["biz_pred", "claims"], f"""
    SELECT ROUND(AVG(CAST(v = verdict AS INTEGER)), 6) AS verdict_support_rate, COUNT(*) AS total, ROUND(AVG(CAST(s = total_points AS INTEGER)), 6) AS score_consistency FROM (
        SELECT total AS total_points, verdict, COALESCE(s, 0) AS s, CASE WHEN s >= 8 THEN 'Critical Risk' WHEN s >= 4 THEN 'High Risk' ELSE 'Low Risk' END AS v
        FROM biz_pred LEFT JOIN ({_CLAIM_SQL}) USING (business_id))""")
def _(spark, sf):
    """M8."""
    out = ev.verdict_support(ad.business_predictions(spark, sf), ad.claims(spark, sf))
    return out.select(r6("verdict_support_rate"), "total", r6("score_consistency"))


@query("verdict_consistency", ["predictions"], """
    SELECT ROUND(AVG(CASE WHEN rule_ord IS NOT NULL THEN CAST(rule_ord = y_pred AS INTEGER) END), 6) AS verdict_consistency, COUNT(rule_ord) AS total, COUNT(*) - COUNT(rule_ord) AS skipped_no_rule
    FROM predictions WHERE error IS NULL""")
def _(spark, sf):
    """M9, X13."""
    return ev.verdict_consistency(ad.predictions(spark, sf), cat.VERDICTS).select(r6("verdict_consistency"), "total", "skipped_no_rule")


@query("score_accuracy", ["predictions", "truth"], """
    SELECT ROUND(AVG(CAST(claimed_score = score AS INTEGER)), 6) AS score_accuracy, COUNT(*) AS total FROM predictions JOIN truth USING (business_id) WHERE error IS NULL AND claimed_score IS NOT NULL""")
def _(spark, sf):
    """M10."""
    return ev.score_accuracy(ad.predictions(spark, sf), ad.truth(spark, sf)).select(r6("score_accuracy"), "total")


@query("process_score", ["reviews"], """
    SELECT review_id, ROUND((stars / 5 * 0.35e0 + useful / 7e0 * 0.3e0 + 0.5e0 * 0.15e0 + stars / 5 * 0.15e0 + CASE WHEN lang = 'en' THEN 0.05e0 ELSE 0 END)
           / CASE WHEN lang = 'en' THEN 1e0 ELSE 0.95e0 END * 100, 5) AS process_score FROM reviews""")
def _(spark, sf):
    """M12."""
    parts = ad.reviews(spark, sf).select(
        "review_id", (F.col("stars") / 5).alias("incident_precision"), (F.col("useful") / 7).alias("severity_accuracy"), F.lit(0.5).alias("modifier_accuracy"),
        (F.col("stars") / 5).alias("verdict_support_rate"), F.when(F.col("lang") == "en", 1.0).alias("snippet_validity"),
    )
    return ev.process_score(parts).select("review_id", F.round("process_score", 5).alias("process_score"))


@query("evaluation_report")
def _(spark, sf):
    """M14."""
    p = ad.business_predictions(spark, sf).withColumn("triggered_rule", F.concat(F.lit("SCORE → "), F.col("verdict")))
    truth = ad.verdict_table(spark, sf).where("policy_id = 'S1V3' AND k = 50").select("business_id", "verdict", "score")
    report = ev.evaluation_report(p, truth, ad.claims(spark, sf), ad.incidents(spark, sf), ad.reviews(spark, sf), cat.VERDICTS)
    return report.select("metric", r6("value"))


@query("evaluation_counts", ["raw", "verdicts"], """
    SELECT metric, value FROM (
        SELECT 'n_samples' AS metric, COUNT(DISTINCT business_id)::DOUBLE AS value FROM raw WHERE model = 'm-large'
        UNION ALL SELECT 'n_with_gt', COUNT(DISTINCT business_id)::DOUBLE FROM raw JOIN verdicts USING (business_id) WHERE model = 'm-large' AND policy_id = 'S1V4' AND k = 25
        UNION ALL SELECT 'n_structured', COUNT(DISTINCT business_id)::DOUBLE FROM raw WHERE model = 'm-large' AND incident_severity <> 'none')""")
def _(spark, sf):
    """What the metrics are measured on."""
    truth = ad.verdict_table(spark, sf).where("policy_id = 'S1V4' AND k = 25").select("business_id", "verdict")
    return ev.evaluation_counts(ad.business_predictions(spark, sf), truth, ad.claims(spark, sf), cat.VERDICTS)


@query("verdict_text_fallback", ["reviews"], """
    SELECT review_id, CASE useful % 3 WHEN 0 THEN 'Low Risk' WHEN 1 THEN 'Critical Risk' END AS verdict, CASE WHEN useful % 3 = 1 THEN stars END AS risk_score FROM reviews""")
def _(spark, sf):
    """X6."""
    kind = F.col("useful") % 3
    answer = (
        F.when(kind == 0, F.lit("I say VERDICT: \"low risk\" here."))
        .when(kind == 1, F.concat(F.lit("so Critical Risk it is, final_risk_score: "), F.col("stars").cast("string")))
        .otherwise(F.lit("cannot tell"))
    )
    return ad.reviews(spark, sf).select("review_id", js.verdict_in_text(answer).alias("verdict"), js.risk_score_in_text(answer).alias("risk_score"))


# --- retrieval ---------------------------------------------------------------------------


@query("corpus_statistics", ["doc_tokens"], "SELECT COUNT(*) AS n_docs, ROUND(AVG(len(tok)), 6) AS avg_len, CAST(SUM(len(tok)) AS BIGINT) AS n_tokens FROM doc_tokens")
def _(spark, sf):
    """A19."""
    return rt.corpus_stats(ad.texts(spark, sf)).select("n_docs", r6("avg_len"), "n_tokens")


@query("document_frequency", ["postings"], "SELECT token, COUNT(*) AS df FROM postings GROUP BY token")
def _(spark, sf):
    """A19."""
    return rt.document_frequency(ad.texts(spark, sf))


@query("bm25_scores", ["bm25"], "SELECT query_id, review_id, ROUND(score, 5) AS score FROM bm25")
def _(spark, sf):
    """A20, J15, X22."""
    return rt.bm25(ad.texts(spark, sf), cat.GATE_QUERIES).select("query_id", "review_id", F.round("score", 5).alias("score"))


@query("bm25_postings", ["bm25"], "SELECT query_id, review_id, ROUND(score, 5) AS score FROM bm25")
def _(spark, sf):
    """A20 with the queries' terms in another order, which must not matter."""
    queries = {q: " ".join(reversed(text.split())) for q, text in cat.GATE_QUERIES.items()}
    return rt.bm25(ad.texts(spark, sf), queries).select("query_id", "review_id", F.round("score", 5).alias("score"))


@query("bm25_topk", ["bm25"], """
    SELECT query_id, rank, ROUND(score, 4) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM bm25) WHERE rank <= 10""")
def _(spark, sf):
    """A20, T1."""
    top = rt.bm25_topk(rt.bm25(ad.texts(spark, sf), cat.GATE_QUERIES), 10)
    return top.select("query_id", *longs("rank"), F.round("score", 4).alias("score"))


def label_queries(spark, sf):
    """One query vector per label: the mean of its vectors, long and refolded."""
    v = ad.table(spark, sf, "embeddings")
    parts = v.select(F.col("label").cast("string").alias("sample_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("sample_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("sample_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("query")
    )


def vectors(spark, sf):
    return ad.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("sample_id"), F.col("vec_id").cast("string").alias("review_id"), "embedding"
    )


_COS = """, means AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
    sims AS (SELECT CAST(label AS VARCHAR) AS sample_id, CAST(vec_id AS VARCHAR) AS review_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS s FROM embeddings JOIN means USING (label))"""


@query("cosine_topk", ["docs"], _COS + """
    SELECT sample_id, rank, ROUND(s, 5) AS similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY s DESC) AS rank FROM sims) WHERE rank <= 10""")
def _(spark, sf):
    """J16, X21, T3."""
    top = rt.similar_in_sample(label_queries(spark, sf), vectors(spark, sf), 10)
    return top.select("sample_id", *longs("rank"), F.round("similarity", 5).alias("similarity"))


@query("hybrid_retrieval", ["doc_tokens", "docs"], _COS + """
    , kw AS (SELECT CAST(label AS VARCHAR) AS sample_id, review_id FROM embeddings JOIN doc_tokens ON review_id = CAST(vec_id AS VARCHAR) WHERE list_contains(tok, 'thing')),
    poor AS (SELECT DISTINCT sample_id FROM sims WHERE sample_id NOT IN (SELECT sample_id FROM kw GROUP BY sample_id HAVING COUNT(*) >= 3))
    SELECT sample_id, review_id, 'keyword' AS origin FROM kw
    UNION ALL SELECT sample_id, review_id, 'vector' FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY s DESC, review_id) AS rank FROM sims JOIN poor USING (sample_id) WHERE (sample_id, review_id) NOT IN (SELECT (sample_id, review_id) FROM kw)) WHERE rank <= 5""")
def _(spark, sf):
    """A vector is that of the document with its number, a label is a sample."""
    words = ad.texts(spark, sf).where(F.array_contains(tx.tokens(F.col("text")), "thing")).select("review_id")
    keyword = vectors(spark, sf).join(words, "review_id", "left_semi").select("sample_id", "review_id")
    return rt.hybrid(keyword, vectors(spark, sf), label_queries(spark, sf), 3, 5)


@query("gate_cosine", [], """
    SELECT CAST(vec_id AS VARCHAR) AS review_id, gate_id, ROUND(list_dot_product(CAST(embedding AS DOUBLE[]), g) / ((sqrt(list_dot_product(g, g)) + 1e-9) * (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-9)), 5) AS score
    FROM embeddings, (SELECT 'ones' AS gate_id, [1e0 for i in range(64)] AS g UNION ALL SELECT 'ramp', [CAST(i AS DOUBLE) for i in range(64)])""")
def _(spark, sf):
    """J16, X21 in gate form."""
    gates = {"ones": [1.0] * 64, "ramp": [float(i) for i in range(64)]}
    return rt.gate_cosine(vectors(spark, sf), gates).select("review_id", "gate_id", F.round("score", 5).alias("score"))


@query("reduced_context", ["bm25", "reviews", "businesses"], """
    SELECT business_id, string_agg(review_id, ',' ORDER BY rank) AS ids FROM (
        SELECT business_id, review_id, ROW_NUMBER() OVER (PARTITION BY business_id ORDER BY ROUND(score, 9) DESC, review_id) AS rank FROM bm25 JOIN reviews USING (review_id) WHERE query_id = 'g_place_pos')
    WHERE rank <= 5 GROUP BY business_id""")
def _(spark, sf):
    """F17."""
    from arbitra.functions.ranking import top_per_key

    scores = rt.bm25(ad.texts(spark, sf), cat.GATE_QUERIES).where("query_id = 'g_place_pos'").select("review_id", F.round("score", 9).alias("score"))
    ranked = top_per_key(ad.reviews(spark, sf).join(scores, "review_id"), ["business_id"], [F.desc("score"), F.col("review_id")], 5, "rank")
    out = rt.reduced_context(ranked.select("business_id", "rank", "review_id", "text"), ad.businesses(spark, sf))
    ids = F.from_json("context", "reviews array<struct<review_id:string>>")["reviews"]["review_id"]
    return out.select("business_id", F.array_join(ids, ",").alias("ids"))


@query("missing_vectors", [], """
    SELECT sha1(text) AS text_hash, MIN(CAST(doc_id AS VARCHAR)) AS review_id FROM documents
    WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents JOIN embeddings ON vec_id = doc_id) GROUP BY sha1(text)""")
def _(spark, sf):
    """S11."""
    r = ad.reviews(spark, sf)
    have = ad.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("review_id"))
    stored = r.join(have, "review_id", "left_semi").select(F.lit("m").alias("model"), vl.text_hash(F.col("text")).alias("text_hash"))
    return rt.missing_vectors(r, stored, "m").select("text_hash", "review_id")


@query("missing_retrievals", ["businesses"], "SELECT business_id AS sample_id, review_count AS n_reviews FROM businesses WHERE categories = 'Shopping'")
def _(spark, sf):
    """Places have a stored retrieval, shops have none."""
    b = ad.businesses(spark, sf).select(F.col("business_id").alias("sample_id"), F.col("review_count").alias("n_reviews"), "categories")
    stored = b.where("categories <> 'Shopping'").select("sample_id", "n_reviews", F.lit(20).alias("top_k"))
    return rt.missing_retrievals(b.drop("categories"), stored, 20)


@query("missing_gates", ["bm25"], "SELECT gate_id FROM (VALUES ('g_new'), ('g_service_pos'), ('g_place_pos')) g(gate_id) WHERE gate_id NOT IN (SELECT query_id FROM bm25)")
def _(spark, sf):
    """S13."""
    gates = spark.createDataFrame([("g_new",), ("g_service_pos",), ("g_place_pos",)], "gate_id string")
    return rt.missing_gates(gates, ad.gate_scores(spark, sf))


@query("gate_dedupe", ["reviews"], f"SELECT lang, MIN(pos) AS pos FROM reviews GROUP BY lang, {norm('text')}")
def _(spark, sf):
    """U8: reviews as proposed gates, told apart by language and text."""
    rows = ad.texts(spark, sf).select(
        "lang", "pos", F.array("lang").alias("primitive_ids"), F.lit("bm25").alias("modality"), F.lit("pos").alias("polarity"),
        F.col("text").alias("query"),
    )
    return rt.dedupe_gates(rows).select("lang", "pos")


@query("gate_ids", ["businesses"], """
    SELECT business_id, substring(sha1('bm25:pos:' || lower(name) || ' x:' || business_id || ',zz'), 1, 12) AS gate_id FROM businesses WHERE contains(categories, 'Food')""")
def _(spark, sf):
    """X19, F23."""
    rows = ad.businesses(spark, sf).select(
        "business_id", F.array(F.lit("zz"), F.col("business_id")).alias("primitive_ids"), F.lit("bm25").alias("modality"), F.lit("pos").alias("polarity"),
        F.concat(F.col("name"), F.lit("  X ")).alias("query"), "categories",
    )
    found = rt.find_gates(rt.with_gate_ids(rows), "zz", "bm25", "pos").where(F.col("categories").contains("Food"))
    return found.select("business_id", "gate_id")


@query("substring_lookup", [], """
    SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 2e0 WHEN contains(p_name, 'red') THEN 3e0 ELSE 1e0 END AS factor FROM part""")
def _(spark, sf):
    """J12."""
    parts = ad.table(spark, sf, "part")
    return rt.substring_lookup(parts, "p_name", [("RING", 2.0), ("red", 3.0)], 1.0).select("p_partkey", F.col("looked_up").alias("factor"))


# --- usage -------------------------------------------------------------------------------


@query("call_cost", ["usage"], "SELECT event_id, ROUND(cost_usd, 9) AS cost_usd FROM usage")
def _(spark, sf):
    """X29."""
    return ad.usage(spark, sf).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("token_estimate", [], "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(spark, sf):
    """X29."""
    return ad.table(spark, sf, "documents").select("doc_id", sc.token_estimate(F.col("text")).alias("tokens"))


@query("usage_by_model", ["usage"], """
    SELECT model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens, ROUND(SUM(cost_usd), 6) AS cost_usd, ROUND(SUM(latency_ms), 4) AS latency_ms
    FROM usage GROUP BY ROLLUP (model)""")
def _(spark, sf):
    """A34."""
    return us.usage_summary(ad.usage(spark, sf)).select("model", "calls", "prompt_tokens", "completion_tokens", r6("cost_usd"), F.round("latency_ms", 4).alias("latency_ms"))


@query("usage_filter", ["usage"], "SELECT event_id FROM usage WHERE model = 'error'")
def _(spark, sf):
    """F15."""
    return us.filter_context(ad.usage(spark, sf), {"phase": "error"}).select("event_id")


@query("usage_delete_count", ["usage"], "SELECT COUNT(*) AS removed FROM usage WHERE model = 'click'")
def _(spark, sf):
    """U11."""
    return us.delete_matching(ad.usage(spark, sf), {"phase": "click"})[1]


def run_items(spark, sf):
    """Calls as run items: the user is the run, error events are failed items."""
    return ad.usage(spark, sf).select(
        F.col("user_id").alias("run_id"), F.when(F.col("model") == "error", "failed").alias("error"), "prompt_tokens", "completion_tokens", "latency_ms", "ts"
    )


def runs(spark, sf):
    """One run per user; every fifth kind of user ran on demand."""
    items = run_items(spark, sf)
    totals = items.groupBy("run_id").agg(F.avg(F.col("error").isNull().cast("int")).alias("accuracy"), F.min("ts").alias("started_at"))
    n = F.col("run_id").cast("int")
    return totals.join(us.run_latency(items.where(F.col("error").isNull())), "run_id", "left").select(
        F.concat(F.lit("m"), (n % 3).cast("string")).alias("method"), F.concat(F.lit("p"), (n % 4).cast("string")).alias("policy_id"), "run_id",
        n.alias("run_number"), F.when(n % 5 == 0, "ondemand").otherwise("batch").alias("mode"), "accuracy", (F.col("accuracy") / 2).alias("auprc"), "p50_ms", "p95_ms", "started_at",
    )


_RUNS = """, runs AS (SELECT 'm' || user_id % 3 AS method, 'p' || user_id % 4 AS policy_id, user_id, CASE WHEN user_id % 5 = 0 THEN 'ondemand' ELSE 'batch' END AS mode,
    AVG(CAST(model <> 'error' AS INTEGER)) AS accuracy, quantile_cont(latency_ms, 0.5) FILTER (WHERE model <> 'error') AS p50,
    quantile_cont(latency_ms, 0.95) FILTER (WHERE model <> 'error') AS p95, MIN(ts) AS started_at FROM usage GROUP BY user_id)"""


@query("run_totals", ["usage"], """
    SELECT CAST(user_id AS VARCHAR) AS run_id, COUNT(*) AS items, COUNT(*) FILTER (WHERE model = 'error') AS errors,
           CAST(COALESCE(SUM(prompt_tokens) FILTER (WHERE model <> 'error'), 0) AS BIGINT) AS prompt_tokens, ROUND(COALESCE(SUM(latency_ms) FILTER (WHERE model <> 'error'), 0), 4) AS latency_ms FROM usage GROUP BY user_id""")
def _(spark, sf):
    """A35."""
    return us.run_totals(run_items(spark, sf)).select("run_id", "items", "errors", "prompt_tokens", F.round("latency_ms", 4).alias("latency_ms"))


@query("run_summary", ["usage"], _RUNS + """
    SELECT method, policy_id, COUNT(*) AS total_runs, ROUND(AVG(accuracy), 6) AS accuracy_mean, ROUND(stddev_pop(accuracy), 6) AS accuracy_std,
           ROUND(AVG(p50) FILTER (WHERE mode = 'ondemand'), 5) AS latency_p50_ms, ROUND(AVG(p95) FILTER (WHERE mode = 'ondemand'), 5) AS latency_p95_ms FROM runs GROUP BY method, policy_id""")
def _(spark, sf):
    """A36."""
    return us.runs_summary(runs(spark, sf)).select(
        "method", "policy_id", "total_runs", r6("accuracy_mean"), r6("accuracy_std"), F.round("latency_p50_ms", 5).alias("latency_p50_ms"), F.round("latency_p95_ms", 5).alias("latency_p95_ms")
    )


@query("next_run", ["usage"], _RUNS + """
    SELECT method, policy_id, MAX(user_id) + 1 AS next_run, CASE WHEN COUNT(*) >= 12 THEN NULL WHEN COUNT(*) FILTER (WHERE mode = 'ondemand') = 0 THEN 'ondemand' ELSE 'batch' END AS next_mode FROM runs GROUP BY method, policy_id""")
def _(spark, sf):
    """W12."""
    return us.next_run(runs(spark, sf), 12).select("method", "policy_id", *longs("next_run"), "next_mode")


@query("latest_runs", ["usage"], _RUNS + "SELECT CAST(user_id AS VARCHAR) AS run_id FROM runs WHERE method = 'm1' ORDER BY started_at DESC, user_id LIMIT 5")
def _(spark, sf):
    """W13."""
    return us.latest_runs(runs(spark, sf), 5, method="m1").select("run_id")


@query("run_comparison", ["usage"], _RUNS + """
    SELECT method, policy_id, CAST(user_id AS VARCHAR) AS run_id, ROUND(accuracy, 6) AS accuracy FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY method, policy_id ORDER BY started_at DESC, user_id) AS rn FROM runs) WHERE rn = 1""")
def _(spark, sf):
    """A37."""
    return us.comparison(runs(spark, sf), ["accuracy"]).select("method", "policy_id", "run_id", r6("accuracy"))


@query("chunk_numbering", ["raw"], """
    SELECT model, (rn - 1) // 100 AS chunk, COUNT(*) AS n, MIN(id) AS first_id FROM (
        SELECT model, review_id || ':' || run AS id, ROW_NUMBER() OVER (PARTITION BY model ORDER BY review_id || ':' || run) AS rn FROM raw) GROUP BY model, chunk""")
def _(spark, sf):
    """W11."""
    rows = ad.raw_judgments(spark, sf).select("model", F.concat_ws(":", "review_id", F.col("run").cast("string")).alias("custom_id"))
    return us.chunked(rows, 100).groupBy("model", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("custom_id").alias("first_id"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("usage_tumbling", ["usage"], """
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start_at, model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, ROUND(SUM(cost_usd), 6) AS cost_usd FROM usage GROUP BY start_at, model""")
def _(spark, sf):
    """ST3, batch form."""
    return jobs.usage_windows(ad.usage(spark, sf)).select(_stamp("start").alias("start_at"), "model", "calls", "prompt_tokens", r6("cost_usd"))


@query("usage_sliding", ["usage"], """
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_at, model, COUNT(*) AS calls FROM (
        SELECT model, UNNEST([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM usage) GROUP BY s, model""")
def _(spark, sf):
    """ST3, batch form."""
    return jobs.usage_windows(ad.usage(spark, sf), "1 day", "12 hours").select(_stamp("start").alias("start_at"), "model", "calls")


@query("usage_session", ["usage"], """
    SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start_at, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens FROM (
        SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
            SELECT *, CAST(COALESCE(ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, TRUE) AS INTEGER) AS fresh FROM usage)) GROUP BY user_id, session""")
def _(spark, sf):
    """ST3, batch form."""
    out = jobs.usage_sessions(ad.usage(spark, sf), "6 hours", "user_id")
    return out.select("user_id", _stamp("start").alias("start_at"), "calls", "prompt_tokens")


@query("rank_normalize", [], """
    SELECT doc_id, ROUND((RANK() OVER (PARTITION BY lang ORDER BY n_chars) - 1 + (COUNT(*) OVER (PARTITION BY lang, n_chars) - 1) / 2e0) / greatest(COUNT(*) OVER (PARTITION BY lang) - 1, 1), 6) AS r FROM documents""")
def _(spark, sf):
    """W6."""
    return rank_normalize(ad.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "r").select("doc_id", r6("r"))
