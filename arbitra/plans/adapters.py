"""The driver's tables seen as businesses, reviews, judgements, claims and usage.

Each adapter is a pure projection or join of whole tables; ``plans.oracle`` holds the same
definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.operators import datasets, judgments
from arbitra.operators.sparse_scores import SparseScores, contrast
from arbitra.plans import catalog as cat
from arbitra.session import dimension, materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "string(doc_id) AS review_id", "source AS business_id", "doc_id AS user_id",
        "double(1 + doc_id % 5) AS stars", "n_chars % 7 AS useful",
        "date_format(date_add(DATE '2015-01-01', int(doc_id * 37 % 2500)), 'yyyy-MM-dd') AS date",
        "text", "lang", "doc_id AS pos",
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews for queries that work on their texts."""
    return spread(reviews(spark, sf), "review_id")


def businesses(spark: SparkSession, sf: str) -> DataFrame:
    rolled = table(spark, sf, "documents").groupBy("source").agg(
        F.expr("avg(double(1 + doc_id % 5)) AS stars"), F.expr("count(*) AS review_count")
    )
    return rolled.selectExpr(
        "source AS business_id", "upper(source) AS name", "concat('City', string(int(substr(source, 4)) % 4)) AS city",
        "'ST' AS state", "stars", "review_count",
        "CASE int(substr(source, 4)) % 3 WHEN 0 THEN 'Thai, Restaurants' WHEN 1 THEN 'Bars, Food' ELSE 'Shopping' END AS categories",
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("review_count"),
        F.col("c_acctbal").alias("average_stars"),
    )


def raw_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Four judgements per document: one by the large model, three runs of the small one."""
    base = table(spark, sf, "documents").selectExpr("doc_id", "source AS business_id", "doc_id % 10007 AS d")
    runs = """inline(array(struct('m-large', 1, 0), struct('m-small-x', 1, 1), struct('m-small-x', 2, 2),
                           struct('m-small-x', 3, 3))) AS (model, run, ord)"""
    rows = base.selectExpr("doc_id", "business_id", "(d * d * 31 + d * 7919) % 10007 AS q", runs)
    hashed = rows.selectExpr("*", "(q + run * 4 + length(model) * 5) % 101 AS h", "(q * 3 + run * 13 + ord) % 97 AS g")
    return hashed.selectExpr(
        f"'{cat.TOPIC}' AS topic", "string(doc_id) AS review_id", "business_id", "model", "run", "ord",
        "h < 35 OR g % 2 = 0 AS is_relevant",
        """map('incident_severity', CASE WHEN h < 6 THEN 'severe' WHEN h < 18 THEN 'moderate' WHEN h < 35 THEN 'mild' ELSE 'none' END,
               'account_type', CASE WHEN g % 4 = 0 THEN 'secondhand' ELSE 'firsthand' END,
               'assurance_claim', CASE WHEN g % 5 = 0 THEN 'true' ELSE 'false' END,
               'staff_response', CASE g % 3 WHEN 0 THEN 'dismissive' WHEN 1 THEN 'accommodated' ELSE 'none' END) AS fields""",
    )


def stored_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows that have arrived so far: run 3 only of labelled documents."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    raw = raw_judgments(spark, sf)
    early = raw.where(F.col("run") < 3)
    return early.unionByName(raw.where(F.col("run") == 3).join(labelled, "review_id", "left_semi").select(*raw.columns))


def voted(spark: SparkSession, sf: str) -> DataFrame:
    return judgments.aggregate(raw_judgments(spark, sf), cat.FIELDS, cat.WEIGHTS)


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Human corrections from the labels: toxic ones by hand, poor ones by keyword."""
    labels = table(spark, sf, "labels")
    rid, topic = F.col("doc_id").cast("string").alias("review_id"), F.lit(cat.TOPIC).alias("topic")
    manual = labels.where("toxic = 1").select(
        topic, rid, F.lit(0).alias("priority"), F.create_map(F.lit("incident_severity"), F.lit("severe")).alias("corrected"),
        F.lit("read by hand").alias("reason"),
    )
    keyword = labels.where("quality = 0").select(
        topic, rid, F.lit(1).alias("priority"),
        F.create_map(F.lit("incident_severity"), F.lit("none"), F.lit("account_type"), F.lit("secondhand")).alias("corrected"),
        F.lit("keyword").alias("reason"),
    )
    return manual.unionByName(keyword)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    from arbitra.operators.verdicts import join_judgments

    scaled = datasets.k_scales(reviews(spark, sf).drop("text"), cat.SCALES)
    return join_judgments(scaled, voted(spark, sf))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.explode(F.array(*[F.lit(k) for k in cat.SCALES]))
    return businesses(spark, sf).select("business_id", "categories", k.alias("k"))


def verdict_table(spark: SparkSession, sf: str) -> DataFrame:
    from arbitra.operators.verdicts import policy_verdicts

    return policy_verdicts(judged(spark, sf), cat.POLICIES, entities(spark, sf))


def large_model(spark: SparkSession, sf: str) -> DataFrame:
    return raw_judgments(spark, sf).where("model = 'm-large'")


SEVERITY = "fields['incident_severity']"
POINTS = "CASE {c} WHEN 'severe' THEN 15 WHEN 'moderate' THEN 5 WHEN 'mild' THEN 2 ELSE 0 END"
LABEL = "CASE {c} WHEN 'severe' THEN 'Critical Risk' WHEN 'moderate' THEN 'High Risk' ELSE 'Low Risk' END"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One predicted verdict per document (entity), in the spellings models use."""
    docs = table(spark, sf, "documents").selectExpr("string(doc_id) AS review_id", "n_chars", "lang")
    large = large_model(spark, sf).selectExpr("review_id", "fields['incident_severity'] AS s")
    votes = voted(spark, sf).selectExpr("review_id", "fields['incident_severity'] AS v")
    return large.join(docs, "review_id").join(votes, "review_id").selectExpr(
        "review_id AS business_id",
        """CASE s WHEN 'severe' THEN 'Critical Risk' WHEN 'moderate' THEN "'High Risk'" WHEN 'mild' THEN 'HIGH_RISK' ELSE 'Low Risk' END AS verdict""",
        "CASE WHEN n_chars % 3 <> 0 THEN n_chars % 100 / 10D END AS risk_score",
        "CASE WHEN lang = 'es' THEN 'timeout' END AS error",
        f"CASE WHEN v <> 'none' THEN concat('SCORE >= 4 → ', {LABEL.format(c='v')}) END AS triggered_rule",
        f"CASE WHEN lang = 'de' THEN 'n/a' ELSE string({POINTS.format(c='s')}) END AS claimed_score",
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """True verdicts of labelled documents; the true score comes from the voted severity."""
    labels = table(spark, sf, "labels").selectExpr(
        "string(doc_id) AS business_id",
        "CASE WHEN toxic = 1 THEN 'Critical Risk' WHEN quality = 0 THEN 'High Risk' ELSE 'Low Risk' END AS verdict",
    )
    scores = voted(spark, sf).selectExpr("review_id AS business_id", POINTS.format(c=SEVERITY) + " AS score")
    return labels.join(scores, "business_id")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence claimed by the large model per business, with quotes cut from the text."""
    quoted = reviews(spark, sf).select("review_id", "text", "lang", "pos")
    large = large_model(spark, sf).where("fields['incident_severity'] <> 'none'").select("business_id", "review_id", "fields")
    rows = large.join(quoted, "review_id").selectExpr(
        "business_id", "review_id", "pos", "lang",
        """CASE lang WHEN 'en' THEN substring(text, 11, 80) WHEN 'fr' THEN 'not said anywhere in it'
                ELSE concat(substring(text, 1, 40), '... ', right(text, 30)) END AS snippet""",
        """posexplode(array_compact(array(
               named_struct('field', 'INCIDENT_SEVERITY', 'judgement', concat(fields['incident_severity'], ' incident')),
               CASE WHEN fields['assurance_claim'] = 'true' THEN named_struct('field', 'ASSURANCE_OF_SAFETY', 'judgement', 'Yes') END,
               named_struct('field', 'STAFF_RESPONSE', 'judgement', fields['staff_response'])))) AS (i, c)""",
    )
    return rows.selectExpr(
        "business_id", "concat('E', review_id, '_', i) AS evidence_id", "pos * 3 + i AS pos", "review_id", "c.field",
        "c.judgement", "snippet", "lang <> 'de' AS is_direct",
    )


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """True incidents per review, from the votes."""
    where = reviews(spark, sf).select("review_id", "business_id")
    found = voted(spark, sf).where("is_relevant AND fields['incident_severity'] <> 'none'").join(where, "review_id")
    return found.selectExpr(
        "business_id", "review_id", "'incident_severity' AS field", "fields['incident_severity'] AS value",
        """array_compact(array(CASE WHEN fields['assurance_claim'] = 'true' THEN 'False assurance' END,
                               CASE WHEN fields['staff_response'] = 'dismissive' THEN 'Dismissive staff' END)) AS modifiers""",
    )


def business_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted verdict and claimed score per business, from the large model's severities."""
    points = F.expr(f"sum({POINTS.format(c=SEVERITY)}) AS total")
    return large_model(spark, sf).groupBy("business_id").agg(points).selectExpr(
        "business_id", "CASE WHEN total >= 60 THEN 'Critical Risk' WHEN total >= 4 THEN 'HIGH_RISK' ELSE 'Low Risk' END AS verdict",
        "double(NULL) AS risk_score", "string(NULL) AS error", "string(total) AS claimed_score",
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    from arbitra.operators.usage import price_table, with_cost

    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    calls = e.select(
        "event_id", "ts", F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("user_id"),
        F.floor(F.col("value") * 100).alias("prompt_tokens"), k.alias("completion_tokens"), F.col("value").alias("latency_ms"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("phase"), F.col("event_type")).alias("context"),
    )
    return with_cost(calls, price_table(spark, cat.PRICES))


def gates(spark: SparkSession) -> DataFrame:
    return dimension(spark, cat.GATES, "gate_id string, primitive_ids array<string>, modality string, polarity string")


def gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Gate scores are kept as a table, for every later step ranks and joins them."""
    from arbitra.operators.retrieval import bm25

    return materialize(bm25(texts(spark, sf), cat.GATE_QUERIES).withColumnRenamed("query_id", "gate_id"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return reviews(spark, sf).select("review_id", "business_id")


def sparse_z(spark: SparkSession, sf: str) -> SparseScores:
    return contrast(gates(spark), gate_scores(spark, sf), pool(spark, sf), cat.PRIMITIVE_IDS, cat.GAMMA)


def tagged_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents count as verified; their events are the large model's fields."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    rows = large_model(spark, sf).join(labelled, "review_id", "left_semi")
    text = reviews(spark, sf).select("review_id", F.length("text").alias("n"))
    event = F.struct(
        F.lit("e1").alias("event_id"), F.concat(F.lit("event of "), F.col("review_id")).alias("snippet"),
        F.transform_values("fields", lambda _, v: F.array(v)).alias("fields"),
    )
    return rows.join(text, "review_id").select("review_id", "business_id", F.array(event).alias("events"))
