"""Sources, sinks and streams, over files written from the driver's tables.

Each query writes whole tables to its own folder under the shared scratch folder and reads
them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arbitra.operators import topics, validation
from arbitra.plans import adapters as ad
from arbitra.plans import catalog as cat
from arbitra.plans.registry import longs, query, r6
from arbitra.session import shared_dir
from arbitra.sources import exchange, files, stores
from arbitra.streaming import jobs


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def envelopes(spark, sf):
    """Response lines for all raw judgements; labelled toxic documents failed, run 3 is fenced."""
    failed = ad.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("review_id"), F.lit(True).alias("failed"))
    rows = ad.raw_judgments(spark, sf).join(failed, "review_id", "left")
    answer = F.expr("to_json(map_concat(map('review_id', review_id, 'is_relevant', string(is_relevant)), map_filter(fields, (k, v) -> k <> 'staff_response')))")
    content = F.when(F.col("run") == 3, F.concat(F.lit("Here:\n```json\n"), answer, F.lit("\n```"))).when(F.col("run") == 2, F.concat(answer, F.lit(" trailing words"))).otherwise(answer)
    line = F.struct(
        F.expr("concat_ws('::', 'policy', topic, business_id, review_id, model, concat('run', run)) AS custom_id"),
        F.when(F.col("failed"), F.struct(F.lit("rate_limit").alias("code"), F.lit("slow down").alias("message"))).alias("error"),
        F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response"),
    )
    return rows.select(F.to_json(line).alias("value"))


@query("response_ingest", ["raw", "reviews"], """
    SELECT review_id, model, run, is_relevant, incident_severity, CASE WHEN is_relevant THEN 'none' END AS staff_response, date FROM raw JOIN reviews USING (review_id)
    WHERE run <> 2 AND review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    """S14, J10, X5, X7, X20; answers with trailing words are unreadable."""
    got = exchange.ingest(exchange.parse_envelopes(envelopes(spark, sf)), ad.reviews(spark, sf), cat.TOPIC, cat.FIELDS)
    f = F.col("fields")
    return got.select(
        "review_id", "model", *longs("run"), "is_relevant", f["incident_severity"].alias("incident_severity"),
        F.try_element_at(f, F.lit("staff_response")).alias("staff_response"), "date",
    )


@query("response_errors", ["raw"], """
    SELECT review_id || ':' || run || ':' || model AS id, 'rate_limit' AS code FROM raw WHERE review_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    """S14, side output."""
    errors = exchange.response_errors(exchange.parse_envelopes(envelopes(spark, sf)), cat.TOPIC)
    p = F.split("custom_id", "::")
    return errors.select(F.concat_ws(":", p[3], F.replace(p[5], F.lit("run"), F.lit("")), p[4]).alias("id"), "code")


@query("loose_answers", ["raw"], "SELECT review_id, model, run, incident_severity FROM raw")
def _(spark, sf):
    """X5, forgiving form: the object is cut out of the surrounding words."""
    e = exchange.parse_envelopes(envelopes(spark, sf)).select("id", exchange.loose_answer(F.col("content")).alias("a"))
    return e.select("id.review_id", "id.model", F.col("id.run").cast("long").alias("run"), F.col("a")["incident_severity"].alias("incident_severity"))


@query("multi_review_answers", ["raw"], """
    SELECT review_id, is_relevant AND model = 'm-large' AS is_relevant, CASE WHEN model = 'm-large' THEN NULL ELSE 'invalid_review_id:' || review_id END AS error FROM raw WHERE run = 1""")
def _(spark, sf):
    """The small model answers for reviews nobody asked for."""
    raw = ad.raw_judgments(spark, sf).where("run = 1")
    item = F.concat(F.lit('[{"review_id": "'), F.col("review_id"), F.lit('", "is_relevant": "'), F.col("is_relevant").cast("string"), F.lit('"}]'))
    asked = F.array(F.when(F.col("model") == "m-large", F.col("review_id")).otherwise(F.lit("other")))
    rows = raw.select(F.concat(F.lit("Sure. "), item).alias("content"), asked.alias("review_ids"))
    return exchange.split_multi_review(rows).select("review_id", "is_relevant", "error")


@query("request_lines", ["stored", "reviews"], """
    SELECT 'policy::G1_service::' || business_id || '::' || review_id || '::m-small-x::run3' AS custom_id, length(text) AS text_chars FROM reviews
    WHERE pos NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    """S15, J6."""
    from arbitra.operators.judgments import missing_runs
    from arbitra.plans.judgment_queries import review_keys

    missing = missing_runs(review_keys(spark, sf), ad.stored_raw(spark, sf), cat.QUOTA)
    schema = {f: dict.fromkeys(vs, "-") for f, vs in cat.FIELDS.items()}
    lines = exchange.requests(missing, ad.reviews(spark, sf), schema, "service")
    content = F.from_json("value", "body struct<messages:array<struct<content:string>>>")["body"]["messages"][0]["content"]
    start = F.instr(content, "Review:\n") + 8
    stop = F.length(content) - F.length(F.substring_index(content, '\n\nAnswer with one JSON object: {"review_id": "', -1)) - F.lit(len('\n\nAnswer with one JSON object: {"review_id": "'))
    return lines.select("custom_id", (stop - start + 1).cast("long").alias("text_chars"))


@query("sample_responses", ["raw"], """
    SELECT review_id AS business_id, CASE incident_severity WHEN 'severe' THEN 'Critical Risk' WHEN 'none' THEN 'Low Risk' ELSE 'High Risk' END AS verdict,
           CASE WHEN incident_severity = 'mild' THEN 3.5e0 END AS risk_score, incident_severity <> 'mild' AS is_structured, 12 AS total_tokens FROM raw WHERE model = 'm-large'""")
def _(spark, sf):
    """S16, X6."""
    s = F.col("fields")["incident_severity"]
    content = F.when(s == "mild", "VERDICT: High Risk. FINAL_RISK_SCORE: 3.5").otherwise(
        F.concat(F.lit('{"verdict": "'), F.when(s == "severe", "CRITICAL").when(s == "moderate", "high risk").otherwise("Low Risk"), F.lit('"}'))
    )
    line = F.struct(
        F.concat(F.lit("sample::r1::"), F.col("review_id")).alias("custom_id"),
        F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
                          F.struct(F.lit(10).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")).alias("usage")).alias("body")).alias("response"),
    )
    out = exchange.ingest_samples(ad.large_model(spark, sf).select(F.to_json(line).alias("value")))
    return out.select("business_id", "verdict", "risk_score", "is_structured", "total_tokens")


@query("jsonl_round_trip", ["reviews"], "SELECT review_id, business_id, stars, sha1(text) AS digest FROM reviews")
def _(spark, sf):
    """S1, S4, S6."""
    path = scratch(spark, "reviews") + ".jsonl"
    files.write_jsonl(ad.reviews(spark, sf), path)
    return files.load(spark, path).select("review_id", "business_id", "stars", F.sha1("text").alias("digest"))


@query("sample_rows", ["reviews"], """
    SELECT CASE WHEN lang = 'en' THEN review_id ELSE CAST(pos + 1 AS VARCHAR) END AS sample_id, business_id AS query, lang AS metadata_lang FROM reviews WHERE review_id <> '0' OR lang <> 'en'""")
def _(spark, sf):
    """Rows without a usable id are named by position."""
    rows = ad.reviews(spark, sf).where("review_id <> '0' OR lang <> 'en'").select(
        F.when(F.col("lang") == "en", F.col("review_id")).otherwise("").alias("id"), F.col("business_id").alias("question"), "lang", "pos"
    )
    return files.samples(rows).select("sample_id", "query", F.col("metadata")["lang"].alias("metadata_lang"))


@query("topic_hit_files", ["biz_scores"], """
    SELECT topic, severity, business_id, ROUND(max_critical_score, 6) AS max_critical_score, ROUND(max_high_score, 6) AS max_high_score FROM biz_scores""")
def _(spark, sf):
    """Documents with a critical and a high list, in one folder per topic.

    Many small documents instead of one per topic, so that no list outgrows a task.
    """
    scored = topics.business_scores(topics.score_reviews(ad.texts(spark, sf), cat.TOPICS))
    listed = topics.with_business(scored, ad.businesses(spark, sf))
    entry = F.struct(*[c.split()[0] for c in files.HIT_FIELDS.split(", ")])
    lists = [F.when(F.col("severity") == s, F.array(entry)).alias(f"{s}_list") for s in ("critical", "high")]
    base = scratch(spark, "hits")
    listed.select("topic", *lists).write.partitionBy("topic").json(base)
    out = files.read_topic_hits(spark, f"{base}/*/*.json", multiline=False, topic_pattern="topic=([^/]+)/[^/]*$")
    return out.select("topic", "severity", "business_id", r6("max_critical_score"), r6("max_high_score"))


@query("truth_store", ["verdicts"], "SELECT policy_id, k, business_id, verdict FROM verdicts")
def _(spark, sf):
    """S18."""
    path = scratch(spark, "truth")
    files.write_by_policy(ad.verdict_table(spark, sf), path)
    return spark.read.parquet(path).select("policy_id", *longs("k"), "business_id", "verdict")


@query("raw_store", ["raw"], "SELECT review_id, model, run, incident_severity FROM raw")
def _(spark, sf):
    """A second batch with the same keys replaces the first."""
    store = stores.raw_judgments(scratch(spark, "raw"))
    raw = ad.raw_judgments(spark, sf)
    stale = raw.withColumn("fields", F.create_map(F.lit("incident_severity"), F.lit("stale")))
    store.append(stale.withColumn("extracted_at", F.lit(1)))
    store.append(raw.withColumn("extracted_at", F.lit(2)))
    return store.read(spark).select("review_id", "model", *longs("run"), F.col("fields")["incident_severity"].alias("incident_severity"))


@query("store_missing", ["stored"], "SELECT CAST(doc_id AS VARCHAR) AS review_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    """Wanted rows that are not stored yet."""
    store = stores.aggregated_judgments(scratch(spark, "agg"))
    labels = ad.table(spark, sf, "labels").select(F.lit(cat.TOPIC).alias("topic"), F.col("doc_id").cast("string").alias("review_id"), F.lit(1).alias("aggregated_at"))
    store.append(labels)
    wanted = ad.table(spark, sf, "documents").select(F.lit(cat.TOPIC).alias("topic"), F.col("doc_id").cast("string").alias("review_id"))
    return store.missing(wanted).select("review_id")


@query("rule_violations", ["reviews"], """
    SELECT review_id AS spec_id, v AS violation FROM reviews, (VALUES ('labels repeat'), ('a label has two rules')) x(v) WHERE lang = 'en'
    UNION ALL SELECT review_id, 'connective must be ANY or ALL' FROM reviews WHERE stars = 1""")
def _(spark, sf):
    """a label list per review, from its language; English ones repeat a label."""
    labels = F.array(F.col("lang"), F.lit("en"), F.lit("Low"))
    connective = F.when(F.col("stars") == 1, F.lit("SOME")).otherwise(F.lit("ANY"))
    specs = ad.reviews(spark, sf).select(
        F.col("review_id").alias("spec_id"), labels.alias("labels"), F.lit("Low").alias("default_label"), labels.alias("order"),
        F.transform(labels, lambda x: F.struct(x.alias("label"), (x == "Low").alias("default"), connective.alias("connective"))).alias("rules"),
    )
    return validation.rule_violations(specs)


@query("quotes_missing", ["claims"], "SELECT DISTINCT review_id AS id FROM claims WHERE lang = 'fr'")
def _(spark, sf):
    """F22, X17 in strict form, for quotes that are either cut from the text or invented."""
    rows = ad.claims(spark, sf).join(ad.reviews(spark, sf).select("review_id", "text", "lang"), "review_id")
    quote = F.when(F.col("lang") == "fr", F.col("snippet")).otherwise(F.col("text"))
    whole = rows.select(F.col("review_id").alias("id"), quote.alias("quote"), "text").distinct()
    return validation.quotes_missing(whole).select("id")


@query("stream_usage_windows", ["usage"], """
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start_at, model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens FROM usage GROUP BY start_at, model""")
def _(spark, sf):
    """ST3 as a stream: updates are upserted by (window, model), so late updates win."""
    schema = ad.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    calls = events.select(
        "ts", F.col("event_type").alias("model"), F.floor(F.col("value") * 100).alias("prompt_tokens"), F.lit(0.0).alias("cost_usd")
    )
    store = stores.KeyedStore(scratch(spark, "windows"), ("start", "model"), "batch")

    def step(batch, batch_id):
        store.append(batch.withColumn("batch", F.lit(batch_id).cast("long")))

    stream = jobs.usage_windows(calls).writeStream.outputMode("update").foreachBatch(step)
    stream.option("checkpointLocation", scratch(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return store.read(spark).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "model", "calls", "prompt_tokens")


@query("stream_votes", ["votes", "overrides"], """
    SELECT review_id, value AS incident_severity FROM votes WHERE field = 'incident_severity' AND review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    """ST1, ST2: response files in, votes of complete reviews out."""
    folder = scratch(spark, "responses")
    rows = ad.raw_judgments(spark, sf)
    failed = ad.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("review_id"))
    late = rows.join(failed, "review_id", "left_anti").unionByName(rows.where("run < 3").join(failed, "review_id", "left_semi").select(*rows.columns), allowMissingColumns=True)
    answer = F.expr("to_json(map_concat(map('is_relevant', string(is_relevant)), fields))")
    line = F.struct(
        F.expr("concat_ws('::', 'policy', topic, business_id, review_id, model, concat('run', run)) AS custom_id"),
        F.struct(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response"),
    )
    # Two deliveries: the large model and first runs, then the rest with the first runs again; the
    # second has each line twice.
    for part, times in (("run = 1", 1), ("run >= 1", 2)):
        lines = late.where(part).select(F.to_json(line).alias("value"))
        for _ in range(1, times):
            lines = lines.unionAll(lines)
        lines.write.mode("append").text(folder)
    raw, voted = stores.raw_judgments(scratch(spark, "raw")), stores.aggregated_judgments(scratch(spark, "voted"))
    job = jobs.vote_stream(
        jobs.response_stream(spark, folder), ad.reviews(spark, sf), cat.TOPIC, cat.FIELDS, cat.QUOTA, cat.WEIGHTS, raw, voted, scratch(spark, "ck")
    )
    job.trigger(availableNow=True).start().awaitTermination()
    return voted.read(spark).select("review_id", F.col("fields")["incident_severity"].alias("incident_severity"))


@query("run_store", ["usage"], """
    SELECT CAST(user_id AS VARCHAR) AS run_id, COUNT(*) AS items, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens FROM usage GROUP BY user_id""")
def _(spark, sf):
    """Run, item and usage tables, appended and read back."""
    from arbitra.operators.usage import run_totals
    from arbitra.plans.evaluation_queries import run_items

    base = scratch(spark, "runs")
    items = run_items(spark, sf)
    files.write_run(run_totals(items), items, ad.usage(spark, sf).drop("context"), base)
    back = spark.read.parquet(f"{base}/run_items")
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.sum("prompt_tokens").alias("prompt_tokens"))
