"""The tables exchanged with the external judges: requests out, responses in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.jsontext import (
    bucket_verdict, json_array, json_object, risk_score_in_text, string_map, unfenced,
    verdict_in_text,
)
from arbitra.functions.values import (
    parse_request_id, parse_sample_id, preferred_order, repair_judgment, request_id,
)

# The fields asked for first.
FIELD_ORDER = ["incident_severity", "account_type", "assurance_claim", "staff_response"]

ENVELOPE = (
    "custom_id string, error struct<code:string, message:string>, response struct<body:struct<choices:"
    "array<struct<message:struct<content:string>>>, usage:struct<prompt_tokens:long, completion_tokens:long>>>"
)


def ask(
    text: Column, review_id: Column, schema: Mapping[str, Mapping[str, str]], subject: str, text_limit: int | None = None
) -> Column:
    """The question put to a judge: field definitions, the review, the answer format.

    The whole text is sent unless the judge has a limit (F16; 8000 characters was usual).
    """
    names = [n for n in FIELD_ORDER if n in schema] + [n for n in schema if n not in FIELD_ORDER]
    definitions = "\n".join(
        f"{n.upper()}: {', '.join(schema[n])}\n" + "\n".join(f"  {v} = {d}" for v, d in schema[n].items())
        for n in names
    )
    answer = ", ".join(f'"{n}": "..."' for n in names)
    return F.concat(
        F.lit(f"Judge this review for {subject}.\n\n{definitions}\n\nReview:\n"),
        F.coalesce(text if text_limit is None else F.substring(text, 1, text_limit), F.lit("")),
        F.lit('\n\nAnswer with one JSON object: {"review_id": "'), review_id,
        F.lit(f'", "is_relevant": true or false, {answer}}}'),
    )


def requests(missing: DataFrame, reviews: DataFrame, schema, subject: str, text_limit: int | None = None) -> DataFrame:
    """Request lines for the missing extractions (topic, review_id, model, run)."""
    rows = missing.join(reviews.select("review_id", "business_id", "text"), "review_id")
    cid = request_id(F.col("topic"), F.col("business_id"), F.col("review_id"), F.col("model"), F.col("run"))
    message = F.struct(
        F.lit("user").alias("role"),
        ask(F.col("text"), F.col("review_id"), schema, subject, text_limit).alias("content"),
    )
    body = F.struct(F.col("model"), F.array(message).alias("messages"))
    line = F.struct(
        cid.alias("custom_id"), F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"), body.alias("body"),
    )
    return rows.select("model", cid.alias("custom_id"), F.to_json(line).alias("value"))


def write_requests(chunked: DataFrame, path: str) -> None:
    """One folder per (model, chunk)."""
    chunked.select("model", "chunk", "value").write.partitionBy("model", "chunk").text(path)


def parse_envelopes(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Response lines (column ``value``) with id parts, error and content; ``keep`` columns stay."""
    e = lines.select(F.from_json("value", ENVELOPE).alias("e"), *keep)
    return e.select(
        *keep,
        "e.custom_id",
        parse_request_id(F.col("e.custom_id")).alias("id"),
        F.col("e.error").alias("error"),
        F.get(F.col("e.response.body.choices"), F.lit(0))["message"]["content"].alias("content"),
        F.col("e.response.body.usage").alias("usage"),
    )


def response_errors(envelopes: DataFrame, topic: str) -> DataFrame:
    """Side output of failed requests of a topic."""
    return envelopes.where((F.col("id.topic") == topic) & F.col("error").isNotNull()).select(
        "custom_id", "error.code", "error.message"
    )


def ingest(
    envelopes: DataFrame, reviews: DataFrame, topic: str, schema: Mapping[str, Sequence[str]], keep: Sequence[str] = ()
) -> DataFrame:
    """Raw judgements of a topic; ``keep`` columns of the envelopes stay.

    Lines of another topic, with an error, without content, of an unknown review or without a
    readable answer drop out.  Illegal values of relevant answers become the first legal one.
    """
    usable = envelopes.where(
        (F.col("id.topic") == topic) & F.col("error").isNull() & F.col("content").isNotNull()
    )
    # As a generator the answer is parsed once per line; a filter on it would parse it again.
    readable = F.explode(F.array_compact(F.array(string_map(unfenced(F.col("content"))))))
    answers = usable.select("id.*", readable.alias("a"), *keep)
    known = reviews.select("business_id", "review_id", "date", "stars", "useful")
    relevant = F.coalesce(
        F.try_element_at("a", F.lit("is_relevant")).try_cast("boolean"),
        F.try_element_at("a", F.lit("is_allergy_related")).try_cast("boolean"),
        F.lit(False),
    )
    meta = ["review_id", "is_relevant", "is_allergy_related"]
    fields = F.map_filter("a", lambda k, _: ~k.isin(meta))
    return answers.join(known, ["business_id", "review_id"]).select(
        "topic", "business_id", "review_id", "model", "run", relevant.alias("is_relevant"),
        repair_judgment(fields, relevant, schema).alias("fields"), "date", "stars", "useful", *keep,
    )


def ingest_samples(lines: DataFrame) -> DataFrame:
    """One result row per sample response; free text answers fall back to X6."""
    e = lines.select(F.from_json("value", ENVELOPE).alias("e"))
    rows = e.select(
        parse_sample_id(F.col("e.custom_id")).alias("id"), F.col("e.error.message").alias("error"),
        F.get(F.col("e.response.body.choices"), F.lit(0))["message"]["content"].alias("content"),
        F.col("e.response.body.usage").alias("usage"),
    ).where(F.col("id").isNotNull())
    parsed = string_map(unfenced(F.col("content")))
    prompt = F.coalesce("usage.prompt_tokens", F.lit(0))
    completion = F.coalesce("usage.completion_tokens", F.lit(0))
    return rows.withColumn("_p", parsed).select(
        "id.run_id", "id.business_id", "error",
        F.when(F.col("_p").isNotNull(), bucket_verdict(F.try_element_at("_p", F.lit("verdict"))))
        .otherwise(verdict_in_text(F.col("content"))).alias("verdict"),
        F.when(F.col("_p").isNull(), risk_score_in_text(F.col("content"))).alias("risk_score"),
        F.col("_p").isNotNull().alias("is_structured"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"), F.lit(None).cast("double").alias("latency_ms"),
    )


def split_multi_review(responses: DataFrame) -> DataFrame:
    """Answers for several reviews as rows.

    ``responses`` has content and the requested review_ids.  An id that was not asked for is
    marked and not relevant; an unreadable answer gives one not relevant row per request.
    """
    items = F.from_json(json_array(F.col("content")), "array<map<string,string>>")
    fallback = F.transform(
        "review_ids",
        lambda r: F.map_from_arrays(
            F.array(F.lit("review_id"), F.lit("is_relevant"), F.lit("_error")),
            F.array(r, F.lit("false"), F.lit("batch_parse_failed")),
        ),
    )
    rows = responses.select("review_ids", F.explode(F.coalesce(items, fallback)).alias("a"))
    rid = F.try_element_at("a", F.lit("review_id"))
    foreign = F.coalesce((rid != "") & ~F.array_contains("review_ids", rid), F.lit(False))
    error = F.when(foreign, F.concat(F.lit("invalid_review_id:"), rid)).otherwise(F.try_element_at("a", F.lit("_error")))
    relevant = F.coalesce(F.try_element_at("a", F.lit("is_relevant")).try_cast("boolean"), F.lit(False)) & ~foreign
    return rows.select(
        rid.alias("review_id"), relevant.alias("is_relevant"), error.alias("error"),
        F.map_filter("a", lambda k, _: ~k.isin("review_id", "is_relevant", "_error")).alias("fields"),
    )


def loose_answer(content: Column) -> Column:
    """X5, single form: fields of the first object in a text, null if unreadable."""
    return string_map(json_object(content))


def ordered_fields(fields: Column) -> Column:
    """X38 for a field map."""
    return preferred_order(F.map_keys(fields), FIELD_ORDER)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")
