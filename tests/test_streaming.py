"""Keyed ballots: repeats, two answers with one id, a late run and a replayed job give the batch answer."""

import json

from pyspark.sql import functions as F

from arbitra.operators.judgments import aggregate
from arbitra.sources import stores
from arbitra.streaming import jobs

SCHEMA = {"mood": ["good", "bad", "none"]}
QUOTA, WEIGHTS = {"big": 1, "small": 2}, {"big": 2, "small": 1}


def line(review, model, run, mood):
    content = json.dumps({"is_relevant": True, "mood": mood})
    return json.dumps({"custom_id": f"policy::t::b::{review}::{model}::run{run}", "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_votes_of_a_stream_with_repeats(spark, scratch):
    reviews = spark.createDataFrame([(r, "b", "2020-01-01", 3.0, 1) for r in ("r1", "r2", "r3")], "review_id string, business_id string, date string, stars double, useful long")
    deliveries = [
        # r1: two answers with one id in one batch, and a line twice; r2 lacks a run.
        [line("r1", "big", 1, "bad"), line("r1", "big", 1, "good"), line("r1", "small", 1, "bad"), line("r1", "small", 1, "bad"), line("r1", "small", 2, "bad"), line("r2", "big", 1, "bad"), line("r2", "small", 1, "good")],
        # The late run of r2, an unknown review, and another answer of r1 that turns its vote.
        [line("r2", "small", 2, "good"), line("zz", "big", 1, "bad"), line("r1", "big", 1, "none"), line("r3", "big", 1, "good")],
        [line("r2", "small", 2, "good")],
    ]
    folder, raw, voted = f"{scratch}/in", stores.raw_judgments(f"{scratch}/raw"), stores.aggregated_judgments(f"{scratch}/voted")

    def run():
        job = jobs.vote_stream(jobs.response_stream(spark, folder), reviews, "t", SCHEMA, QUOTA, WEIGHTS, raw, voted, f"{scratch}/ck")
        job.trigger(availableNow=True).start().awaitTermination()

    for lines in deliveries:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)
        run()
        run()  # nothing new: nothing changes
    stored = {(r.review_id, r.model, r.run): r.fields["mood"] for r in raw.read(spark).collect()}
    assert stored == {
        ("r1", "big", 1): "none", ("r1", "small", 1): "bad", ("r1", "small", 2): "bad",
        ("r2", "big", 1): "bad", ("r2", "small", 1): "good", ("r2", "small", 2): "good", ("r3", "big", 1): "good",
    }
    full = raw.read(spark).where("review_id <> 'r3'").withColumn("ord", F.struct("model", "run"))
    want = {r.review_id: (r.is_relevant, r.fields, r.confidence) for r in aggregate(full, SCHEMA, WEIGHTS).collect()}
    got = {r.review_id: (r.is_relevant, r.fields, r.confidence) for r in voted.read(spark).collect()}
    assert got == want and set(got) == {"r1", "r2"}
