"""A bucket of reviews in one group of state: votes, late answers and forgetting, review by review."""

import pandas as pd

from arbitra.streaming import jobs

QUOTA = {"big": 1, "small": 2}


class State:
    """What a group's state is asked by the step."""

    def __init__(self):
        self.value, self.watermark, self.timer, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timer = at

    def remove(self):
        self.value = None


def call(step, state, rows, timed_out=False):
    state.hasTimedOut = timed_out
    frame = pd.DataFrame([(r, m, n, pd.Timestamp(at, unit="s"), p) for r, m, n, at, p in rows], columns=["review_id", "model", "run", "arrived", "payload"])
    out = [t for f in step(("t", 0), [frame], state) for t in f.itertuples(index=False, name=None)]
    return [o[1:] for o in out]


def test_reviews_of_a_bucket_do_not_touch_each_other():
    step, state = jobs.ballots_of(QUOTA, 10_000), State()
    out = call(step, state, [("a", "big", 1, 1, "x"), ("a", "small", 1, 1, "x"), ("b", "big", 1, 1, "x"), ("b", "big", 1, 1, "y"), ("a", "small", 2, 1, "z")])
    assert out == [("a", "big", 1, "x", True, True), ("a", "small", 1, "x", True, True), ("a", "small", 2, "z", True, True), ("b", "big", 1, "y", True, False)]
    assert state.timer == 11_000
    # Older answers and repeats change nothing, a newer one sends out all ballots of its review.
    assert call(step, state, [("a", "big", 1, 0, "w"), ("b", "big", 1, 1, "y")]) == []
    assert call(step, state, [("a", "big", 1, 5, "w")]) == [("a", "big", 1, "w", True, True), ("a", "small", 1, "x", False, True), ("a", "small", 2, "z", False, True)]
    assert state.timer == 11_000  # b's
    # b is forgotten after its own last answer, a stays.
    state.watermark = 11_001
    assert call(step, state, [], timed_out=True) == [] and state.timer == 15_000
    assert call(step, state, [("b", "big", 1, 1, "y")]) == [("b", "big", 1, "y", True, False)]  # as if new
    assert call(step, state, [("a", "small", 2, 6, "v")])[0] == ("a", "big", 1, "w", False, True)
    state.watermark = 16_001
    assert call(step, state, [], timed_out=True) == [] and not state.exists


def test_a_stream_holds_as_many_groups_as_buckets(spark, scratch):
    rows = [(f"r{i}", m, n) for i in range(300) for m, n in (("big", 1), ("small", 1), ("small", 2))]
    spark.createDataFrame(rows, "review_id string, model string, run int").write.parquet(f"{scratch}/in")
    lines = spark.readStream.schema("review_id string, model string, run int").parquet(f"{scratch}/in")
    judged = lines.selectExpr("'t' AS topic", "*", "timestamp'2020-01-01' AS arrived", "concat(review_id, model, run) AS payload").withWatermark("arrived", "1 day")
    seen = []
    stream = jobs.ballot_stream(judged, QUOTA, buckets=8).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect()))
    job = stream.option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted((r.review_id, r.model, r.run, r.payload) for r in seen) == sorted((*r, f"{r[0]}{r[1]}{r[2]}") for r in rows)
    assert all(r.fresh and r.complete and r.topic == "t" for r in seen)
    assert job.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
