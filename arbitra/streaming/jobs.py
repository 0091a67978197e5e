"""Incremental jobs: response ingest, voting when a quota is complete, usage windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arbitra.operators.judgments import RAW_KEY, aggregate
from arbitra.session import materialize
from arbitra.sources.exchange import ingest, parse_envelopes
from arbitra.sources.stores import KeyedStore


def response_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """ST1: finished response files; the file source remembers what it has read."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(folder)
        .withColumn("arrived_at", F.col("_metadata.file_modification_time"))
    )


def deduplicated_envelopes(lines: DataFrame, lateness: str = "1 day") -> DataFrame:
    """ST1: repeats of a line go, inside the watermark.

    A custom id may come with two different answers; both pass, and the ballots decide.
    """
    return (
        lines.withColumn("line_hash", F.sha2("value", 256))
        .withWatermark("arrived_at", lateness)
        .dropDuplicatesWithinWatermark(["line_hash"])
    )


BALLOTS = "topic string, review_id string, model string, run int, payload string, fresh boolean, complete boolean"
#: Reviews are dealt to so many groups of state, for a call per group costs milliseconds of Python however
#: little it does.  A micro-batch reads and writes the state of the groups that it touches.
BUCKETS = 4096
BALLOT_STATE = "ballots binary"
HELD = pa.schema([("review", pa.string()), ("model", pa.string()), ("run", pa.int64()), ("arrived", pa.float64()), ("payload", pa.string()), ("expiry", pa.int64())])


def _packed(held: dict[str, dict], expiry: dict[str, int]) -> bytes:
    rows = [(review, m, r, t, p, expiry[review]) for review, own in held.items() for (m, r), (t, p) in own.items()]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), HELD)], schema=HELD))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[dict[str, dict], dict[str, int]]:
    held, expiry = {}, {}
    for review, m, r, t, p, e in zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)):
        held.setdefault(review, {})[m, r] = t, p
        expiry[review] = e
    return held, expiry


def ballots_of(quota: Mapping[str, int], keep_ms: int):
    """ST2: the state of a bucket of reviews: the answers of each, one per model and run.

    Of two answers with one id the later arrival wins, and of equal arrivals the one that sorts
    last, in whatever batches they come.  New answers leave as fresh; once the quota is complete,
    every change sends out all ballots to be counted again.  A review is forgotten once the
    watermark is ``keep_ms`` past its last answer; later answers to it are stored but only a batch
    vote counts them.
    """
    wanted = [(m, r) for m, n in quota.items() for r in range(1, n + 1)]
    columns = ["topic", "review_id", "model", "run", "payload", "fresh", "complete"]

    def step(key, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held, expiry = _unpacked(bytes(state.get[0])) if state.exists else ({}, {})
        touched, changed = set(), {}
        for frame in () if state.hasTimedOut else frames:
            for review, model, run, arrived, payload in zip(frame.review_id, frame.model, frame.run, frame.arrived, frame.payload):
                own, of, new = held.setdefault(review, {}), (model, int(run)), (arrived.timestamp(), payload)
                old = own.get(of)
                touched.add(review)
                if old is None or new > old:
                    own[of] = new
                    if old is None or old[1] != payload:
                        changed.setdefault(review, set()).add(of)
        for review in touched:
            last = int(1000 * max(t for t, _ in held[review].values()))
            expiry[review] = max(last + keep_ms, now + 1)
        for review in [r for r, at in expiry.items() if at < now and r not in touched]:
            del held[review], expiry[review]
        if held:
            state.update((_packed(held, expiry),))
            state.setTimeoutTimestamp(max(min(expiry.values()), now + 1))
        elif state.exists:
            state.remove()
        out = []
        for review, new in changed.items():
            own = held[review]
            complete = all(of in own for of in wanted)
            out += [(key[0], review, *of, own[of][1], of in new, complete) for of in sorted(own) if complete or of in new]
        if out:
            yield pd.DataFrame(out, columns=columns)

    return step


def ballot_stream(
    judged: DataFrame, quota: Mapping[str, int], keep_ms: int = 30 * 24 * 3_600_000, buckets: int = BUCKETS
) -> DataFrame:
    """ST2: fresh and countable ballots of a stream of (topic, review_id, model, run, arrived, payload)
    with a watermark on ``arrived``.  ``buckets`` stays as it is for the life of a checkpoint."""
    dealt = judged.withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(buckets)))
    return dealt.groupBy("topic", "bucket").applyInPandasWithState(
        ballots_of(quota, keep_ms), BALLOTS, BALLOT_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


PAYLOAD = "business_id string, is_relevant boolean, fields map<string,string>, date string, stars double, useful long"


def vote_stream(
    lines: DataFrame, reviews: DataFrame, topic: str, schema: Mapping[str, Sequence[str]],
    quota: Mapping[str, int], weights: Mapping[str, int], raw: KeyedStore, voted: KeyedStore,
    checkpoint: str, lateness: str = "1 day",
) -> DataStreamWriter:
    """ST1, ST2: store raw judgements as they arrive and vote on reviews that are complete.

    Ballots live in keyed state, so no micro-batch reads a store.  Both stores keep the newest
    version per key, and a batch is written under its own version, so a replayed batch changes
    nothing.  Of equal weights the first ballot by model and run decides.
    """
    distinct = deduplicated_envelopes(lines, lateness)
    new = ingest(parse_envelopes(distinct, ["arrived_at"]), reviews, topic, schema, ["arrived_at"])
    payload = F.to_json(F.struct(
        "business_id", "is_relevant", "fields", F.col("date").cast("string").alias("date"),
        F.col("stars").cast("double").alias("stars"), F.col("useful").cast("long").alias("useful"),
    ))
    judged = new.select("topic", "review_id", "model", F.col("run").cast("int").alias("run"), F.col("arrived_at").alias("arrived"), payload.alias("payload"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch)
        version = F.lit(batch_id).cast("long")
        rows = batch.withColumn("p", F.from_json("payload", PAYLOAD)).select("topic", "review_id", "model", "run", "p.*", "fresh", "complete")
        ordered = rows.withColumn("ord", F.struct("model", "run"))
        raw.append(ordered.where("fresh").drop("fresh", "complete").withColumn("extracted_at", version))
        votes = aggregate(ordered.where("complete"), schema, weights)
        voted.append(votes.withColumn("aggregated_at", version))

    stream = ballot_stream(judged, quota).writeStream.outputMode("update")
    return stream.foreachBatch(step).option("checkpointLocation", checkpoint)


def usage_windows(usage: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """ST3: calls, tokens and cost per window and model; works on streams and tables."""
    marked = _timed(usage, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _totals(marked.groupBy(window.alias("w"), "model"))


def usage_sessions(usage: DataFrame, gap: str = "30 minutes", key: str = "model", late: str = "1 hour") -> DataFrame:
    """ST3: session windows per key."""
    marked = _timed(usage, late)
    return _totals(marked.groupBy(F.session_window("ts", gap).alias("w"), key))


def _timed(usage: DataFrame, late: str) -> DataFrame:
    return usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _totals(grouped) -> DataFrame:
    out = grouped.agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


__all__ = ["RAW_KEY", "ballot_stream", "ballots_of", "deduplicated_envelopes", "response_stream", "usage_sessions", "usage_windows", "vote_stream"]
