"""Keyword and vector retrieval, gate scores, gate libraries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions import scoring as sc
from arbitra.functions.ranking import newest, top_per_key
from arbitra.functions.text import normalize, tokens
from arbitra.functions.values import gate_hash, text_hash
from arbitra.session import dimension, materialize


def query_terms(queries: Mapping[str, str]) -> dict[str, list[str]]:
    import re

    return {q: [t.lower() for t in re.findall("[A-Za-z0-9]+", text)] for q, text in queries.items()}


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Number of documents, mean length in tokens."""
    size = F.size(tokens(F.col("text")))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(size).alias("avg_len"), F.sum(size).alias("n_tokens"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """Documents per token; repeats inside a document fall away before the shuffle."""
    return (
        docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def bm25(docs: DataFrame, queries: Mapping[str, str], id_col: str = "review_id") -> DataFrame:
    """(query_id, id, score) of the rows that hold all terms of a query.

    Texts are read and cut into tokens once: a row's length and its counts of query terms are
    written, and corpus statistics, document frequencies and scores come from that narrow table.  A
    repeated query term counts again; a row that lacks a term of a several-term query scores 0 and
    is left out.  Rows with the same id are scored one by one.
    """
    spark = docs.sparkSession
    terms_of = {q: t for q, t in query_terms(queries).items() if t}
    vocabulary = sorted({t for ts in terms_of.values() for t in ts})
    if not vocabulary:
        return docs.select(F.lit("").alias("query_id"), id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    wanted = dimension(
        spark, [(q, t, ts.count(t), len(set(ts))) for q, ts in terms_of.items() for t in sorted(set(ts))],
        "query_id string, token string, times int, needed int",
    )
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), tokens(F.col("text")).alias("words"))
    kept = cut.select("row", "id", F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(vocabulary)).alias("hits"))
    counted = F.transform(
        F.array_distinct("hits"),
        lambda t: F.struct(t.alias("token"), F.size(F.filter("hits", lambda w: w == t)).alias("tf")),
    )
    rows = materialize(kept.select("row", "id", "dl", counted.alias("counted")))
    postings = rows.select("row", "id", "dl", F.explode("counted").alias("p")).select("row", "id", "dl", "p.token", "p.tf")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len")).alias("s"))
    gain = F.col("times") * sc.idf(F.col("s.n"), F.col("df")) * sc.bm25_weight(F.col("tf"), F.col("dl"), F.col("s.avg_len"))
    return (
        # No more rows than the queries have terms.
        postings.join(F.broadcast(wanted.join(df, "token")), "token")
        .withColumn("s", stats.scalar())
        .groupBy("query_id", "row")
        .agg(
            F.first("id").alias(id_col), F.sum(gain).alias("score"),
            F.count(F.lit(1)).alias("found"), F.first("needed").alias("needed"),
        )
        .where(F.col("found") == F.col("needed"))
        .select("query_id", id_col, "score")
    )


def bm25_topk(scores: DataFrame, k: int, id_col: str = "review_id") -> DataFrame:
    return top_per_key(scores, ["query_id"], [F.desc("score"), F.col(id_col)], k, "rank")


def gate_cosine(vectors: DataFrame, gates: Mapping[str, Sequence[float]], id_col: str = "review_id") -> DataFrame:
    """J16 + X21, gate form: (gate_id, id, score) of every vector under every gate vector.

    Gate vectors are configuration and travel as literals; the result is long by definition.
    """
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("gate_id"), F.array(*[F.lit(float(x)) for x in v]).alias("v"))
                for g, v in gates.items()
            ]
        )
    )
    return vectors.withColumn("g", each).select(
        F.col("g.gate_id").alias("gate_id"), id_col,
        sc.cosine(F.col("embedding"), F.col("g.v"), 1e-9).alias("score"),
    )


def similar_in_sample(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "review_id") -> DataFrame:
    """Best k vectors of each sample by cosine with the sample's own query vector.

    ``queries`` (sample_id, query), ``vectors`` (sample_id, id, embedding).  An equi-join on the
    sample, then k rows per sample and task; a sample with fewer than k vectors keeps them all;
    a missing vector has similarity 0.
    """
    joined = vectors.join(queries, "sample_id")
    scored = joined.select("sample_id", id_col, sc.cosine(F.col("query"), F.col("embedding")).alias("similarity"))
    return top_per_key(scored, ["sample_id"], [F.desc("similarity"), F.col(id_col)], k, "rank")


def hybrid(
    keyword: DataFrame, reviews: DataFrame, queries: DataFrame, min_hits: int, k: int, id_col: str = "review_id"
) -> DataFrame:
    """Keyword hits, plus the k most similar other reviews for samples with too few.

    ``keyword`` (sample_id, id), ``reviews`` (sample_id, id, embedding).  Samples with enough
    hits are dropped before any similarity is computed.
    """
    counts = keyword.groupBy("sample_id").agg(F.count(F.lit(1)).alias("hits"))
    poor = (
        queries.join(counts, "sample_id", "left")
        .where(F.coalesce("hits", F.lit(0)) < min_hits)
        .select("sample_id", "query")
    )
    unmatched = reviews.join(keyword.select("sample_id", id_col), ["sample_id", id_col], "left_anti")
    extra = similar_in_sample(poor, unmatched, k, id_col).select("sample_id", id_col, F.lit("vector").alias("origin"))
    return keyword.select("sample_id", id_col, F.lit("keyword").alias("origin")).unionByName(extra)


def reduced_context(chosen: DataFrame, businesses: DataFrame) -> DataFrame:
    """JSON of a business with its chosen reviews, most similar first.

    ``chosen`` (business_id, rank, review_id, text); at most k rows per business.
    """
    lists = chosen.groupBy("business_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "review_id", "text"))),
            lambda r: F.struct(r["review_id"].alias("review_id"), r["text"].alias("text")),
        ).alias("reviews")
    )
    nested = businesses.select("business_id", F.struct(*businesses.columns).alias("business"))
    return nested.join(lists, "business_id").select(
        "business_id", F.to_json(F.struct("business", "reviews")).alias("context")
    )


def missing_vectors(reviews: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Reviews whose text has no stored vector for the model, once per text."""
    wanted = reviews.select("review_id", text_hash(F.col("text")).alias("text_hash"))
    have = stored.where(F.col("model") == model).select("text_hash")
    absent = wanted.join(have, "text_hash", "left_anti")
    return absent.groupBy("text_hash").agg(F.min("review_id").alias("review_id"))


def missing_retrievals(samples: DataFrame, stored: DataFrame, top_k: int) -> DataFrame:
    """Samples without a stored retrieval for this number of reviews and k."""
    have = stored.where(F.col("top_k") == top_k).select("sample_id", "n_reviews")
    return samples.join(have, ["sample_id", "n_reviews"], "left_anti")


def missing_gates(gates: DataFrame, gate_scores: DataFrame) -> DataFrame:
    """Gates that have not been scored yet."""
    return gates.join(gate_scores.select("gate_id").distinct(), "gate_id", "left_anti")


def with_gate_ids(gates: DataFrame) -> DataFrame:
    return gates.withColumn(
        "gate_id", gate_hash(F.col("modality"), F.col("polarity"), F.col("query"), F.col("primitive_ids"))
    )


def dedupe_gates(gates: DataFrame) -> DataFrame:
    """U8: first gate per (primitives, modality, polarity, normalised query)."""
    keyed = gates.withColumn("_p", F.array_join(F.sort_array("primitive_ids"), ",")).withColumn(
        "_q", normalize(F.col("query"))
    )
    return newest(keyed, ["_p", "modality", "polarity", "_q"], [F.col("pos")]).drop("_p", "_q")


def find_gates(gates: DataFrame, primitive: str, modality: str | None = None, polarity: str | None = None) -> DataFrame:
    """F23."""
    out = gates.where(F.array_contains("primitive_ids", primitive))
    if modality:
        out = out.where(F.col("modality") == modality)
    return out.where(F.col("polarity") == polarity) if polarity else out


def substring_lookup(rows: DataFrame, text_col: str, table: Sequence[tuple[str, float]], default: float) -> DataFrame:
    """First table key contained in the text."""
    from arbitra.operators.formula import lookup

    return rows.withColumn("looked_up", lookup(F.col(text_col), dict(table), default))
