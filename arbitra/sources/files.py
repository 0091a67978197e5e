"""Readers and writers: format registry, samples, topic hits, truth, results, specs."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, str], DataFrame]

_LOADERS: dict[str, Loader] = {}


def register_extension(extension: str, loader: Loader) -> None:
    """S4 / UD3: a loader for a file extension such as ``.tsv``."""
    _LOADERS[extension.lower()] = loader


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension; an unknown one is an error."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in _LOADERS:
        raise ValueError(f"no loader for {extension or path!r}; known: {sorted(_LOADERS)}")
    return _LOADERS[extension](spark, path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema=None, list_field: str | None = None) -> DataFrame:
    """A JSON array gives its elements as rows; ``list_field`` names a list inside an object."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if list_field and list_field in df.columns:
        return df.select(F.explode(list_field).alias("r")).select("r.*")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S6."""
    df.write.mode(mode).json(path)


register_extension(".jsonl", read_jsonl)
register_extension(".json", lambda s, p: read_json(s, p, list_field="samples"))
register_extension(".parquet", lambda s, p: s.read.parquet(p))
register_extension(".csv", lambda s, p: s.read.option("header", True).csv(p))


def samples(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Heterogeneous rows as (sample_id, query, context, expected, metadata).

    The id is ``id``, else ``sample_id``, else the 1-based position; empty text and 0 count as
    absent.  ``position`` is a 0-based position column.
    """
    def first(names: Sequence[str]) -> Column:
        found = [F.nullif(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit("0")) for n in names if n in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    used = {"id", "sample_id", "query", "question", "context", "expected", "answer", position}
    rest = [c for c in rows.columns if c not in used]
    meta = F.map_filter(
        F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()
    ) if rest else F.create_map().cast("map<string,string>")
    return rows.select(
        F.coalesce(first(["id", "sample_id"]), (F.col(position) + 1).cast("string")).alias("sample_id"),
        F.coalesce(first(["query", "question"]), F.lit("")).alias("query"),
        first(["context"]).alias("context"),
        first(["expected", "answer"]).alias("expected"),
        meta.alias("metadata"),
    )


HIT_FIELDS = (
    "business_id string, name string, city string, state string, stars double, review_count long, "
    "categories string, max_critical_score double, max_high_score double, total_critical_score double, "
    "total_high_score double, critical_review_count long, high_review_count long"
)


def read_topic_hits(
    spark: SparkSession, pattern: str, multiline: bool = True, topic_pattern: str = r"([^/]+)\.json$"
) -> DataFrame:
    """Hit documents, topic from the file path, both severity lists as rows.

    Pretty-printed documents are ``multiline`` and take a task each; documents on single lines
    are split like any other text.
    """
    entry = f"array<struct<{HIT_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
    reader = spark.read.option("multiLine", multiline).schema(f"critical_list {entry}, high_list {entry}")
    topic = F.regexp_extract(F.col("_metadata.file_path"), topic_pattern, 1)
    docs = reader.json(pattern)
    both = [
        docs.select(topic.alias("topic"), F.lit(severity).alias("severity"), F.explode(f"{severity}_list").alias("r"))
        for severity in ("critical", "high")
    ]
    return both[0].unionByName(both[1]).select("topic", "severity", "r.*")


def first_listed(hits: DataFrame) -> DataFrame:
    """Business data from the first topic file (by name), critical list first."""
    info = F.struct("name", "city", "state", "stars", "review_count", "categories")
    return hits.groupBy("business_id").agg(F.min_by(info, F.struct("topic", "severity")).alias("i")).select("business_id", "i.*")


TRUTH_SCHEMA = (
    "policy_id string, k int, restaurants map<string, struct<name:string, ground_truth:struct<verdict:string, "
    "score:double, triggered_rule:string, incidents:array<struct<review_id:string, severity_field:string, "
    "severity_value:string, modifiers:array<string>>>>>>"
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth documents as one row per business; a missing verdict is "Unknown"."""
    docs = spark.read.option("multiLine", True).schema(TRUTH_SCHEMA).json(path)
    rows = docs.select("policy_id", "k", F.explode("restaurants").alias("business_id", "r"))
    gt = "r.ground_truth."
    return rows.select(
        "policy_id", "k", "business_id", "r.name",
        F.coalesce(F.col(gt + "verdict"), F.lit("Unknown")).alias("verdict"),
        F.col(gt + "score").alias("score"), F.col(gt + "triggered_rule").alias("triggered_rule"),
        F.col(gt + "incidents").alias("incidents"),
    )


def write_by_policy(verdicts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per (policy, k); rows of a folder come from several tasks."""
    verdicts.write.mode(mode).partitionBy("policy_id", "k").parquet(path)


RESULT_SCHEMA = (
    "run_id string, timestamp string, method string, policy_id string, mode string, accuracy double, "
    "auprc double, results array<struct<business_id:string, verdict:string, risk_score:double, error:string, "
    "prompt_tokens:long, completion_tokens:long, cost_usd:double, latency_ms:double>>"
)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents under ``.../run_N/results.json``; unreadable files drop out."""
    docs = (
        spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(RESULT_SCHEMA + ", _corrupt string").json(pattern)
    )
    number = F.regexp_extract(F.col("_metadata.file_path"), r"run_(\d+)/[^/]*$", 1).try_cast("int")
    return docs.where(F.col("_corrupt").isNull()).withColumn("run_number", number).drop("_corrupt")


def run_items(runs: DataFrame) -> DataFrame:
    """Per-sample rows of run documents."""
    return runs.select("run_id", "method", "policy_id", "mode", F.explode("results").alias("r")).select(
        "run_id", "method", "policy_id", "mode", "r.*"
    )


def write_run(runs: DataFrame, items: DataFrame, usage: DataFrame, base: str) -> None:
    """Appended run, item and usage tables."""
    for name, df in (("runs", runs), ("run_items", items), ("run_usage", usage)):
        df.write.mode("append").parquet(f"{base}/{name}")


SPEC_SCHEMA = (
    "verdict_rules struct<labels:array<string>, default_label:string, order:array<string>, rules:array<struct<"
    "label:string, default:boolean, connective:string, clauses:array<struct<clause_quote:string, min_count:int, "
    "logic:string, conditions:array<struct<field_id:string, values:array<string>>>>>>>>, "
    "terms array<struct<field_id:string, values:array<struct<value_id:string, description:string>>>>"
)


def read_spec_primitives(spark: SparkSession, path: str) -> DataFrame:
    """One row per clause of the non-default rules, ids ``label_clause_n``."""
    docs = spark.read.option("multiLine", True).schema(SPEC_SCHEMA).json(path)
    rules = docs.select(F.posexplode("verdict_rules.rules").alias("rule_ord", "r")).where(~F.coalesce("r.default", F.lit(False)))
    clauses = rules.select("rule_ord", "r.label", "r.connective", F.posexplode("r.clauses").alias("pos", "c"))
    count = F.coalesce(F.nullif(F.col("c.min_count"), F.lit(0)), F.lit(1))
    return clauses.select(
        F.concat_ws("_clause_", "label", (F.col("pos") + 1).cast("string")).alias("primitive_id"),
        "label", "rule_ord", F.coalesce("connective", F.lit("ANY")).alias("connective"),
        count.alias("min_count"), F.coalesce("c.logic", F.lit("ALL")).alias("logic"),
        F.coalesce("c.conditions", F.array().cast("array<struct<field_id:string,values:array<string>>>")).alias("conditions"),
    )


def read_spec_terms(spark: SparkSession, path: str) -> DataFrame:
    """Legal values per field."""
    docs = spark.read.option("multiLine", True).schema(SPEC_SCHEMA).json(path)
    terms = docs.select(F.explode("terms").alias("t"))
    return terms.select(F.col("t.field_id").alias("field"), F.posexplode("t.values").alias("ord", "v")).select(
        "field", "ord", "v.value_id", "v.description"
    )


GATE_SCHEMA = (
    "gates array<struct<gate_id:string, primitive_ids:array<string>, modality:string, polarity:string, "
    "query:string, created_by:string, created_iter:int>>"
)


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """Gate library, duplicates removed."""
    from arbitra.operators.retrieval import dedupe_gates

    docs = spark.read.option("multiLine", True).schema(GATE_SCHEMA).json(path)
    return dedupe_gates(docs.select(F.posexplode("gates").alias("pos", "g")).select("pos", "g.*")).drop("pos")


def write_gates(gates: DataFrame, path: str) -> None:
    """Gates as JSON lines."""
    gates.write.mode("errorifexists").json(path)


def read_judgment_document(spark: SparkSession, path: str) -> DataFrame:
    """A nested document topic -> review -> fields as rows."""
    docs = spark.read.option("wholetext", True).text(path)
    topics = docs.select(F.explode(F.from_json("value", "map<string, map<string, map<string, string>>>")).alias("topic", "reviews"))
    rows = topics.select("topic", F.explode("reviews").alias("review_id", "all"))
    meta = ["review_id", "date", "stars", "useful", "is_relevant"]
    flag = F.filter(F.map_entries("all"), lambda e: e["key"].rlike("^is_.*(related|relevant)$"))
    return rows.select(
        "topic", "review_id", F.get(flag, F.lit(0))["value"].try_cast("boolean").alias("is_relevant"),
        F.map_filter("all", lambda k, _: ~k.isin(meta) & ~k.rlike("^is_.*_related$")).alias("fields"),
        F.try_element_at("all", F.lit("date")).alias("date"),
        F.try_element_at("all", F.lit("stars")).try_cast("double").alias("stars"),
        F.try_element_at("all", F.lit("useful")).try_cast("int").alias("useful"),
    )


def load_policy(path: str) -> dict:
    """A YAML policy; ``extends`` fills in what the child leaves out.

    Sections of the child replace those of the parent one by one, scoring included.
    """
    import yaml

    with open(path) as f:
        child = yaml.safe_load(f)
    if not child.get("extends"):
        return child
    folder = os.path.dirname(path)
    parent = load_policy(os.path.join(folder, child["extends"] + ".yaml"))
    merged = {**parent, **child}
    normative = {**parent.get("normative", {}), **child.get("normative", {})}
    return {**merged, "overview": {**parent.get("overview", {}), **child.get("overview", {})}, "normative": normative}


def policy_from_document(doc: Mapping) -> dict:
    """The policy mapping that the verdict operators take."""
    norm = doc["normative"]
    out = {
        "policy_id": doc["policy_id"],
        "verdicts": list(norm["decision"].get("verdicts", [])),
        "rules": [
            {**r, "conditions": [c for c in r.get("conditions", []) if isinstance(c, Mapping)]}
            for r in norm["decision"]["rules"]
        ],
    }
    s = norm.get("scoring")
    if s:
        m = s.get("field_mapping", {})
        out["scoring"] = {
            "severity_field": m.get("severity_field", "incident_severity"),
            "value_labels": dict(m.get("value_mappings", {})),
            "severity_points": [(p["label"], p["points"]) for p in s.get("severity_points", [])],
            "modifiers": [(p["label"], p["points"]) for p in s.get("modifiers", [])],
            "modifier_fields": [(x["field"], x["value"], x["label"]) for x in m.get("modifier_mappings", [])],
            "recency_rules": s.get("recency_rules", []),
            "thresholds": s.get("thresholds", []),
        }
    return out


def load_terms(spark: SparkSession, documents: Mapping[str, str]) -> DataFrame:
    """Term YAML files per domain as (domain, domain_ord, term_id, ord, value_id, is_default)."""
    import yaml

    from arbitra.session import dimension

    rows = []
    for d, (domain, path) in enumerate(documents.items()):
        with open(path) as f:
            terms = yaml.safe_load(f) or {}
        for term, body in terms.items():
            for i, v in enumerate(body.get("values", [])):
                rows.append((domain, d, term, i, v["id"], v["id"] == body.get("default")))
    return dimension(spark, rows, "domain string, domain_ord int, term_id string, ord int, value_id string, is_default boolean")
