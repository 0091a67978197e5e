"""Expressions over enum values, verdict labels, judgement maps and composite ids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes ignored when two enum values are compared loosely.
LOOSE_SUFFIXES = [" incident", " reaction", " risk", " level", " quality"]

# Wordings that stand for a severity level.
SEVERITY_SYNONYMS = {
    "none": [
        "none", "no", "n/a", "na", "not applicable", "no incident", "no reaction", "no allergy",
        "no allergy incident", "no allergic reaction", "no relevant incident", "not relevant",
        "irrelevant", "no issue", "no issues", "no problem", "no problems", "nothing", "absent",
        "no symptoms",
    ],
    "mild": [
        "mild", "minor", "slight", "minimal", "low", "mild incident", "mild reaction",
        "minor incident", "minor reaction", "discomfort",
    ],
    "moderate": [
        "moderate", "medium", "moderate incident", "moderate reaction", "some symptoms",
        "noticeable",
    ],
    "severe": [
        "severe", "serious", "critical", "high", "extreme", "severe incident", "severe reaction",
        "life-threatening", "life threatening", "emergency", "anaphylaxis", "anaphylactic",
        "hospitalization", "hospital",
    ],
}
# Fragments that decide the severity level, in order of precedence.
NONE_FRAGMENTS = ["no ", "none", "n/a", "not ", "absent", "nothing", "irrelevant"]
LEVEL_FRAGMENTS = ["mild", "moderate", "severe", "serious", "critical", "emergency", "life"]
SEVERITY_FRAGMENTS = [
    ("severe", ["life-threatening", "life threatening", "anaphyla", "emergency", "hospital",
                "severe", "serious", "critical"]),
    ("moderate", ["moderate", "medium"]),
    ("mild", ["mild", "minor", "slight"]),
]

ARROW = "→"


def lit_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def spelled(word: Column, spellings: Mapping[str, str]) -> Column:
    """What a word stands for in a map of spellings, null for any other word.

    The map is one literal, so the word is computed once however many spellings there are.
    """
    if not spellings:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in spellings.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), word)


def has_fragment(text: Column, fragments: Sequence[str]) -> Column:
    """Does the text contain a literal?  One pattern instead of a test for each."""
    return text.rlike("|".join(re.escape(f) for f in fragments))


def field(fields: Column, name: str) -> Column:
    """Value of a map key: exact, lower, upper, then any case."""
    choices = [fields[n] for n in dict.fromkeys((name, name.lower(), name.upper()))]
    any_case = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(*choices, F.get(any_case, F.lit(0))["value"])


def lower_keys(fields: Column) -> Column:
    """X9, one pass: all keys lower-cased; of keys that collide the lower-case one is kept."""
    names = F.array_distinct(F.transform(F.map_keys(fields), F.lower))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.coalesce(
                    F.try_element_at(fields, n),
                    F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == n)[0]["value"],
                ).alias("value"),
            ),
        )
    )


def repair_enum(value: Column, legal: Sequence[str]) -> Column:
    """An illegal or missing value becomes the first legal one."""
    return F.when(value.isin(list(legal)), value).otherwise(F.lit(legal[0]))


def repair_judgment(fields: Column, relevant: Column, schema: Mapping[str, Sequence[str]]) -> Column:
    """X7 over a field map; rows that are not relevant pass through unchanged."""
    others = F.map_filter(fields, lambda k, _: ~k.isin(list(schema)))
    fixed = F.create_map(
        *[
            part
            for name, legal in schema.items()
            for part in (F.lit(name), repair_enum(fields[name], legal))
        ]
    )
    return F.when(F.coalesce(relevant, F.lit(False)), F.map_concat(others, fixed)).otherwise(fields)


def normalize_enum(value: Column, legal: Sequence[str]) -> Column:
    """Exact, then synonym, then (severity enums) fragment match; otherwise unchanged."""
    v = F.lower(F.trim(value))
    by_lower = {x.lower(): x for x in legal}
    spellings = dict(by_lower)
    for level, wordings in SEVERITY_SYNONYMS.items():
        if level in by_lower:
            spellings = {w: by_lower[level] for w in wordings} | spellings
    choices = [spelled(v, spellings)]
    if set(by_lower) & set(SEVERITY_SYNONYMS):
        if "none" in by_lower:
            blank = has_fragment(v, NONE_FRAGMENTS) & ~has_fragment(v, LEVEL_FRAGMENTS)
            choices.append(F.when(blank, F.lit("none")))
        for level, fragments in SEVERITY_FRAGMENTS:
            if level in by_lower:
                choices.append(F.when(has_fragment(v, fragments), F.lit(level)))
    return F.coalesce(*choices, value)


def strict_enum(value: Column, legal: Sequence[str]) -> Column:
    """struct(ok, value) after normalising; a missing value is accepted."""
    norm = normalize_enum(value, legal)
    canon = None
    for x in legal:
        hit = F.lower(F.trim(norm)) == x.lower()
        canon = F.when(hit, F.lit(x)) if canon is None else canon.when(hit, F.lit(x))
    return F.struct(
        (value.isNull() | canon.isNotNull()).alias("ok"), F.coalesce(canon, norm).alias("value")
    )


def loosely_equal(actual: Column, expected: Column) -> Column:
    """Equal, one contained in the other, or equal without a common suffix."""
    a, e = F.lower(F.trim(actual)), F.lower(F.trim(expected))

    def bare(c: Column) -> Column:
        for suffix in LOOSE_SUFFIXES:
            c = F.replace(c, F.lit(suffix), F.lit(""))
        return c

    return F.contains(a, e) | F.contains(e, a) | (bare(a) == bare(e))


def known_value(judgement: Column, values: Sequence[str]) -> Column:
    """X11: the judgement itself if known, else the first listed value it contains."""
    j = F.lower(judgement)
    out = F.when(j.isin(list(values)), j)
    for v in values:
        out = out.when(j.contains(v), F.lit(v))
    return out


def clean_label(label: Column) -> Column:
    """White space and quotes stripped from both ends; empty becomes null."""
    inner = F.regexp_replace(F.trim(label), "^['\"`]+|['\"`]+$", "")
    return F.nullif(F.trim(inner), F.lit(""))


def normalize_verdict(label: Column, verdicts: Sequence[str] | None = None) -> Column:
    """Clean label, mapped to the policy's spelling when it names one of its verdicts."""
    clean = clean_label(label)
    if not verdicts:
        return clean
    key = F.replace(F.lower(clean), F.lit("_"), F.lit(" "))
    return F.coalesce(spelled(key, {v.lower(): v for v in reversed(verdicts)}), clean)


def verdict_ordinal(label: Column, verdicts: Sequence[str]) -> Column:
    """M4: position in the ordered verdict list (lowest 0), null for an unknown label."""
    place = F.array_position(lit_array(verdicts), label)
    return (F.nullif(place, F.lit(0)) - 1).cast("int")


def verdict_from_rule(rule: Column) -> Column:
    """What follows the last arrow of a rule text."""
    def after(sep: str) -> Column:
        return F.trim(F.element_at(F.split(rule, sep), -1))

    return F.when(rule.contains(ARROW), after(ARROW)).when(rule.contains("->"), after("->"))


def same_field(left: Column, right: Column) -> Column:
    """Field names equal or contained, ignoring case, underscores and blanks."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[_ ]", "")

    a, b = bare(left), bare(right)
    return (a == b) | F.contains(b, a) | F.contains(a, b)


def same_value(left: Column, right: Column) -> Column:
    """X15."""
    return F.lower(F.trim(left)) == F.lower(F.trim(right))


def exact_match(output: Column, expected: Column) -> Column:
    """X34 / UD2: null expectation validates nothing."""
    return F.when(expected.isNotNull(), output.eqNullSafe(expected))


def preferred_order(names: Column, preferred: Sequence[str]) -> Column:
    """Preferred names that occur, then the rest in their own order."""
    return F.array_union(F.array_intersect(lit_array(preferred), names), names)


def relevant_flag(is_relevant: Column, legacy: Column | None = None) -> Column:
    """relevance with a legacy fallback column; unknown counts as not relevant."""
    parts = [is_relevant] + ([legacy] if legacy is not None else [])
    return F.coalesce(*parts, F.lit(False))


# --- ids and hashes ---------------------------------------------------------------------


def text_hash(text: Column) -> Column:
    """X19."""
    return F.sha1(F.coalesce(text, F.lit("")))


def gate_hash(modality: Column, polarity: Column, query: Column, primitive_ids: Column) -> Column:
    """The first 12 hex digits over modality, polarity, normalised query and sorted ids."""
    from .text import normalize

    base = F.concat_ws(
        ":", modality, polarity, normalize(query), F.array_join(F.sort_array(primitive_ids), ",")
    )
    return F.substring(F.sha1(base), 1, 12)


def schema_hash(canonical_json: Column) -> Column:
    """Version hash of a canonical (sorted-key) schema text."""
    return F.substring(F.sha2(canonical_json, 256), 1, 16)


def request_id(topic: Column, entity: Column, review: Column, model: Column, run: Column) -> Column:
    """``policy::topic::entity::review::model::runN``."""
    return F.concat_ws(
        "::", F.lit("policy"), topic, entity, review, model, F.concat(F.lit("run"), run.cast("string"))
    )


def parse_request_id(custom_id: Column) -> Column:
    """The parts of a request id, null when it is not one."""
    p = F.split(custom_id, "::")
    run = F.replace(F.get(p, F.lit(5)), F.lit("run"), F.lit("")).try_cast("int")
    ok = (F.size(p) == 6) & (F.get(p, F.lit(0)) == "policy") & run.isNotNull()
    names = ["topic", "business_id", "review_id", "model"]
    return F.when(
        ok,
        F.struct(*[F.get(p, F.lit(i + 1)).alias(n) for i, n in enumerate(names)], run.alias("run")),
    )


def parse_sample_id(custom_id: Column) -> Column:
    """``sample::run::entity``."""
    p = F.split(custom_id, "::")
    ok = (F.size(p) == 3) & (F.get(p, F.lit(0)) == "sample")
    return F.when(
        ok, F.struct(F.get(p, F.lit(1)).alias("run_id"), F.get(p, F.lit(2)).alias("business_id"))
    )


def model_quota(text: Column) -> Column:
    """``model:runs,model:runs`` as map<string,int>."""
    pairs = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.trim(F.regexp_extract(p, "^(.*):", 1)).alias("key"),
                F.regexp_extract(p, ":\\s*([0-9]+)\\s*$", 1).try_cast("int").alias("value"),
            ),
        )
    )


def parse_policy_id(policy_id: Column) -> Column:
    """``T1P3`` gives struct(topic T1, variant P3), anything else null."""
    pattern = r"^(T\d)(P\d)$"
    return F.when(
        policy_id.rlike(pattern),
        F.struct(
            F.regexp_extract(policy_id, pattern, 1).alias("topic"),
            F.regexp_extract(policy_id, pattern, 2).alias("variant"),
        ),
    )


def truth_policy_id(policy_id: Column, topic_names: Mapping[str, str]) -> Column:
    """Which truth a policy is measured against (P2: V2, P3: itself, other P: V1)."""
    parsed = parse_policy_id(policy_id)
    topic = None
    for t, name in topic_names.items():
        hit = parsed["topic"] == t
        topic = F.when(hit, F.lit(name)) if topic is None else topic.when(hit, F.lit(name))
    topic = topic.otherwise(parsed["topic"]) if topic is not None else parsed["topic"]
    version = F.when(parsed["variant"] == "P2", F.lit("V2")).otherwise(F.lit("V1"))
    return F.when(parsed.isNull() | (parsed["variant"] == "P3"), policy_id).otherwise(
        F.concat_ws("_", topic, version)
    )
