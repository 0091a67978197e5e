"""Reading structured answers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?(.*?)```"


def unfenced(text: Column) -> Column:
    """The inside of the first fenced block, or the text itself."""
    t = F.trim(text)
    return F.when(t.contains("```"), F.trim(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of the unfenced text."""
    t = unfenced(text)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(t)


def json_array(text: Column) -> Column:
    """From the first ``[`` to the last ``]`` of the unfenced text."""
    t = unfenced(text)
    inner = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return F.when(inner != "", inner).otherwise(t)


def string_map(text: Column) -> Column:
    """A JSON object as map<string,string>, null when the text is anything else.

    Read as the only element of a list, so that words after the object are not passed over.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(listed, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    # Wrapped once more, so that the text is parsed once and looked at twice.
    only = F.transform(F.array(parsed), lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))))
    return F.get(only, F.lit(0))


def bucket_verdict(label: Column) -> Column:
    """Low, critical, high are looked for in this order; other labels stay."""
    low = F.lower(label)
    return (
        F.when(low.contains("low"), F.lit("Low Risk"))
        .when(low.contains("critical"), F.lit("Critical Risk"))
        .when(low.contains("high"), F.lit("High Risk"))
        .otherwise(label)
    )


def verdict_in_text(text: Column) -> Column:
    """The verdict named in free text, null if none is."""
    # The two wordings that are recognised.
    labelled = r"(?i)(?:verdict)[:\s]*[\"']?([A-Za-z\s]+Risk)[\"']?"
    bare = r"(?i)(Low Risk|High Risk|Critical Risk)"
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (labelled, bare)]
    known = ["Low Risk", "Critical Risk", "High Risk"]
    return F.coalesce(
        *[F.when(bucket_verdict(F.trim(f)).isin(known), bucket_verdict(F.trim(f))) for f in found]
    )


def risk_score_in_text(text: Column) -> Column:
    """The number after FINAL_RISK_SCORE."""
    pattern = r"(?i)[\"']?FINAL_RISK_SCORE[\"']?[:\s]*([0-9]+\.?[0-9]*)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
