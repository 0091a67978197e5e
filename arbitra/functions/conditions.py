"""Predicates over judgement field maps, built from declared conditions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.values import field, loosely_equal, normalize_enum

Filter = Mapping[str, object]


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def one_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def equality_filter(fields: Column, spec: Filter) -> Column:
    """every named field equals its value, or is in its list; a missing field is ""."""
    parts = []
    for name, expected in spec.items():
        actual = F.coalesce(fields[name], F.lit(""))
        wanted = list(expected) if isinstance(expected, (list, tuple, set)) else [expected]
        parts.append(actual.isin([str(w) for w in wanted]))
    return all_of(parts)


def firsthand(fields: Column) -> Column:
    """rows without an account type count as first-hand."""
    account = fields["account_type"]
    return account.isNull() | (account == "firsthand")


def rich_filter(value: Callable[[str], Column], cond: Mapping) -> Column:
    """F8: key/value, key/list, field+equals / not_equals, and, or; values compared loosely.

    ``value`` gives the column of a field name.  A missing field matches nothing.
    """
    def matches(name: str, expected) -> Column:
        wanted = expected if isinstance(expected, (list, tuple)) else [expected]
        hit = one_of([loosely_equal(value(name), F.lit(str(w))) for w in wanted])
        return F.coalesce(hit, F.lit(False))

    parts = []
    if "field" in cond and "equals" in cond:
        parts.append(matches(cond["field"], cond["equals"]))
    if "field" in cond and "not_equals" in cond:
        parts.append(~matches(cond["field"], cond["not_equals"]))
    parts += [rich_filter(value, c) for c in cond.get("and", [])]
    if "or" in cond:
        parts.append(one_of([rich_filter(value, c) for c in cond["or"]]))
    special = {"field", "equals", "not_equals", "and", "or"}
    parts += [matches(k, v) for k, v in cond.items() if k not in special]
    return all_of(parts)


def fields_of(cond: Mapping) -> set[str]:
    """Names of the fields that a rich filter reads."""
    names = {cond["field"]} if "field" in cond else set()
    for part in (*cond.get("and", []), *cond.get("or", [])):
        names |= fields_of(part)
    return names | {k for k in cond if k not in ("field", "equals", "not_equals", "and", "or")}


def with_values(df: DataFrame, names: Sequence[str], enums: Mapping[str, Sequence[str]] | None = None):
    """The named fields as plain columns, enums normalised.

    Returns the frame and the function from a field name to its column.  Reading the map once
    keeps later expressions small.
    """
    legal = {k.lower(): v for k, v in (enums or {}).items()}
    lows = sorted({n.lower() for n in names})
    # Two steps, so that the map look-up is not repeated by every branch of the normalising.
    looked = df.select("*", *[field(F.col("fields"), n).alias(f"_r_{n}") for n in lows])
    normal = {n: normalize_enum(F.col(f"_r_{n}"), legal[n]) if n in legal else F.col(f"_r_{n}") for n in lows}
    out = looked.select(*df.columns, *[c.alias(f"_f_{n}") for n, c in normal.items()])
    return out, lambda name: F.col(f"_f_{name.lower()}")


def event_matches(fields: Column, conditions: Sequence[Mapping], logic: str = "ALL") -> Column:
    """``fields`` maps a field to the array of its values; no conditions match nothing."""
    parts = []
    for cond in conditions:
        if not cond.get("field_id"):
            continue
        allowed = F.array(*[F.lit(v) for v in cond.get("values", [])]).cast("array<string>")
        values = fields[cond["field_id"]]
        parts.append(F.coalesce(F.arrays_overlap(values, allowed), F.lit(False)))
    if not parts:
        return F.lit(False)
    return one_of(parts) if logic == "ANY" else all_of(parts)


def is_none_value(value: Column, none_values: Sequence[str]) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin([v.lower() for v in none_values])


def has_incident(
    fields: Column, names: Sequence[str], none_values: Sequence[str] = ("none", "n/a")
) -> Column:
    """some named field holds more than a none value; no names keep every row."""
    if not names:
        return F.lit(True)
    return one_of([~is_none_value(field(fields, n), none_values) for n in names])


def outcome_fields(program: Mapping) -> list[str]:
    """fields named by the where clauses of a program, without the account type."""
    names = {
        name.upper() for step in program.get("compute", []) for name in step.get("where", {})
    }
    return sorted(names - {"ACCOUNT_TYPE"})


def validated_expression(text: str, names: Sequence[str], functions: Sequence[str]) -> Column:
    """UD4: a user expression handed to Spark, after checking that it uses only given names
    and functions.  Spark parses it; a syntax error surfaces as Spark reports it."""
    import re

    bare = re.sub(r"'[^']*'", "''", text)
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", bare))
    keywords = {"and", "or", "not", "in", "case", "when", "then", "else", "end", "is", "null",
                "true", "false", "between", "like"}
    allowed = {n.lower() for n in names} | {f.lower() for f in functions} | keywords
    unknown = sorted(w for w in words if w.lower() not in allowed)
    if unknown or ";" in bare or "`" in bare:
        raise ValueError(f"expression uses unknown names: {unknown or text}")
    return F.expr(text)


# Functions a user expression may call.
EXPRESSION_FUNCTIONS = ["abs", "round", "floor", "ceil", "greatest", "least", "size", "length",
                        "lower", "upper", "contains", "coalesce", "exists", "sum", "min", "max"]


def user_flag(text: str, names: Sequence[str], default: bool = False) -> Column:
    """UD4: boolean form with a default for null."""
    expr = validated_expression(text, names, EXPRESSION_FUNCTIONS)
    return F.coalesce(expr.cast("boolean"), F.lit(default))


def user_number(text: str, names: Sequence[str], default: float = 0.0) -> Column:
    """UD4: float form; what cannot be read as a number becomes the default."""
    expr = validated_expression(text, names, EXPRESSION_FUNCTIONS)
    return F.coalesce(expr.try_cast("double"), F.lit(default))
