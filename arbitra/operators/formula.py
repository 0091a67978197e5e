"""Formula programs: declared count / sum / expr / lookup / case steps over extraction rows.

A program is a mapping ``{"extract": {"fields": [{"name", "type", "values"}], "none_values"},
"compute": [step, ...], "output": [names], "scoring": {"recency_rules": {"rules": [...]}},
"_abstain": bool}``.  Extraction rows carry ``business_id, review_id, fields`` (and ``date``).
All row-level steps share one ``groupBy(business_id)``; later steps are plain columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.conditions import (
    EXPRESSION_FUNCTIONS, fields_of, has_incident, is_none_value, outcome_fields, rich_filter,
    validated_expression, with_values,
)
from arbitra.functions.scoring import age_years, recency_by_max_age
from arbitra.functions.text import quote_check
from arbitra.functions.values import ARROW, field, loosely_equal, strict_enum

CASE_BLOCK = re.compile(r"CASE\s+(.+?)\s+END", re.I | re.S)
EQUALS = re.compile(r"WHEN\s+(\w+)\s*=\s*(?:['\"]([^'\"]+)['\"]|(\w+))\s+THEN\s+(-?[\d.]+)", re.I)
MEMBER = re.compile(r"WHEN\s+(\w+)\s+IN\s*\(([^)]+)\)\s+THEN\s+(-?[\d.]+)", re.I)
ELSE = re.compile(r"ELSE\s+(-?[\d.]+)", re.I)
BOUND = re.compile(r"^\s*([<>=!]+)\s*(\d+(?:\.\d+)?)\s*$")
SQL_OPERATOR = {"==": "=", "!=": "<>"}


def enum_values(program: Mapping) -> dict[str, list[str]]:
    return {
        f["name"]: list(f["values"])
        for f in program.get("extract", {}).get("fields", [])
        if f.get("type") == "enum" and f.get("values")
    }


def case_points(text: str, value: Callable[[str], Column]) -> Column:
    """Per-row number of a CASE text; several blocks add up.

    Equality branches are tried before membership branches; equality is loose, membership is
    exact up to case.  ``value`` gives the column of a field name.
    """
    def actual(name: str) -> Column:
        return F.coalesce(value(name), F.lit(""))

    total = F.lit(0.0)
    for body in CASE_BLOCK.findall(text):
        branches = [
            (loosely_equal(actual(f), F.lit(quoted or bare)), float(n))
            for f, quoted, bare, n in EQUALS.findall(body)
        ]
        for f, values, n in MEMBER.findall(body):
            listed = [v.strip().strip("'\"").lower().strip() for v in values.split(",")]
            branches.append((F.lower(F.trim(actual(f))).isin(listed), float(n)))
        other = ELSE.search(body)
        out = F.lit(float(other.group(1)) if other else 0.0)
        for hit, n in reversed(branches):
            out = F.when(hit, F.lit(n)).otherwise(out)
        total = total + out
    return total


def _rules_column(source: Column, rules: Sequence[Mapping], names: Sequence[str], numeric: bool, default=None) -> Column:
    """First rule that holds.  ``when`` is a bound on the source, a condition over earlier
    names, or a value of the source."""
    out = None
    for rule in rules:
        if "else" in rule:
            last = F.lit(rule["else"])
            return out.otherwise(last) if out is not None else last
        text = str(rule.get("when", ""))
        bound = BOUND.match(text)
        if bound:
            number = source.try_cast("double")
            op, limit = bound.group(1), float(bound.group(2))
            hit = {
                "<": number < limit, "<=": number <= limit, ">": number > limit,
                ">=": number >= limit, "==": number == limit, "!=": number != limit,
            }.get(op, F.lit(False))
        elif any(re.search(rf"\b{re.escape(n)}\b", text) for n in names) and re.search("[<>=!]", text):
            sql = re.sub("==|!=", lambda m: SQL_OPERATOR[m.group(0)], text)
            hit = validated_expression(sql, names, EXPRESSION_FUNCTIONS)
        else:
            hit = F.lower(source.cast("string")) == text.lower()
        then = F.lit(float(rule["then"]) if numeric else rule["then"])
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, then) if out is None else out.when(hit, then)
    fallback = F.lit(default)
    return out.otherwise(fallback) if out is not None else fallback


def lookup(source: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    """Value of the first table key contained in the source, any case."""
    low = F.lower(F.coalesce(source, F.lit("")))
    out = None
    for key, value in table.items():
        hit = low.contains(key.lower())
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def lookup_joined(
    df: DataFrame, source: Column, table: DataFrame, default: float, out: str,
    key: str = "key", value: str = "value", order: str = "pos",
) -> DataFrame:
    """P5 / J12 for tables of any size: of the keys contained in the source, any case, the value of
    the one that is first by ``order``.

    Every substring of a source that is as long as some key is joined with the keys, so the work is
    sources x lengths, not sources x keys.  Equal sources are looked up once and carried as their
    digest.  The lengths are one array, at most as long as the longest key.  Null keys match
    nothing; an empty key is in every source; equal keys count as the first of them.  Sources are
    short strings (categories, names): each is cut once for every length.
    """
    entries = (
        table.select(F.lower(key).alias("_key"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_entry"))
        .where("_key IS NOT NULL").groupBy("_key").agg(F.min("_entry").alias("_entry"))
    )
    lengths = entries.agg(F.collect_set(F.length("_key")).alias("n")).scalar()
    text = F.lower(F.coalesce(source, F.lit("")))
    named = df.withColumn("_text", F.sha2(text, 256))
    fits = named.select("_text", text.alias("_low")).distinct().select(
        "_text", "_low", F.explode(lengths).alias("_n")
    ).where("_n <= length(_low)")
    cut = fits.select("_text", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1), lambda i: F.substring("_low", i, F.col("_n")))
    ).alias("_key"))
    first = cut.join(entries, "_key").groupBy("_text").agg(F.min("_entry").alias("_entry"))
    found = F.when(F.col("_entry").isNull(), F.lit(default)).otherwise(F.col("_entry")["v"])
    return named.join(first, "_text", "left").select(*df.columns, found.alias(out))


def incidents_only(extractions: DataFrame, program: Mapping) -> DataFrame:
    """rows with a non-none value in a field that the program counts."""
    none_values = program.get("extract", {}).get("none_values", ["none", "n/a"])
    return extractions.where(has_incident(F.col("fields"), outcome_fields(program), none_values))


def run_program(
    extractions: DataFrame, program: Mapping, businesses: DataFrame, context: Sequence[str] = ()
) -> DataFrame:
    """One row per business with every computed name.

    ``businesses`` has business_id and the ``context`` columns that lookups read.  Businesses
    without rows get 0 for counts and sums.  An abstaining program answers ABSTAIN everywhere.
    """
    if program.get("_abstain"):
        return businesses.select("business_id", F.lit("ABSTAIN").alias("VERDICT"))
    steps = program.get("compute", [])
    declared = {f["name"] for f in program.get("extract", {}).get("fields", [])}
    recency = program.get("scoring", {}).get("recency_rules", {}).get("rules")
    rows, value_of = with_values(extractions, sorted(_fields_read(steps, declared)), enum_values(program))

    def where(step: Mapping) -> Column:
        cond = step.get("where") or step.get("condition") or {}
        return rich_filter(value_of, cond) if cond else F.lit(True)

    def row_value(text: str) -> Column:
        if text.strip().upper().startswith("CASE"):
            return case_points(text, value_of)
        used = {w for w in re.findall(r"[A-Za-z_]\w*", text) if w in declared}
        for name in used:
            text = re.sub(rf"\b{name}\b", f"try_cast(_f_{name.lower()} AS double)", text)
        return F.expr(text).try_cast("double")

    aggregates = []
    for step in steps:
        name, op = step["name"], step.get("op") or step.get("operation")
        if op == "count":
            aggregates.append(F.count_if(where(step)).alias(name))
        elif op == "sum":
            value = row_value(step.get("expr", "1"))
            if recency:
                value = value * recency_by_max_age(age_years(F.col("date")), recency)
            aggregates.append(
                F.coalesce(F.sum(F.when(where(step), value)), F.lit(0.0)).alias(name)
            )
        elif op == "case" and step.get("source") in declared:
            source = F.coalesce(value_of(step["source"]), F.lit("none"))
            per_row = _rules_column(source, step["rules"], [], numeric=True, default=0.0)
            aggregates.append(F.coalesce(F.sum(per_row), F.lit(0.0)).alias(name))
        elif op == "expr":
            for n, block in enumerate(_case_blocks(step.get("expr", "0"))):
                aggregates.append(F.sum(case_points(block, value_of)).alias(f"_{name}_{n}"))
    aggregates.append(F.count(F.lit(1)).alias("_rows"))
    totals = rows.groupBy("business_id").agg(*aggregates)
    known = businesses.select("business_id", *[c for c in context]).join(totals, "business_id", "left")
    numeric = [c for c, t in totals.dtypes if c != "business_id"]
    out = known.fillna(0, subset=numeric)

    names = [a for a in numeric if not a.startswith("_")]
    for step in steps:
        name, op = step["name"], step.get("op") or step.get("operation")
        if op == "expr":
            text = step.get("expr", "0")
            parts = []
            for n, block in enumerate(_case_blocks(text)):
                text = text.replace(block, f"_{name}_{n}", 1)
                parts.append(f"_{name}_{n}")
            value = validated_expression(text, [*names, *parts], EXPRESSION_FUNCTIONS)
            out = out.withColumn(name, F.coalesce(value, F.lit(0)))
        elif op == "lookup":
            source = step.get("source", "")
            column = F.col(source[8:]) if source.startswith("context.") else F.col(source)
            out = out.withColumn(name, lookup(column, step.get("table", {}), step.get("default", 1.0)))
        elif op == "case" and step.get("source") not in declared:
            source = F.col(step["source"]) if step.get("source") in names else F.lit(0)
            default = step.get("default_verdict") or step.get("default")
            out = out.withColumn(name, _rules_column(source, step["rules"], names, False, default))
        if name not in names:
            names.append(name)
    return out.select("business_id", *dict.fromkeys(names), F.col("_rows").alias("extractions"))


def _fields_read(steps: Sequence[Mapping], declared: set[str]) -> set[str]:
    read = set(declared)
    for step in steps:
        read |= fields_of(step.get("where") or step.get("condition") or {})
        text = str(step.get("expr", ""))
        read |= {m[0] for m in EQUALS.findall(text)} | {m[0] for m in MEMBER.findall(text)}
    return read


def _case_blocks(text: str) -> list[str]:
    return [m.group(0) for m in CASE_BLOCK.finditer(text)]


def output_fields(results: DataFrame, program: Mapping) -> DataFrame:
    """The names the program declares as output, those that exist."""
    return results.select("business_id", *[n for n in program.get("output", []) if n in results.columns])


def triggered_rule(results: DataFrame, program: Mapping) -> Column:
    """Text of the rule behind the verdict, with the actual values."""
    step = next((s for s in program["compute"] if s["name"] == "VERDICT"), {"rules": [], "source": ""})
    names = [c for c in results.columns if c != "business_id"]
    out = None
    for rule in step["rules"]:
        label = str(rule.get("then", rule.get("else")))
        if "else" in rule:
            text = F.lit(f"else {ARROW} {label}")
        else:
            when = str(rule["when"])
            used = [n for n in names if re.search(rf"\b{n}\b", when)] or [step["source"]]
            shown = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in used])
            head = when if used != [step["source"]] else f"{step['source']} {when}"
            text = F.concat(F.lit(f"{head} (actual: "), shown, F.lit(f") {ARROW} {label}"))
        hit = F.col("VERDICT") == label
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out if out is not None else F.lit(None).cast("string")


def evidence(extractions: DataFrame, program: Mapping) -> DataFrame:
    """one row per enum field with a non-none value; ids E1.. inside each business, in the order
    of reviews and fields.  A business may hold any share of the rows."""
    from arbitra.functions.ranking import number_per_key

    none_values = program.get("extract", {}).get("none_values", ["none", "n/a"])
    skip = {"account_type", "description"}
    wanted = [n for n in enum_values(program) if n.lower() not in skip]
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(n.lower()).alias("field"), field(F.col("fields"), n).alias("value"))
            for i, n in enumerate(wanted)
        ]
    )
    rows = extractions.withColumn("e", F.explode(F.filter(entries, lambda e: ~is_none_value(e["value"], none_values))))
    flat = rows.select("business_id", "review_id", "e.field", F.lower("e.value").alias("judgement"), F.col("e.i").alias("_i"))
    numbered = number_per_key(flat, ["business_id"], [F.col("review_id"), F.col("_i")], "_n")
    return numbered.withColumn("evidence_id", F.concat(F.lit("E"), F.col("_n").cast("string"))).drop("_i", "_n")


def direct_evidence(evidence_rows: DataFrame, n: int = 5) -> DataFrame:
    """Ids of the first n evidence rows of each business."""
    from arbitra.functions.ranking import top_per_key

    order = [F.substring("evidence_id", 2, 20).cast("long")]
    few = top_per_key(evidence_rows, ["business_id"], order, n)
    return few.groupBy("business_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "evidence_id"))), lambda e: e["evidence_id"]).alias(
            "direct_evidence"
        )
    )


def validation_counts(extractions: DataFrame, program: Mapping) -> DataFrame:
    """Quote and enum checks of relevant extractions, counted by outcome.

    Rows carry ``is_relevant, quote, text, fields``.
    """
    enums = enum_values(program)
    blank = F.coalesce(F.trim("quote"), F.lit("")) == ""
    looked = extractions.where("is_relevant").select(
        blank.alias("blank"),
        quote_check(F.col("quote"), F.col("text"))["valid"].alias("valid"),
        *[field(F.col("fields"), n).alias(f"_r_{i}") for i, n in enumerate(enums)],
    )
    kept = ~F.col("blank") & F.col("valid")
    checks = [
        F.when(kept & F.col(f"_r_{i}").isNotNull(), strict_enum(F.col(f"_r_{i}"), v)["ok"])
        for i, v in enumerate(enums.values())
    ]
    count = lambda flag: sum((F.count_if(c == flag) for c in checks), F.lit(0))
    return looked.agg(
        F.count(F.lit(1)).alias("total_relevant"),
        F.count_if("blank").alias("rejected_no_quote"),
        F.count_if(~F.col("blank") & ~F.col("valid")).alias("rejected_quote_not_found"),
        F.count_if(kept).alias("valid_quotes"),
        count(True).alias("enum_valid"),
        count(False).alias("enum_rejected"),
    )
