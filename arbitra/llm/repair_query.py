"""op13: damaged conversations, repaired, and the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.registry import query
from arbitra.llm.repair import digests, repair
from arbitra.llm.tables import read

#: Remainder of the row's checksum -> what becomes of the row.
DROP, EMPTY, STOPLESS, REPEAT, RENAME = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the contract's faults; other columns stay."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    marked = rows.withColumns({"_kind": kind, "role": space("role"), "text": space("text")}).where(F.col("_kind") != DROP)
    text = F.when(F.col("_kind") == EMPTY, "").when(F.col("_kind") == STOPLESS, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == RENAME, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("_kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.withColumns({"text": text, "role": role}).withColumn("_copy", twice).drop("_copy", "_kind")


def _key(of: str, more: str, letter: str) -> str:
    """Cost and audit as one string in nine digits and letters, with an edit added."""
    return f"(lpad((left({of}, 9)::INT + {more})::VARCHAR, 9, '0') || substr({of}, 10) || '{letter}')"


def _sql() -> str:
    bits = "list_concat([4294967295], flatten(list_transform(string_split(name, ''), lambda c: list_transform(range(0, 8), lambda b: (ascii(c) >> b) & 1))))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)), 4294967295)"
    more = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    able = "fault IN (0, 3)"
    keep = lambda of, initial: f"CASE WHEN {able} AND initial = '{initial}' THEN {_key(of, more, 'K')} END"
    name = lambda of: f"CASE WHEN {able} THEN {_key(of, f'1 + {more}', 'R')} END"
    gone = lambda of: _key(of, "2", "D")
    made = lambda of: _key(of, "5", "I")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
kinds AS (SELECT *, ({crc}) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    right(rtrim(text, {white}), 1) AS last_char, left(role, 1) AS initial
  FROM damaged),
faulty AS MATERIALIZED (
  SELECT *, CASE WHEN last_char = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN last_char NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM faulty
  UNION ALL
  SELECT conv_id, i, n0, n1, least(n2, {made('n3')}), least(n3, {made('n2')}) FROM (
    SELECT conv_id, i, n0, n1, least(n2, {made('n0')}, {made('n1')}, {made('n3')}) AS n2, least(n3, {made('n2')}) AS n3 FROM (
      SELECT f.conv_id, f.i, {gone('s0')} AS n0,
        least({gone('s1')}, {keep('s0', 's')}) AS n1,
        least({gone('s2')}, {', '.join(keep(s, 'u') + ', ' + name(s) for s in ('s0', 's1', 's3'))}) AS n2,
        least({gone('s3')}, {keep('s2', 'a')}, {name('s2')}) AS n3
      FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))),
ended AS (
  SELECT s.conv_id, least(s0, s3) AS best FROM steps s
  JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.i),
letters AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS letter, unnest(range(1, length(best) - 8)) AS pos FROM ended WHERE length(best) > 9),
edits AS (
  SELECT conv_id, letter, pos, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place,
    sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id) AS n
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
repaired AS (
  SELECT e.conv_id, string_agg(
    CASE WHEN letter = 'K' THEN f.role WHEN (place - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY place) AS lines
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i
  WHERE letter <> 'D' GROUP BY e.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
  coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(left(e.best, 9)::BIGINT, 0) AS cost,
  coalesce(substr(e.best, 10), '') AS audit, sha256(coalesce(r.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op13_conversation_repair", _sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(rows))
    return with_digests(rows, report, repaired)


def with_digests(rows: DataFrame, report: DataFrame, repaired: DataFrame) -> DataFrame:
    """Every conversation of the original rows, with its report and the digest of its repaired rows."""
    every = rows.select("conv_id").distinct()
    hashed = digests(repaired).select(F.col("conv").alias("of"), "digest")
    found = report.join(hashed, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    full = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
