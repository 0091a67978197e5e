"""op2: base counts and language divergence of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm import quality as q
from arbitra.llm.registry import query
from arbitra.llm.tables import read

_WS = "[\\x20\\x09-\\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _class(pattern: str) -> str:
    body = pattern if pattern[0] == "[" else f"[{pattern}]"
    return f"length(text) - length(regexp_replace(text, '{body.replace(chr(39), chr(39) * 2)}+', '', 'g'))"


_CHARS = "[" + ", ".join(map(_class, q.CLASSES)) + "]"
_WORDS = "[" + ", ".join(f"len(list_filter(runs, lambda w: w = '{w}'))" for w in q.VOCABULARY) + "]"
_OWN = " UNION ALL ".join(
    f"SELECT '{lang}' AS ref, [{', '.join(str(q.VOCABULARY.index(w) + 1) for w in ws)}] AS own"
    for lang, ws in q.COMMON_WORDS.items()
)


def _distance(counts: str, total: str, reference: str) -> str:
    def half(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"

    p, r = f"({counts}[i] / {total})", f"{reference}[i]"
    return (
        f"CASE WHEN {total} = 0 THEN 0.0 ELSE sqrt(greatest(0.0, list_sum(list_transform(range(1, len({counts}) + 1), "
        f"lambda i: ({half(p, r)} + {half(r, p)}) / 2)))) END"
    )


SQL = f"""
WITH a AS (
    SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), b AS (
    SELECT *, list_filter(string_split_regex(text, '{_WS}'), lambda w: w <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        list_filter(string_split_regex({_LOWER}, '[^\\p{{L}}]+'), lambda w: w <> '') AS runs,
        length(text) AS n_chars
    FROM a
), c AS (
    SELECT *, len(ws) AS n_words,
        list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS wins,
        {_CHARS} AS five, {_WORDS} AS counts
    FROM b
), w AS (
    SELECT doc_id, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM c
), r AS (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1
), rep AS (
    SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM r GROUP BY doc_id
), d AS (
    SELECT c.doc_id, lang, n_chars, n_words::BIGINT AS n_words,
        list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
        (length(text) - length(translate(text, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        list_append(five, n_chars - list_sum(five)) AS chars,
        list_append(counts, len(runs) - list_sum(counts)) AS common, len(runs) AS n_runs
    FROM c LEFT JOIN rep USING (doc_id)
), e AS (
    SELECT *, coalesce(wc, 0) AS word_chars,
        n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed
    FROM d
), own AS ({_OWN}), pooled AS (
    SELECT lang AS ref, [{", ".join(f"sum(chars[{i + 1}])" for i in range(len(q.CLASSES) + 1))}] AS cs,
        [{", ".join(f"sum(common[{i + 1}])" for i in range(len(q.VOCABULARY) + 1))}] AS cw
    FROM e WHERE NOT base_failed AND lang IN (SELECT ref FROM own) GROUP BY lang
), refs AS (
    SELECT ref, own, list_transform(cs, lambda x: x / list_sum(cs)) AS rc,
        list_transform(list_append(list_transform(own, lambda k: cw[k]),
            list_sum(cw) - list_sum(list_transform(own, lambda k: cw[k]))), lambda x: x / list_sum(cw)) AS rw
    FROM pooled JOIN own USING (ref)
), x AS (
    SELECT e.*, rc, rw, ref, list_sum(chars) AS tc, list_sum(common) AS tw,
        list_append(list_transform(own, lambda k: common[k]),
            list_sum(common) - list_sum(list_transform(own, lambda k: common[k]))) AS mine
    FROM e, refs WHERE n_chars >= {q.MIN_CHARS}
), y AS (
    SELECT doc_id, ref, tw, {_distance("chars", "tc", "rc")} AS dc, {_distance("mine", "tw", "rw")} AS dw FROM x
), z AS (
    SELECT doc_id, arg_min(dc <= {q.MAX_CHAR_DISTANCE} AND (tw < {q.MIN_COUNTED_WORDS} OR dw <= {q.MAX_WORD_DISTANCE}), dc + dw) AS near
    FROM y GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, NOT base_failed AND coalesce(near, true) AS kept
FROM e LEFT JOIN z USING (doc_id)
"""


@query("op2_language_divergence", SQL)
def op2_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quality_rules(read(spark, sf_dir, "documents")).drop("language", "char_distance", "word_distance")
