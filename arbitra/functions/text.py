"""String expressions: normalising, tokenising, quoting, phrase mining, text blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters treated as white space (ASCII, Unicode separators, NEL, FS..US).
WHITESPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
TOKEN = "[A-Za-z0-9]+"

# Stop words ignored by phrase mining and by the topic mask.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have",
    "i", "if", "in", "is", "it", "my", "of", "on", "or", "our", "the", "their", "they", "to",
    "was", "we", "were", "with", "you", "your",
]

# Quantifier openings and what replaces them ({n} is the minimum count).
QUANTIFIERS = [
    (r"^Multiple\s+reviews?\s+", "{n} or more reviews "),
    (r"^Several\s+reviews?\s+", "{n} or more reviews "),
    (r"^Many\s+reviews?\s+", "{n} or more reviews "),
    (r"^Consistent\s+(\w+)\s+", "{n} or more $1 "),
    (r"^Consistently\s+", "{n} or more reviews "),
    (r"^Frequent\s+(\w+)\s+", "{n} or more $1 "),
    (r"^Frequently\s+", "{n} or more reviews "),
    (r"^Multiple\s+", "{n} or more "),
    (r"^Several\s+", "{n} or more "),
    (r"^\d+\s+(?:or\s+more\s+)?", "{n} or more "),
]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case, white space runs collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WHITESPACE, " "))


def tokens(text: Column) -> Column:
    """ASCII letter/digit runs in order, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """does the text contain at least one literal?  Lower-case text is the caller's job."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Text of the leftmost match of a case-insensitive alternation, null without one."""
    joined = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.when(text.rlike(joined), F.regexp_extract(text, joined, 0))


def contains_anchor(text: Column, anchors: Column) -> Column:
    """does the normalised text contain a normalised anchor?  No anchors means yes."""
    hay = normalize(text)
    clean = F.filter(F.transform(anchors, normalize), lambda a: a != "")
    hit = F.exists(clean, lambda a: F.contains(hay, a))
    return F.when(F.size(F.coalesce(anchors, F.array())) == 0, True).otherwise(
        F.coalesce((hay != "") & hit, F.lit(False))
    )


def topic_mask(text: Column, anchors: Sequence[str]) -> Column:
    """0 without an anchor token, 0.5 with one, 1 with two or more distinct ones."""
    wanted = sorted({a.lower() for a in anchors} - set(STOPWORDS))
    if not wanted:
        return F.lit(1.0)
    shared = F.array_intersect(tokens(text), F.array(*[F.lit(a) for a in wanted]))
    return F.least(F.lit(1.0), F.size(shared) / F.lit(2.0))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` that is followed by white space."""
    marked = F.regexp_replace(text, r"([.!?])[\s\p{Z}]+", "$1\u0001")
    return F.split(marked, "\u0001")


def segments(quote: Column, min_length: int = 10) -> Column:
    """Normalised sentence pieces; ellipsis pieces, then the whole quote, as fallbacks."""
    def long_enough(parts: Column) -> Column:
        return F.filter(F.transform(parts, normalize), lambda s: F.length(s) >= min_length)

    def or_else(parts: Column, allowed: Column, other: Column) -> Column:
        return bind(parts, lambda p: F.when(allowed & (F.size(p) > 0), p).otherwise(other))

    pieces = F.contains(quote, F.lit("..."))
    by_ellipsis = or_else(long_enough(F.split(quote, r"\.\.\.")), pieces, long_enough(F.array(quote)))
    return or_else(long_enough(sentences(quote)), F.lit(True), by_ellipsis)


def quote_check(
    quote: Column, source: Column, min_length: int = 10, threshold: float = 0.8
) -> Column:
    """Is the quote found in the source, and how?

    Both texts are normalised once and the segments walked once, from left to right.
    Tiers: the whole normalised quote; enough segments in reading order; enough shared words
    (quotes of three distinct words or more).  Returns struct(valid, match_type,
    segments_found, segments_total, match_ratio, positions), positions 0-based, -1 if absent.
    """
    def answer(valid: bool, kind: str, found: Column, total: Column, ratio: Column, positions: Column):
        return F.struct(
            F.lit(valid).alias("valid"),
            F.lit(kind).alias("match_type"),
            found.cast("int").alias("segments_found"),
            total.cast("int").alias("segments_total"),
            ratio.cast("double").alias("match_ratio"),
            positions.cast("array<int>").alias("positions"),
        )

    def walk(parts: Column, s: Column) -> Column:
        """Places of the segments, how many there are, and whether they stand in reading order:
        each after the largest place before it."""
        start = F.struct(
            F.array().cast("array<int>").alias("at"), F.lit(0).alias("found"),
            F.lit(-1).alias("last"), F.lit(True).alias("ordered"),
        )

        def place(piece: Column) -> Column:
            bare = F.regexp_replace(piece, r"[.,!?;:]+$", "")
            return bind(F.instr(s, piece), lambda d: F.when(d > 0, d).otherwise(F.instr(s, bare)) - 1)

        def add(acc: Column, piece: Column) -> Column:
            return bind(place(piece), lambda p: F.struct(
                F.concat(acc["at"], F.array(p)).alias("at"),
                (acc["found"] + (p >= 0).cast("int")).alias("found"),
                F.greatest(acc["last"], p).alias("last"),
                (acc["ordered"] & ((p < 0) | (p > acc["last"]))).alias("ordered"),
            ))

        return F.aggregate(parts, start, add)

    def by_words(v: Column, w: Column, ratio: Column) -> Column:
        words = F.array_distinct(F.split(v["q"], " "))
        overlap = bind(words, lambda x: F.when(
            F.size(x) >= 3, F.size(F.array_intersect(x, F.split(v["s"], " "))) / F.size(x)
        ))
        total = F.size(v["parts"])
        return bind(overlap, lambda o: F.when(
            o >= 0.8, answer(True, "word_overlap", w["found"], total, o, w["at"])
        ).otherwise(answer(False, "no_match", w["found"], total, ratio, w["at"])))

    def by_segments(v: Column) -> Column:
        total = F.size(v["parts"])

        def judge(w: Column) -> Column:
            ratio = F.when(total > 0, w["found"] / total).otherwise(F.lit(0.0))
            return F.when(
                (total > 0) & (ratio >= threshold) & w["ordered"],
                answer(True, "multi_span", w["found"], total, ratio, w["at"]),
            ).otherwise(by_words(v, w, ratio))

        return bind(walk(v["parts"], v["s"]), judge)

    nothing, one = F.array().cast("array<int>"), F.lit(1)

    def judge_texts(v: Column) -> Column:
        whole = answer(True, "exact", one, one, F.lit(1.0), F.array(F.instr(v["s"], v["q"]) - 1))
        with_parts = F.struct(v["q"].alias("q"), v["s"].alias("s"), segments(quote, min_length).alias("parts"))
        return (
            F.when(
                ~F.coalesce((v["q"] != "") & (v["s"] != ""), F.lit(False)),
                answer(False, "no_match", F.lit(0), F.lit(0), F.lit(0.0), nothing),
            )
            .when(F.contains(v["s"], v["q"]), whole)
            .otherwise(bind(with_parts, by_segments))
        )

    return bind(F.struct(normalize(quote).alias("q"), normalize(source).alias("s")), judge_texts)


def quote_in_markup(quote: Column, source: Column) -> Column:
    """X17, strict form: markup removed first, and word overlap alone does not count."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9\s.!?]+", " ")
    checked = quote_check(clean(quote), clean(source))
    return checked["valid"] & checked["match_type"].isin("exact", "multi_span")


def distinct_phrases(phrases: Column) -> Column:
    """Drop blanks and later case-insensitive repeats, keeping order."""
    trimmed = F.filter(F.transform(phrases, lambda x: F.trim(x)), lambda p: p != "")
    keys = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1)


def phrases(definition: Column, max_tokens: int = 6) -> Column:
    """Quoted, parenthesised and "e.g./including" examples, then leading content words."""
    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(definition, F.lit(pattern), F.lit(1))

    def pieces(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda m: F.split(m, r"(?i),|;|/|\bor\b|\band\b")))

    words = F.filter(
        tokens(definition), lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 2)
    )
    return distinct_phrases(
        F.concat(
            all_of('"([^"]+)"'),
            all_of("'([^']+)'"),
            pieces(all_of(r"\(([^)]+)\)")),
            pieces(all_of(r"(?i)(?:e\.g\.|including)\s+([^.;]+)")),
            F.slice(words, 1, max_tokens),
        )
    )


def value_phrases(value_id: Column, definition: Column) -> Column:
    """The value name in words, followed by the phrases of its definition."""
    return distinct_phrases(
        F.concat(F.array(F.replace(value_id, F.lit("_"), F.lit(" "))), phrases(definition))
    )


def identifier(name: Column, upper: bool) -> Column:
    """Runs of other characters become one underscore; ends trimmed; one case."""
    cleaned = F.regexp_replace(F.trim(name), "[^A-Za-z0-9]+", "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    cleaned = F.coalesce(cleaned, F.lit(""))
    return F.upper(cleaned) if upper else F.lower(cleaned)


def between_anchors(text: Column, start: Column, end: Column) -> Column:
    """From the first start anchor to the end of the next end anchor, else null."""
    begin = F.instr(text, start)
    tail = F.substring(text, begin, F.length(text))
    stop = F.instr(tail, end)
    return F.when((begin > 0) & (stop > 0), F.substring(tail, F.lit(1), stop + F.length(end) - 1))


def prompt_section(text: Column, header_pattern: str) -> Column:
    """The block after the first ``====``-fenced header that matches the pattern."""
    blocks = F.transform(F.split(text, r"\n={10,}\n"), lambda x: F.trim(x))
    at = F.filter(
        F.transform(blocks, lambda b, i: F.when(b.rlike("(?i)" + header_pattern), i)),
        lambda i: i.isNotNull(),
    )
    return F.when(F.size(at) > 0, F.get(blocks, F.get(at, F.lit(0)) + 1))


def field_definitions(text: Column) -> Column:
    """``FIELD`` lines followed by ``- value: description`` lines, as array<struct>."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    # Start a new chunk at each upper-case line, then read the value lines of each chunk.
    marked = F.array_join(
        F.transform(
            lines, lambda s: F.when(s.rlike("^[A-Z][A-Z_]+$"), F.concat(F.lit("\u0001"), s)).otherwise(s)
        ),
        "\n",
    )
    chunks = F.slice(F.split(marked, "\u0001"), 2, 100_000)
    return F.transform(
        chunks,
        lambda c: F.struct(
            F.lower(F.element_at(F.split(c, "\n"), 1)).alias("field"),
            F.transform(
                F.regexp_extract_all(c, F.lit(r"(?m)^- ([^:\n]+):"), F.lit(1)), F.trim
            ).alias("values"),
        ),
    )


def explicit_threshold(text: Column, min_count: Column) -> Column:
    """Fill ``{min_count}`` and turn a vague opening quantifier into a number."""
    n = min_count.cast("string")
    filled = F.replace(text, F.lit("{min_count}"), n)
    out = None
    for pattern, replacement in QUANTIFIERS:
        rewritten = F.regexp_replace(
            filled, F.lit("(?i)" + pattern), F.replace(F.lit(replacement), F.lit("{n}"), n)
        )
        hit = filled.rlike("(?i)" + pattern)
        out = F.when(hit, rewritten) if out is None else out.when(hit, rewritten)
    return out.otherwise(filled)


def score_threshold_text(text: Column, threshold: Column) -> Column:
    """Put a threshold into the first "score is N ..." of a rule text."""
    pattern = r"(?i)(score\s+(?:is|=|>=|<=|>|<)\s*)-?\d+"
    head = F.regexp_extract(text, pattern, 0)
    new = F.concat(F.regexp_extract(text, pattern, 1), threshold.cast("string"))
    at = F.instr(text, head)
    replaced = F.concat(
        F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(head), F.length(text))
    )
    return F.when(threshold.isNotNull() & (head != ""), replaced).otherwise(text)
