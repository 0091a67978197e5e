"""Quality rules: base counts of a text, and its divergence from language references.

Everything is a column expression, so a document is judged in its own row.  The references are
pooled histograms over all documents that pass the base rules, one row per configured language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.chat import let
from arbitra.llm.tables import ascii_lower, words, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Frequent words by language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "on", "as", "by", "this", "are"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con"),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Character classes (patterns both SQL dialects know); what is in none of them is the last bin.
CLASSES = ("\\p{Ll}", "\\p{Lu}", "\\p{Nd}", "[\\s]", "[.,;:!?'\"()-]")
#: Documents shorter than these have too few characters or words for a histogram.
MIN_CHARS, MIN_COUNTED_WORDS = 200, 40
#: Jensen-Shannon distance (0 to 1) above which a histogram is not that of the language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.6


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Number of words covered by windows of ``size`` words that the array holds twice or more."""

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        exact = let(
            F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, size)).alias("w"), i.alias("i")))),
            lambda s: let(
                F.array_sort(F.transform(
                    F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])),
                    lambda x: x["i"],
                )),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size)))),
                    F.lit(0), lambda a, b: a + b,
                ),
            ),
        )
        # Windows with different hashes are different; texts are compared only where hashes agree.
        alike = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) <= size, 0).when(alike, exact).otherwise(0)

    return let(ws, count).cast("long")


def base_counts(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[Column] = ()) -> DataFrame:
    """id, the five base counts, base_failed, and the lower-cased text for the histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text"), *keep).select(
        "*", words(F.col("text")).alias("words"), lines.alias("lines")
    )
    counted = rows.select(
        id_col, "text", *[c for c in rows.columns if c not in (id_col, "text", "words", "lines")],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def char_histogram(text: Column) -> Column:
    """Counts of the character classes, the rest last."""
    counts = [F.length(text) - F.length(F.regexp_replace(text, f"{c}+" if c[0] == "[" else f"[{c}]+", "")) for c in CLASSES]
    return let(F.array(*counts), lambda c: F.array_append(c, F.length(text) - F.aggregate(c, F.lit(0), lambda a, b: a + b))).cast("array<long>")


def word_histogram(text: Column, vocabulary: Sequence[str] = VOCABULARY) -> Column:
    """Counts of the vocabulary's words among the runs of letters, the rest last."""
    runs = F.array_remove(F.split(ascii_lower(text), "[^\\p{L}]+"), "")

    def count(ws: Column) -> Column:
        common = F.concat(F.lit(" "), F.array_join(F.filter(ws, lambda w: w.isin(*vocabulary)), "  "), F.lit(" "))

        def each(joined: Column) -> Column:
            counts = [
                ((F.length(joined) - F.length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
                for w in vocabulary
            ]
            return let(F.array(*counts), lambda c: F.array_append(c, F.size(ws) - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)))

        return let(common, each)

    return let(runs, count)


def distance(counts: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram from a reference distribution; 0 if it is empty."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def terms(n: Column) -> Column:
        return F.zip_with(counts, F.lit(list(reference)), lambda c, q: let(c / n, lambda p: (half(p, q) + half(q, p)) / 2))

    sums = let(total, lambda n: F.when(n > 0, F.aggregate(terms(n), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), sums))


def narrowed(word_counts: Column, language: str, vocabulary: Sequence[str] = VOCABULARY) -> Column:
    """A language's own common words of a word histogram, all other words in one bin."""
    own = F.array(*[F.get(word_counts, F.lit(vocabulary.index(w))) for w in COMMON_WORDS[language]])
    total = F.aggregate(word_counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(own, lambda o: F.array_append(o, total - F.aggregate(o, F.lit(0).cast("long"), lambda a, b: a + b)))


def language_references(features: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Pooled distributions of characters and words per configured language.

    ``features`` has ``chars`` and ``common`` histograms and ``base_failed``; failed documents are
    left out.  The answer has one row per configured language at most, whatever the input.
    """
    n_chars, n_words = len(CLASSES) + 1, len(VOCABULARY) + 1
    sums = (
        features.where(~F.col("base_failed") & F.col(lang_col).isin(*COMMON_WORDS))
        .groupBy(lang_col)
        .agg(
            *[F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)],
            *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_words)],
        )
    )
    out = {}
    for row in sums.collect():
        chars, counts = [row[f"c{i}"] for i in range(n_chars)], [row[f"w{i}"] for i in range(n_words)]
        own = [counts[VOCABULARY.index(w)] for w in COMMON_WORDS[row[0]]]
        own.append(sum(counts) - sum(own))
        if sum(chars) and sum(own):
            out[row[0]] = [c / sum(chars) for c in chars], [w / sum(own) for w in own]
    return out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per input row: id, base counts, base_failed, language, distances, kept.

    The references come from the rows with a configured ``lang``; a document is compared to all of
    them, and ``language`` is the nearest by the sum of both distances, so a wrong or null ``lang``
    does not matter.  A document that passes the base rules is kept if both distances from its
    language are small; a text with too few characters or words for one of the histograms passes
    that part, and without any reference all do.  A null text is empty, with counts 0, and fails.  Repeated rows are judged one by one;
    other columns are ignored; an empty table gives no rows.
    """
    base = base_counts(docs, id_col, text_col, keep=[F.col(lang_col).alias("llm_lang")])
    features = written(
        base.select(
            "*", F.length("text").alias("n_chars"), char_histogram(F.col("text")).alias("chars"),
            word_histogram(F.col("text")).alias("common"),
        ).drop("text")
    )
    references = language_references(features, "llm_lang")
    counted_words = F.aggregate("common", F.lit(0).cast("long"), lambda a, b: a + b)
    each = [
        F.struct((c + w).alias("sum"), F.lit(lang).alias("language"), c.alias("chars"), w.alias("words"))
        for lang, (chars, own) in sorted(references.items())
        for c, w in [(distance(F.col("chars"), chars), distance(narrowed(F.col("common"), lang), own))]
    ]
    nearest = F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<sum:double,language:string,chars:double,words:double>")
    judged = features.withColumn("nearest", F.when(F.col("n_chars") >= MIN_CHARS, nearest))
    few = counted_words < MIN_COUNTED_WORDS
    near = (F.col("nearest.chars") <= max_char_distance) & (few | (F.col("nearest.words") <= max_word_distance))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("nearest.language").alias("language"), F.col("nearest.chars").alias("char_distance"),
        F.col("nearest.words").alias("word_distance"),
        (~F.col("base_failed") & F.coalesce(near, F.lit(True))).alias("kept"),
    )
