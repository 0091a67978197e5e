"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the terms (words and beginnings of words) that mark the toxic class
among all labelled rows.  The
examples are a bounded sample of labelled rows in a block-max inverted index: postings by term, cut
into blocks of examples, with the largest weight of each term in each block.  A text's nearest
examples by cosine are found exactly: blocks are visited by their upper bound until no other block
can reach the k-th best.  Votes weighted by similarity and by how many labelled rows an example
stands for, with the share of toxic rows as prior, give the score; the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.tables import written

#: Bounds of the model: examples per class and terms.
MAX_EXAMPLES, MAX_TERMS = 4000, 4096
#: A term marks a class if it occurs in this many rows, its odds are this many times as high there
#: as elsewhere, and the likelihood ratio is above the value of one chance in a thousand, raised by
#: twice the logarithm of how many fifties of toxic rows there are, as so many more terms get the chance.
MIN_ROWS, MIN_ODDS, MIN_EVIDENCE = 2, 8.0, 10.83
NEIGHBOURS, BLOCK = 15, 512
PRIOR_WEIGHT = 0.5
#: A vote weighs similarity over distance (1 - similarity), the latter softened by this much.
SOFTEN = 0.05
THRESHOLD = 0.7
MEMORY = 50_000

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that count as terms, for words that form their family that way.
STEMS = (4, 5, 6, 7)
#: All words that are no term count as this one, so a vector shows how much of a text the terms are.
BACKGROUND = ""


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(words: dict[str, int], known: Collection[str], starts: Collection[str]) -> dict[str, int]:
    """Counts of the known terms; ``starts`` holds the first letters of all of them."""
    found: Counter = Counter()
    others = 0
    for word, n in words.items():
        if word[: STEMS[0]] in starts:
            own = [t for t in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if t in known]
            for term in own:
                found[term] += n
            if own:
                continue
        others += n
    if others:
        found[BACKGROUND] = others
    return found


@dataclass
class Model:
    """The index: everything a task needs to score texts, of bounded size."""

    idf: dict[str, float]
    ids: list
    toxic: np.ndarray  # label of each example
    stands_for: np.ndarray  # labelled rows of its class per example of its class
    prior: float
    blank: float  # score of a text without any of the terms
    postings: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    tops: dict[str, np.ndarray] = field(default_factory=dict)  # largest weight per block
    _starts: set[str] = field(default_factory=set)

    def terms(self, text: str | None) -> dict[str, int]:
        return terms_of(Counter(words_of(text)), self.idf, self.starts)

    @property
    def starts(self) -> set[str]:
        if not self._starts:
            self._starts = {t.rstrip("*")[: STEMS[0]] for t in self.idf}
        return self._starts

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        """TF-IDF weights of length 1 over the model's terms."""
        raw = {t: (1 + np.log(n)) * self.idf[t] for t, n in sorted(counts.items()) if t in self.idf}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    def index(self, examples: list[dict[str, int]]) -> None:
        blocks = -(-len(examples) // BLOCK)
        entries: dict[str, list[tuple[int, float]]] = {}
        for i, counts in enumerate(examples):
            for t, w in self.vector(counts).items():
                entries.setdefault(t, []).append((i, w))
        for t, pairs in entries.items():
            at, weight = np.array([i for i, _ in pairs]), np.array([w for _, w in pairs])
            cuts = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
            top = np.zeros(blocks)
            np.maximum.at(top, at // BLOCK, weight)
            self.postings[t], self.tops[t] = (at, weight, cuts), top

    def nearest(self, counts: dict[str, int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, exact; of equal ones the first."""
        query = [(t, w) for t, w in self.vector(counts).items() if t in self.postings]
        if not query:
            return []
        bound = sum(w * self.tops[t] for t, w in query)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-9:
                break
            sums = np.zeros(BLOCK)
            for t, w in query:
                at, weight, cuts = self.postings[t]
                s, e = cuts[b], cuts[b + 1]
                sums[at[s:e] - b * BLOCK] += w * weight[s:e]
            sums = np.round(sums, 9)  # equal vectors are equally near, in whatever order they add up
            least = best[-1][0] if len(best) == k else 0.0
            able = np.flatnonzero((sums >= least) & (sums > 0))
            able = able[np.argsort(-sums[able], kind="stable")[:k]]
            best += [(float(sums[i]), int(b) * BLOCK + int(i)) for i in able]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best

    def score(self, counts: dict[str, int]) -> tuple[float, list[tuple[float, int]]]:
        found = self.nearest(counts) if counts.keys() - {BACKGROUND} else []
        if not found:
            return self.blank, []
        near = np.array([c / (1 + SOFTEN - c) for c, _ in found]) * self.stands_for[[i for _, i in found]]
        votes = float(near @ self.toxic[[i for _, i in found]])
        return (votes + PRIOR_WEIGHT * self.prior) / (float(near.sum()) + PRIOR_WEIGHT), found


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``words`` and ``counts`` for the text column, which goes."""
    others = [c for c in docs.columns if c != text_col]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(words_of(t)) for t in batch.column(text_col).to_pylist()]
            columns = {c: batch.column(c) for c in others}
            columns["words"] = pa.array([list(c) for c in counted], pa.list_(pa.string()))
            columns["counts"] = pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(mapped, f"{kept}, words array<string>, counts array<bigint>")


def _stems(k: int) -> Column:
    """The beginnings of k letters of the longer ones among ``words``."""
    return F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS,
) -> Model:
    """The model of all labelled rows that are not held out.

    Term statistics cover all of them.  Examples are ``max_examples`` per class at most, in the order of a
    hash of the id, and terms ``max_terms`` at most, the strongest first.  A label given several
    times counts once, as the largest; null labels and ids are left out.  Without any labelled row
    every text scores 0.
    """
    marks = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("key")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic")
    )
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The same join at every size: the labels are not known to be few.
    labelled = texts.join(marks.hint("merge"), F.col("id") == F.col("key")).select("id", "toxic", "text")
    counted = written(_word_counts(labelled, "text").withColumn("order", F.md5(F.col("id").cast("string"))))
    sizes = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    total = max(1, bad + good)

    every = F.array_distinct(F.concat("words", *map(_stems, STEMS)))
    rows = counted.select("toxic", F.explode(every).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("a")
    ).where(F.col("n") >= MIN_ROWS)
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    odds = ((a + 0.5) / (bad - a + 0.5)) / ((n - a + 0.5) / (good - (n - a) + 0.5))

    def part(seen: Column, of: Column, share: float) -> Column:
        expected = of * share
        return F.when((seen > 0) & (expected > 0), 2 * seen * F.log(seen / expected)).otherwise(0.0)

    evidence = part(a, n, bad / total) + part(n - a, n, good / total)
    chosen = (
        rows.withColumn("g", evidence).where((odds >= MIN_ODDS) & (F.col("g") >= MIN_EVIDENCE + 2 * float(np.log1p(bad / 50))))
        .orderBy(F.col("g").desc(), "term").limit(max_terms).collect()
    )
    idf = {r["term"]: float(np.log((1 + total) / (1 + r["n"])) + 1) for r in chosen} | {BACKGROUND: 1.0}

    picked = []
    for label in (0, 1):
        own = counted.where(F.col("toxic") == label)
        last = own.select("order", "id").orderBy("order", "id").limit(max_examples).agg(F.max(F.struct("order", "id"))).first()[0]
        if last is not None:
            upto = (F.col("order") < last["order"]) | ((F.col("order") == last["order"]) & (F.col("id") <= last["id"]))
            picked += own.where(upto).select("order", "id", "toxic", F.map_from_arrays("words", "counts").alias("own")).toLocalIterator()
    starts = {t.rstrip("*")[: STEMS[0]] for t in idf}
    picked = [(r["order"], r["id"], r["toxic"], terms_of(r["own"], idf, starts)) for r in picked]
    picked.sort(key=lambda r: (r[0], str(r[1])))
    taken = Counter(label for _, _, label, _ in picked)
    stands_for = np.array([sizes[label] / taken[label] for _, _, label, _ in picked])
    toxic = np.array([float(label) for _, _, label, _ in picked])
    blank_rows = np.array([not terms.keys() - {BACKGROUND} for _, _, _, terms in picked], dtype=bool)
    prior = bad / total
    blank = (float(stands_for[blank_rows] @ toxic[blank_rows]) + PRIOR_WEIGHT * prior) / (float(stands_for[blank_rows].sum()) + PRIOR_WEIGHT)
    model = Model(idf, [key for _, key, _, _ in picked], toxic, stands_for, prior, blank)
    model.index([terms for _, _, _, terms in picked])
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score, predicted, evidence (neighbours' id, similarity, toxic).

    A null or empty text, like any without the model's terms, scores as the share of toxic rows
    among such examples.  Repeated rows are scored one by one; other columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                counts = model.terms(text)
                key = tuple(sorted(counts.items()))
                if key not in memory:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[key] = model.score(counts)
                score, found = memory[key]
                scores.append(score)
                evidence.append([{"example": str(model.ids[i]), "similarity": c, "toxic": int(model.toxic[i])} for c, i in found])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, EVIDENCE)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(scored, f"id {id_type}, score double, evidence array<struct<example:string,similarity:double,toxic:int>>")
    return out.select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )


EVIDENCE = pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, all columns kept.

    The verdict is added to each row in one pass; no join, so repeated and null ids are no matter.
    """
    model = learn(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def stays(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield texts.map(lambda t: model.score(model.terms(t))[0] < THRESHOLD)

    return docs.where(stays(F.col(text_col)))
