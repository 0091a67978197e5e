"""Benchmark decontamination by suffix arrays over shards of the training texts.

Every task cuts its documents into shards of bounded size, turns their words into numbers and
sorts all word suffixes (prefix doubling, as deep as the longest benchmark item).  Every suffix of
every item is then searched in the shard's suffix array: a binary search per further word narrows
the interval of equal beginnings, until it is empty.  That gives the longest verbatim match, and the
interval at the window's length holds all places where the window occurs.

A document is in one shard, so nothing but its verdict is shuffled.  The benchmark travels to the
tasks in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.tables import written

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
HIT_SHARE = 20
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20

#: Bytes of words stand for themselves, A-Z for a-z; all other ASCII is a blank.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, letters (A-Z lower-cased) and non-ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class Tests:
    """A block of benchmark items: their words as numbers from 1, one after the other."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    words: np.ndarray  # all items' words
    item: np.ndarray  # item of each word
    left: np.ndarray  # words from here to the item's end
    window: np.ndarray  # length of the window that begins here, 0 if none does

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Tests:
        vocabulary: dict[bytes, int] = {}
        numbers, item, left, windows = [], [], [], []
        for k, (_, ws) in enumerate(items):
            n = len(ws)
            w = min(window, n)
            numbers += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in ws]
            item += [k] * n
            left += range(n, 0, -1)
            windows += [w if i + w <= n else 0 for i in range(n)]
        as_array = lambda xs: np.array(xs, dtype=np.int64)
        return cls([i for i, _ in items], vocabulary, as_array(numbers), as_array(item), as_array(left), as_array(windows))


def suffix_order(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a known word (> 0), sorted by their first ``depth`` words.

    Prefix doubling: a round sorts the members of unresolved groups by the group of the suffix that
    begins ``h`` words later, then ``h`` doubles.  Unknown words (0) sort first and equal.
    """
    starts = np.flatnonzero(words)
    order = starts[np.argsort(words[starts], kind="stable")]
    n = len(order)
    if n == 0:
        return order
    group = np.zeros(len(words) + 1, dtype=np.int64)  # 1 + place of the first member, 0 for unknown words
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    sizes = np.diff(first, append=n)
    group[order] = np.repeat(first + 1, sizes)
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    h = 1
    while h < depth and len(slots):
        members = order[slots]
        key = group[members] * (n + 2) + group[np.minimum(members + h, len(words))]
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(key))
        group[members] = np.repeat(slots[first] + 1, sizes)
        slots = slots[np.repeat(sizes, sizes) > 1]
        h *= 2
    return order


def narrowed(words: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in each interval [lo, hi) of the suffix array for the word at ``depth``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = words[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(words) - 1)]
        below = open_ & ((at <= want) if right else (at < want))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def search_shard(words: np.ndarray, doc: np.ndarray, n_docs: int, tests: Tests) -> tuple[np.ndarray, list[set[int]], np.ndarray]:
    """Hit marks per word, items per document and the longest match per document.

    ``words`` are the shard's words as numbers (0: not in the benchmark, and after each document),
    ``doc`` the document of each.
    """
    items: list[set[int]] = [set() for _ in range(n_docs)]
    longest = np.zeros(n_docs, dtype=np.int64)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    order = suffix_order(words, int(tests.left.max(initial=0)))
    if not len(order) or not len(tests.words):
        return marks[:-1] > 0, items, longest
    test = np.arange(len(tests.words))
    lo, hi = np.zeros(len(test), dtype=np.int64), np.full(len(test), len(order))
    depth, marked = 0, set()
    while len(test):
        want = tests.words[test + depth]
        lo, hi = narrowed(words, order, lo, hi, depth, want, False), narrowed(words, order, lo, hi, depth, want, True)
        depth += 1
        found = lo < hi
        test, lo, hi = test[found], lo[found], hi[found]
        seen: dict[tuple[int, int], np.ndarray] = {}
        window = tests.window[test]
        for k in np.flatnonzero((window > 0) & (window <= depth)):
            span = int(lo[k]), int(hi[k])
            places = order[span[0] : span[1]]
            docs = seen.get(span)
            if docs is None:
                docs = seen[span] = np.unique(doc[places])
                longest[docs] = depth
            if window[k] == depth:
                for d in docs:
                    items[d].add(int(tests.item[test[k]]))
                if (depth, *span) not in marked:
                    marked.add((depth, *span))
                    np.add.at(marks, places, 1)
                    np.add.at(marks, places + depth, -1)
        going = tests.left[test] > depth
        test, lo, hi = test[going], lo[going], hi[going]
    return np.cumsum(marks[:-1]) > 0, items, longest


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def search_texts(texts: list[bytes], tests: Tests) -> dict[str, pa.Array]:
    """Words, hit spans, item ids and longest match of each text of a shard."""
    numbers, docs, ends = [], [], [0]
    lookup = tests.vocabulary.get
    for k, text in enumerate(texts):
        ws = word_list(text)
        numbers.append(np.fromiter((lookup(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
        numbers.append(np.zeros(1, dtype=np.int64))
        ends.append(ends[-1] + len(ws) + 1)
    words = np.concatenate(numbers)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    hit, items, longest = search_shard(words, doc, len(texts), tests)
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    spans: list[list] = [[] for _ in texts]
    for start, end in edges.reshape(-1, 2):  # a document's last word is a blank, so no span crosses
        k = doc[start]
        spans[k].append({"start": int(start - ends[k]), "end": int(end - ends[k])})
    names = [sorted({tests.ids[i] for i in found}) for found in items]
    return {
        "n_words": pa.array(np.diff(ends) - 1), "spans": pa.array(spans, SPANS),
        "items": pa.array(names, pa.list_(pa.string())), "longest": pa.array(longest),
    }


def _search(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """One pass: every document against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(Tests.of(items, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            texts = batch.column("text")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            begin, n = 0, len(texts)
            while begin < n:
                before = int(upto[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + SHARD_BYTES, side="right")))
                found = search_texts(texts.slice(begin, end - begin).to_pylist(), tests)
                keys = {c: batch.column(c).slice(begin, end - begin) for c in ("row", "id")}
                yield pa.RecordBatch.from_pydict(keys | found)
                begin = end

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "text").mapInArrow(
        search,
        f"row long, id {id_type}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long",
    )


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, in blocks of at most ``most`` bytes of text (or one item)."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        ws = word_list((text or "").encode("utf-8"))
        if not ws:
            continue
        n = len(text)
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item_id or "", ws))
        size += n
    if block:
        yield block


def covered(spans: Column) -> Column:
    """Number of places in the union of an array of (start, end)."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items, longest, spans, contaminated.

    ``items`` are the ids (as strings, sorted, distinct; a null id is empty) of the items with a
    window in the document, ``spans`` the hit words of each pass, ``longest`` the length of the
    longest match of at least a window.  A null or wordless text has no words and is not
    contaminated; items without words match nothing.  Repeated rows are searched one by one; other
    columns are ignored; either table may be empty.  If the benchmark takes several passes, the
    numbered rows are written first and every pass reads that table, so rows keep their numbers
    however the passes split it.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    blocks = item_blocks(benchmark, item_id_col, item_text_col, BLOCK_BYTES)
    block, after = next(blocks, []), next(blocks, None)
    if after is not None:
        rows = written(rows)
    passes = [written(_search(rows, block, window))]
    while after is not None:
        passes.append(written(_search(rows, after, window)))
        after = next(blocks, None)
    found = passes[0]
    for other in passes[1:]:
        found = found.unionAll(other)
    per_row = found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    named = per_row.select(
        F.col("id").alias(id_col), "n_words", covered(F.col("spans")).alias("n_hit"), "items", "longest", "spans",
    )
    return named.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that are not contaminated, all columns kept.

    Documents are told apart by id: if rows share an id and one is contaminated, all go.
    """
    found = contamination(docs, benchmark, id_col, text_col).where("contaminated")
    bad = written(found.select(F.col(id_col).alias("llm_bad")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["llm_bad"]), "left_anti")
