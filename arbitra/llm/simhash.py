"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link if they differ in two bits at most; then one of their halves differs
in one bit at most.  The anchors of a half are the words of the Hamming code over 31 of its bits,
a perfect code: every half is within covering radius 1 of one anchor, its home.  A fingerprint is
replicated to all anchors within radius 1 plus threshold 1 of each half (16 or, for an anchor
itself, 1).  If two halves differ in one bit at most, either lies within 2 of the other's home, so
all links are found by comparing per anchor.  Only different fingerprints are compared, and an
anchor's links leave the task as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.components import components
from arbitra.llm.tables import written

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: An anchor's group above this size is divided by parts of the other half before comparing.
DIVIDE = 256
#: The columns of the code's parity check are the numbers 1 to 31.
POSITIONS = 31
PAIRS = {s: [(a, a ^ s) for a in range(1, POSITIONS + 1) if 0 < a ^ s and a < a ^ s] for s in range(1, POSITIONS + 1)}


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words; of all words if they are too few."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(ws[k:] for k in range(size))) if len(ws) >= size else [ws]
    return np.array([digest(b" ".join(run), SEED) for run in runs], dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without words.  As a signed long."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """id and fp of every row."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(fps, pa.int64())})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(mapped, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def syndromes(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(len(halves), dtype=np.int64)
    for j in range(POSITIONS):
        out ^= np.where((halves >> j) & 1, j + 1, 0)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint all its anchors: index of the fingerprint, anchor, and if it is its home.

    An anchor is the code word with the half's number above it.
    """
    index, anchor, home = [], [], []
    raw = fps.view(np.uint64)
    for half in range(2):
        bits = ((raw >> np.uint64(32 * half)) & np.uint64((1 << POSITIONS) - 1)).astype(np.int64)
        found = syndromes(bits)
        tag = half << POSITIONS
        for s in range(POSITIONS + 1):
            at = np.flatnonzero(found == s)
            flips = [0] if s == 0 else [1 << (s - 1), *((1 << (a - 1)) | (1 << (b - 1)) for a, b in PAIRS[s])]
            for k, flip in enumerate(flips):
                index.append(at)
                anchor.append((bits[at] ^ flip) | tag)
                home.append(np.full(len(at), k == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def near_pairs(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal key (sorted), one of them at home, that differ in few bits."""
    none = np.zeros(0, dtype=np.int64)
    left, right = [none], [none]
    at, d = np.arange(len(key)), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        near = at[(home[at] | home[at + d]) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= most)]
        left.append(near)
        right.append(near + d)
        d += 1
    return np.concatenate(left), np.concatenate(right)


def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints among the members of each anchor (keys sorted).

    Members of large groups are compared only where one third of the other half agrees, as it must
    for some third if two bits differ at most.
    """
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    sizes = np.diff(first, append=len(key))
    large = np.repeat(sizes, sizes) > DIVIDE
    a, b = near_pairs(key[~large], fp[~large], home[~large], most)
    out = [(fp[~large][a], fp[~large][b])]
    if large.any():
        key, fp, home = key[large], fp[large], home[large]
        other = np.where(key >> POSITIONS == 0, fp.view(np.uint64) >> np.uint64(32), fp.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        for shift, bits in ((0, 11), (11, 11), (22, 10)):
            part = (group << 11) | ((other >> shift) & ((1 << bits) - 1))
            by = np.argsort(part, kind="stable")
            a, b = near_pairs(part[by], fp[by], home[by], most)
            out.append((fp[by][a], fp[by][b]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components: each member but the least, and the least."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    hung = np.flatnonzero(root != np.arange(len(names)))
    return names[hung], names[root[hung]]


def linked(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges a, b between different fingerprints (column fp, distinct) that connect what links."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for begin in range(0, len(fp), 20_000):
                part = fp[begin : begin + 20_000]
                index, anchor, home = anchors(part)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "fp": pa.array(part[index]), "home": pa.array(home)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []

        def found(done: list[np.ndarray]) -> pa.RecordBatch:
            a, b = forest(*links(*done, most))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home"))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last anchor may go on in the next batch
            if cut == 0 and rest and rest[-1][0][-1] == now[0][-1]:
                rest.append(now)
                continue
            done = [np.concatenate([*(r[k] for r in rest), now[k][:cut]]) for k in range(3)]
            rest = [tuple(x[cut:] for x in now)]
            if len(done[0]):
                yield found(done)
        if rest:
            yield found([np.concatenate([r[k] for r in rest]) for k in range(3)])

    replicas = fps.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    return replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, most: int = MAX_BITS,
) -> DataFrame:
    """One row per document row: id, fp (long), component_id (least id reachable over links).

    Links join fingerprints that differ in at most ``most`` (2) bits.  A null, empty or wordless
    text has fingerprint 0 and links like any other.  Repeated rows and ids are rows of their own;
    a null id is never a component's name unless it has no other.  Other columns are ignored; an
    empty table gives no rows.
    """
    if most > 2:
        raise ValueError("the anchors cover links of at most two bits")
    prints = written(fingerprints(docs, id_col, text_col, size))
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(linked(classes, most), "a", "b")
    named = written(
        classes.join(roots, classes["fp"] == roots["node"], "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = written(named.join(least, "root").select(F.col("fp").alias("of"), "component_id"))
    return prints.join(of_print, F.col("fp") == F.col("of")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document per component, the one with the least id; all columns kept.

    Of rows that share this id one stays.  Rows without an id stay: they can't be told apart.
    """
    found = written(near_duplicates(docs, id_col, text_col))
    stay = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("llm_id")).agg(F.count("*").alias("n"))
    stay = written(stay)
    single, several = stay.where("n = 1"), stay.where("n > 1")
    one = docs.join(single, docs[id_col] == single["llm_id"], "left_semi")
    first = docs.join(several, docs[id_col] == several["llm_id"], "left_semi").dropDuplicates([id_col])
    return one.unionByName(first).unionByName(docs.where(F.col(id_col).isNull()))
