"""Removal of byte strings that repeat across documents, by merged Burrows-Wheeler transforms.

1. Candidates.  The seed of a 50-byte window is its least 16-byte hash (minimizer); consecutive
   windows of one seed form a run.  A window also holds the 17 bytes before its seed or the 18 after
   it.  Equal windows agree in seed and side, so a run can repeat only if its seed and one of its
   sides occur in two documents: seeds alone repeat by chance the more, the larger the table is.
   Names (seed and hashes of both sides) travel as packed blocks, at most once per shard of rows.
2. Runs whose name is shared are cut out with their bytes; equal ones in a shard are folded, keeping
   the least document.  Runs of one seed meet in one task.
3. There they are dealt to small shards, each with its suffix array and Burrows-Wheeler transform.
   The transforms are merged by refining their interleave five bytes at a time, up to 50 bytes,
   without sorting suffixes again; where an entry's block splits from the one before is the common
   prefix of the two.  Blocks that are whole after 50 bytes are the repeated intervals.
4. A window goes if its block holds a smaller document.  Spans are gathered per row and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.contamination import suffix_order
from arbitra.llm.tables import written

LENGTH, SEED_BYTES = 50, 16
#: A window has so many bytes before its seed, or more than the rest of them after it.
SIDE = (LENGTH - SEED_BYTES) // 2
HIGH = np.uint64(0xFFFFFFFF00000000)
#: Rows are scanned in shards of this many bytes; runs are merged in chunks of about this many,
#: each of so many transforms.
SHARD_BYTES, CHUNK_BYTES, TRANSFORMS = 4 << 20, 1 << 18, 8
#: Windows are named in pieces of this many bytes, so a shard's arrays are as long as its runs, not its text.
PIECE_BYTES = 1 << 18
KNOWN = np.uint32(0xFFFFFFFF)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = a * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    return a


def window_seeds(data: bytes) -> np.ndarray:
    """For every 50-byte window of the data the least hash of its 16-byte strings (32 bits) and its first place (32 bits)."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.uint64)
    eight = _eight(data)
    least = eight[:-8] * np.uint64(0xE7037ED1A0B428DB)
    least += eight[8:] * np.uint64(0xD6E8FEB86659FD93)
    least = _mixed(least)
    least &= HIGH
    least |= np.arange(len(least), dtype=np.uint64)
    width = LENGTH - SEED_BYTES + 1
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _eight(data: bytes) -> np.ndarray:
    """The eight bytes at each place as a number: a view, without copies."""
    return np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))


def _side(data: bytes, at: np.ndarray, size: int) -> np.ndarray:
    """16 bits of hash, not all zero, of the ``size`` (17 to 24) bytes at each place."""
    h = np.zeros(len(at), dtype=np.uint64)
    for step in (0, 8, size - 8):
        h = _mixed(h ^ (_eight(data)[at + step] * np.uint64(0xD6E8FEB86659FD93)))
    return np.maximum(h >> np.uint64(48), np.uint64(1))


def _names(data: bytes, seeds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names of runs: seed (32 bits), hash of the bytes before it and of those after it (16 bits each).

    A window has 17 bytes before its seed or 18 after it.  A side is zero if no window of the run has it;
    both are if the seed occurs at several places in the run.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    first, last = seeds[starts], seeds[starts + lengths - 1]
    name, at = first & HIGH, (first & ~HIGH).astype(np.int64)
    left = np.flatnonzero((first == last) & (at - starts >= SIDE))
    right = np.flatnonzero((first == last) & (at - (starts + lengths - 1) < SIDE))
    name[left] |= _side(data, at[left] - SIDE, SIDE) << np.uint64(16)
    name[right] |= _side(data, at[right] + SEED_BYTES, LENGTH - SEED_BYTES - SIDE + 1)
    return name


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes, or of one row."""
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = int(upto[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield begin, end
        begin = end


def _runs_of_piece(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = b"".join(texts)
    seeds = window_seeds(data)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    edge = np.ones(len(seeds) + 1, dtype=bool)
    edge[1:-1] = (seeds[1:] ^ seeds[:-1]) & HIGH != 0
    edge[np.minimum(np.concatenate([begin, begin + np.maximum(sizes - LENGTH + 1, 0)]), len(seeds))] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(starts)
    starts = starts[:-1]
    text = np.searchsorted(begin, starts, side="right") - 1
    real = starts + LENGTH <= (begin + sizes)[text]  # windows that lie in one text
    starts, lengths, text = starts[real], lengths[real], text[real]
    return _names(data, seeds, starts, lengths), text, starts - begin[text], lengths


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, text, first window and number of windows of every run of windows with one seed."""
    pieces = []
    for begin, end in slices(np.array([len(t) for t in texts], dtype=np.int64), PIECE_BYTES):
        name, text, start, length = _runs_of_piece(texts[begin:end])
        pieces.append((name, text + begin, start, length))
    return tuple(map(np.concatenate, zip(*pieces or [_runs_of_piece([])])))


def packed(text: str) -> Column:
    """Texts as they travel to another task."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for texts in batches:
            yield texts.map(squeeze)

    return pack(text)


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with column text, or packed, and the texts of each."""
    sizes = batch.column("n") if "n" in batch.schema.names else pc.binary_length(batch.column("text"))
    for begin, end in slices(sizes.to_numpy(zero_copy_only=False).astype(np.int64), SHARD_BYTES):
        part = batch.slice(begin, end - begin)
        if "packed" in batch.schema.names:
            unpack = zstandard.ZstdDecompressor().decompress
            yield part, [unpack(t) for t in part.column("packed").to_pylist()]
        else:
            yield part, part.column("text").to_pylist()


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance: those of sorted numbers pack well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplaned(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _of_several(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have a key of several rows; row -1 stands for several."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    by = np.argsort(key, kind="stable")
    key, row = key[by], row[by]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
    least = np.minimum.reduceat(row, first)
    several = (least < 0) | (least != np.maximum.reduceat(row, first))
    out = np.empty(len(key), dtype=bool)
    out[by] = np.repeat(several, np.diff(first, append=len(key)))
    return out


def shared(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries share a seed and a side of it with another row.

    A name without sides shares its seed with all names of that seed.
    """
    hit = np.zeros(len(name), dtype=bool)
    for other in (np.uint64(0xFFFF), np.uint64(0xFFFF0000)):
        has = np.flatnonzero(name & ~HIGH & ~other)
        hit[has] |= _of_several(name[has] & ~other, row[has])
    bare = name & ~HIGH == 0
    if bare.any():
        near = np.flatnonzero(np.isin(name & HIGH, name[bare]))
        hit[near] |= _of_several(name[near] & HIGH, row[near])
    return hit


def repeated_names(docs: DataFrame) -> DataFrame:
    """row, name: the names of each row's runs that share their seed and a side of it with other rows.

    Names are hashes; one shared by chance costs time only.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shards(batch):
                name, text, _, _ = runs(texts)
                if not len(name):
                    continue
                row = part.column("row").to_numpy()
                by = np.argsort(name, kind="stable")  # texts of a name stay in order
                name, text = name[by], text[by]
                new = (np.diff(name, prepend=name[:1] + np.uint64(1)) != 0) | (np.diff(text, prepend=-1) != 0)
                name, text = name[new], text[new]
                several = shared(name, text)
                # What repeats inside the shard is settled here and goes on as one entry.
                yield pa.RecordBatch.from_pydict({
                    "to": pa.array(row[text[several]] % parts, pa.int32()), "row": pa.array(row[text[several]]),
                    "name": pa.array(name[several].view(np.int64)),
                    "names": pa.nulls(int(several.sum()), pa.binary()), "texts": pa.nulls(int(several.sum()), pa.binary()),
                })
                first = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)))
                name, text = name[first], np.where(several[first], KNOWN, row[text[first]] - row[0]).astype(np.uint32)
                to = ((name >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[by], np.arange(parts + 1))
                full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                yield pa.RecordBatch.from_pydict({
                    "to": pa.array(full, pa.int32()), "row": pa.array([int(row[0])] * len(full), pa.int64()),
                    "name": pa.nulls(len(full), pa.int64()),
                    "names": pa.array([_planes(name[by[cuts[p] : cuts[p + 1]]]) for p in full], pa.binary()),
                    "texts": pa.array([_planes(text[by[cuts[p] : cuts[p + 1]]]) for p in full], pa.binary()),
                })

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = [], []
        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("names")))
            if len(settled):
                yield settled.select(["row", "name"])
            blocks = batch.filter(pc.is_valid(batch.column("names")))
            for first, a, b in zip(*(blocks.column(c).to_pylist() for c in ("row", "names", "texts"))):
                text = _unplaned(b, "<u4")
                names.append(_unplaned(a, "<u8"))
                rows.append(np.where(text == KNOWN, -1, first + text.astype(np.int64)))
        if names:
            name, row = np.concatenate(names), np.concatenate(rows)
            hit = shared(name, row) & (row >= 0)
            yield pa.RecordBatch.from_pydict({"row": pa.array(row[hit]), "name": pa.array(name[hit].view(np.int64))})

    packed = docs.select("row", "text").mapInArrow(collect, "to int, row long, name long, names binary, texts binary")
    return packed.repartition("to").mapInArrow(match, "row long, name long")


def _least_owners(runs: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each distinct run, in order of appearance, and which of them each run is."""
    code = runs.dictionary_encode().indices.to_numpy()
    least = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    return least, code


def _cut_runs(docs: DataFrame) -> DataFrame:
    """The runs with repeated names (column names) of each row, folded by shard.

    Columns: name (the seed), run (bytes), id, row, start.  A run whose bytes a smaller document has in the same shard
    needs no search; it comes without bytes, its length in ``size``, and a name of its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shards(batch):
                name, text, start, length = runs(texts)
                ids, row, wanted = part.column("id").to_numpy(), part.column("row").to_numpy(), part.column("names")
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                hit = np.concatenate([
                    np.flatnonzero(np.isin(name[a:b], wanted[i].values.to_numpy().view(np.uint64))) + a
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
                ])
                if not len(hit):
                    continue
                name, text, start, size = name[hit], text[hit], start[hit], length[hit] + LENGTH - 1
                found = [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), (start + size).tolist())]
                run = pa.array(found, pa.binary())
                least, code = _least_owners(run, ids[text])
                live = ids[text] == least[code]
                own = (row[text] * 0x9E3779B1 + start) & 0xFFFFFFFFFFFF
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(live, (name >> np.uint64(32)).astype(np.int64), own)),
                        pc.if_else(pa.array(live), run, pa.scalar(None, pa.binary())),
                        pa.array(ids[text], mask=~live), pa.array(row[text]), pa.array(start), pa.array(size),
                    ],
                    names=["name", "run", "id", "row", "start", "size"],
                )

    return docs.mapInArrow(cut, "name long, run binary, id long, row long, start long, size long")


def merged_blocks(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' Burrows-Wheeler transforms up to ``length`` symbols, up to five at a time.

    A shard is an array of symbols from 1 to 255, with 0 after each string.  Returns the positions
    (in the shards put together) in merged order, and the block of each: equal for suffixes that
    agree in ``length`` symbols, as far as no end of a string is among them.
    """
    stride = max(d for d in range(1, 6) if length % d == 0)
    orders, grams, offset = [], [], 0
    for symbols in shards:
        order = _suffix_array(symbols)
        before = symbols.take(np.arange(-stride, len(symbols)), mode="wrap").astype(np.uint64)  # the shard is a circle
        back = np.zeros(len(symbols), dtype=np.uint64)  # the symbols in front of each position
        for i in range(stride):
            back = (back << np.uint64(8)) | before[i : i + len(symbols)]
        grams.append(back[order])
        orders.append(order + offset)
        offset += len(symbols)
    found, transform = np.unique(np.concatenate(grams), return_inverse=True)
    transform, places = transform.astype(np.min_scalar_type(len(found))), np.concatenate(orders)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    block = np.zeros(len(source), dtype=np.int32)
    symbol = np.empty_like(transform)
    for _ in range(length // stride):
        # The i-th entry of a source in the interleave is the i-th of its transform.
        symbol[np.argsort(source, kind="stable")] = transform
        step = np.argsort(symbol, kind="stable")
        source, block, sorted_ = source[step], block[step], symbol[step]
        split = (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])
        block = np.zeros(len(source), dtype=np.int32)
        np.cumsum(split, out=block[1:])
    out = np.empty_like(places)
    out[np.argsort(source, kind="stable")] = places
    return out, block


def _suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order; of two strings' ends the first comes first."""
    ends = np.flatnonzero(symbols == 0)
    numbers = symbols.astype(np.int64) + len(ends)
    numbers[ends] = np.arange(1, len(ends) + 1)
    return suffix_order(numbers, len(symbols))


def _marked(strings: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins in all of them, with one more place after each, and a mask of these places.

    Marked are the windows that also begin in a string of a smaller owner.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    present = np.zeros(256, dtype=bool)
    inside = np.ones(len(data), dtype=bool)
    inside[ends] = False
    present[data[inside]] = True
    if present.all():
        raise ValueError("a text holds all 256 bytes, so it is not UTF-8")
    code = np.cumsum(present).astype(np.uint8)  # 1 to 255; UTF-8 leaves out 13 bytes
    symbols = np.where(inside, code[data], 0).astype(np.uint8)
    begin = ends - sizes
    limit = max(1, len(symbols) // TRANSFORMS)
    cuts = np.unique(np.searchsorted(begin // limit, np.arange(len(symbols) // limit + 2)))
    edges = [int(begin[c]) if c < len(strings) else len(symbols) for c in cuts]
    shards = [symbols[a:b] for a, b in zip(edges, edges[1:]) if b > a]
    order, block = merged_blocks(shards, length)
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    left = np.repeat(ends, sizes + 1) - np.arange(len(symbols))
    whole = left[order] >= length
    order, block = order[whole], block[whole]
    mark = np.zeros(len(symbols), dtype=bool)
    if len(order):
        owner = owners[string[order]]
        first = np.flatnonzero(np.diff(block, prepend=-1))
        least = np.repeat(np.minimum.reduceat(owner, first), np.diff(first, append=len(block)))
        mark[order] = owner > least
    return begin, mark


def repeats(strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the windows that also begin in a string of a smaller owner, as a mask."""
    begin, mark = _marked(strings, owners, length)
    return [mark[b : b + max(0, len(s) - length + 1)] for b, s in zip(begin, strings)]


def _search(found: DataFrame) -> DataFrame:
    """row, start, end of what goes, from the runs of each name."""

    def spans_of(chunk: pa.Table) -> pa.RecordBatch:
        name, key, row, start = (chunk.column(c).to_numpy() for c in ("name", "id", "row", "start"))
        run = chunk.column("run").combine_chunks()
        least, code = _least_owners(run, key)
        first = np.full(len(least), -1)  # an entry of each distinct run
        first[code] = np.arange(len(code))
        _, group, sizes = np.unique(name[first], return_inverse=True, return_counts=True)
        # A name with one run is one string: its transform has no other to be merged with.
        merged = np.flatnonzero(sizes[group] > 1)
        begin, mark = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        if len(merged):
            begin, mark = _marked(run.take(pa.array(first[merged])).to_pylist(), least[merged], LENGTH)
        edges = np.diff(mark.astype(np.int8), prepend=0, append=0)  # no mark reaches the end of a string
        lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        string = np.searchsorted(begin, lo, side="right") - 1
        lo, hi = lo - begin[string], hi - begin[string] + LENGTH - 1
        spans = np.zeros(len(least) + 1, dtype=np.int64)
        spans[merged + 1] = np.bincount(string, minlength=len(merged))
        before = np.cumsum(spans)
        whole = key > least[code]
        own = np.flatnonzero(~whole & (spans[code + 1] > 0))
        times = spans[code[own] + 1]
        at = np.arange(times.sum()) + np.repeat(before[code[own]] - np.cumsum(times) + times, times)
        own = np.repeat(own, times)
        whole = np.flatnonzero(whole)
        end = start[whole] + pc.binary_length(run).to_numpy(zero_copy_only=False)[whole]
        columns = (row[own], row[whole]), (start[own] + lo[at], start[whole]), (start[own] + hi[at], end)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["row", "start", "end"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("run")))
            if len(settled):
                end = pc.add(settled.column("start"), settled.column("size"))
                yield pa.RecordBatch.from_arrays([settled.column("row"), settled.column("start"), end], names=["row", "start", "end"])
            live = batch.filter(pc.is_valid(batch.column("run")))
            while len(live):
                name, upto = live.column("name").to_numpy(), size + np.cumsum(live.column("size").to_numpy())
                last = chunk[-1].column("name")[-1].as_py() if chunk else name[0]
                new = np.diff(name, prepend=last) != 0  # runs of one name stay together
                full = np.flatnonzero(new & (np.concatenate([[size], upto[:-1]]) >= CHUNK_BYTES))
                part = live.slice(0, full[0]) if len(full) else live
                if len(part):
                    chunk.append(part)
                if not len(full):
                    size = int(upto[-1])
                    break
                yield spans_of(pa.Table.from_batches(chunk))
                chunk, size, live = [], 0, live.slice(full[0])
        if chunk:
            yield spans_of(pa.Table.from_batches(chunk))

    return found.repartition("name").sortWithinPartitions("name").mapInArrow(search, "row long, start long, end long")


def removed_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id, packed text, bytes n) and, for those that lose bytes, row and spans.

    Both the search and the caller join the same packed rows, so one exchange serves both.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    named = rows.where("id IS NOT NULL")
    names = repeated_names(named).groupBy("row").agg(F.collect_list("name").alias("names"))
    texts = written(named.select("row", "id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n")))
    least = texts.groupBy("sha").agg(F.min("id").alias("least"))
    copies = written(
        texts.join(least, "sha").where(f"id > least AND n >= {LENGTH}")
        .select("row", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    )
    searched = names.join(copies.select("row"), "row", "left_anti")
    sent = rows.select("row", "id", packed("text").alias("packed"), F.octet_length("text").cast("long").alias("n"))
    found = _search(_cut_runs(sent.join(searched, "row").select("row", "id", "packed", "n", "names")))
    spans = found.unionAll(copies).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return sent, spans


def kept_bytes(text: bytes, spans: Sequence[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the number of removed bytes and of maximal removed runs."""
    if spans is None or not len(spans):
        return text, 0, 0
    kept, end, n_spans = [], 0, 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a > end or not n_spans:
            kept.append(text[end:a])
            n_spans += 1
        end = max(end, b)
    left = b"".join([*kept, text[end:]])
    return left, len(text) - len(left), n_spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that is covered by a 50-byte string which also starts in a document with a smaller id.
    Texts are UTF-8 bytes, a null text is empty.  Rows with equal ids are not each other's smaller
    documents, so repeated rows take nothing from each other.  Rows without an id stay whole and
    take nothing from others.  Ids are numbers.  Other columns are ignored; an empty table gives
    no rows.  ``docs`` must be a table that is read in the same order each time, as files are.
    """
    sent, spans = removed_spans(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            texts = [unpack(t) for t in batch.column("packed").to_pylist()]
            kept = [kept_bytes(t, s) for t, s in zip(texts, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "row": batch.column("row"),
                "kept": pa.array([k for k, _, _ in kept], pa.binary()),
                "n_bytes": batch.column("n"),
                "n_removed": pa.array([n for _, n, _ in kept], pa.int64()), "n_spans": pa.array([n for _, _, n in kept], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in kept]),
            })

    cut_rows = sent.join(spans, "row", "left").mapInArrow(
        cut, "id long, row long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return cut_rows.withColumnRenamed("id", id_col)


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with their repeated strings cut out, all columns kept.

    A character goes if one of its bytes does.  ``length_col``, if there is one, becomes the number
    of characters left.  A document goes if it had a text and nothing is left of it.
    """
    _, spans = removed_spans(docs, id_col, text_col)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, removed in batches:
            kept = (kept_bytes(t, s)[0].decode("utf-8", "ignore") if s is not None else None for t, s in zip(texts, removed))
            yield pd.Series(list(kept), dtype=object)

    columns = docs.columns
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc"))
    text = F.col("doc")[text_col]
    cut_rows = rows.join(spans, "row", "left").withColumn("kept", cut(text.cast("binary"), F.col("spans")))
    left = cut_rows.where(F.col("spans").isNull() | (F.col("kept") != ""))
    touched = F.col("spans").isNotNull()
    new = {
        text_col: F.when(touched, F.col("kept")).otherwise(text),
        length_col: F.when(touched, F.length("kept")).otherwise(F.col("doc")[length_col]).cast("long") if length_col in columns else None,
    }
    return left.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in columns])
