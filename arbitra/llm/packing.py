"""Documents cut into token sequences of power-of-two lengths.

A document's tokens are split into as many pieces of the greatest length as fit, and the rest into
the powers of two of its binary number, longest first.  Pieces of one length form a bucket and a
piece is a whole sequence of its bucket: no sequence crosses documents and none is padded (the data
set decomposition of Pouransari et al. 2024).

Texts are tokenised by the vocabulary's own library.  White space ends every token and joins with
nothing when normalised, so the ids of a text are those of its words in a row; a worker asks the
library once for each word it has not seen and keeps short words up to a bound, which changes
speed only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import global_row_number
from arbitra.llm.tables import written
from arbitra.llm.tokens import byte_symbols

MAX_TOKENS = 4096
KEPT_WORD = 24
KEPT_WORDS = 400_000
#: A word of letters and then marks that no rule of the vocabulary joins with letters.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*&%#]*)")
#: Bytes of a text that are split into words at a time, and of ids in a batch of pieces.
SLICE = 1 << 20
BATCH_BYTES = 8 << 20


class Words:
    """Ids of words as little-endian unsigned 32-bit numbers.

    Short words are kept in two generations: when the young one is full it replaces the old one.
    """

    def __init__(self, path: str):
        # Spark runs a worker on every core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.symbols = byte_symbols()

    def run(self, run: str) -> bytes:
        """Ids of one run of letters or of marks, straight from the merges of the library."""
        found = self.runs.get(run)
        if found is None:
            symbols = "".join([self.symbols[b] for b in run.encode("utf-8")])
            ids = [t.id for t in self.library.model.tokenize(symbols)]
            found = self.runs[run] = pack("<%dI" % len(ids), *ids)
        return found

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept; of those too long to keep they are returned.

        Letters of Latin-1, which normalising leaves as they are, and marks behind them need the
        library's merges only; all other words go through the whole library.
        """
        if len(self.runs) > KEPT_WORDS:
            self.runs.clear()
        young, long, rest = self.young, {}, []
        for word in words:
            text = word.decode("utf-8", "replace")
            plain = PLAIN_WORD.fullmatch(text) if len(word) <= KEPT_WORD else None
            if plain is None:
                rest.append((word, text))
            else:
                letters, marks = plain.groups()
                young[word] = (self.run(letters.lower()) + self.run(marks)) if marks else self.run(letters.lower())
        if rest:
            found = self.library.encode_batch_fast([text for _, text in rest], add_special_tokens=False)
            for (word, _), made in zip(rest, found):
                ids = made.ids
                (young if len(word) <= KEPT_WORD else long)[word] = pack("<%dI" % len(ids), *ids)
        return long

    def ids(self, words: list[bytes]) -> bytes:
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        young = self.young
        new = set(words).difference(young)
        if not new:
            return b"".join(map(young.__getitem__, words))
        old = self.old
        young.update([(w, old[w]) for w in new if w in old])
        long = self.learn([w for w in new if w not in old])
        if not long:
            return b"".join(map(young.__getitem__, words))
        return b"".join([young[w] if w in young else long[w] for w in words])

    def text_ids(self, text: bytes) -> bytes:
        """The ids of a whole text, a slice that ends with a word at a time."""
        if len(text) <= SLICE:
            return self.ids(text.split())
        return b"".join(self.ids(part.split()) for part in slices(text))


def slices(text: bytes) -> Iterator[bytes]:
    """Parts of about ``SLICE`` bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            spaces = [i for i in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if i >= 0]
            end = min(spaces, default=len(text))
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(
    docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens.

    ``ids`` are the piece's token ids, four bytes each, little-endian; ``doc_tokens`` counts the
    document's tokens with ``end_id``, which ends every document.  ``vocabulary`` is the path of the
    tokenizer file on every executor; added special tokens are left out.  A null or blank text is
    ``end_id`` alone.  Repeated rows and repeated or null ids are cut row by row, other columns are
    ignored whatever their names, an empty table gives no rows.  A task holds the ids of one text
    and one batch of pieces.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    last = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    fields = pa.schema([("at", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def batch_of(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), fields.types)], schema=fields)
        return pa.RecordBatch.from_arrays([ids.take(made.column(0)), *made.columns[1:]], ["id", *fields.names[1:]])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in batches:
            found, size = [], 0
            for i, text in enumerate(batch.column(1)):
                ids, start = words.text_ids(text.as_py()) + last, 0
                total = len(ids) // 4
                for length in piece_lengths(total, max_tokens):
                    found.append((i, start, length, ids[4 * start : 4 * (start + length)], total))
                    start, size = start + length, size + 4 * length
                    if size > BATCH_BYTES:
                        yield batch_of(batch.column(0), found)
                        found, size = [], 0
            if found:
                yield batch_of(batch.column(0), found)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long").withColumnRenamed("id", id_col)


def sequences(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id (longest bucket first, then by id and start) and offset, always 0.

    Numbers run from 0 without gaps through one bucket after the other and do not depend on how
    the input is split.  Pieces that are equal in every column share their numbers out in any
    order.  Columns beside those of ``pieces`` stay; ``sequence_id`` and ``offset`` are replaced.
    The pieces are written first, so that sorting them does not tokenise again.
    """
    pieces_written = written(cut.drop("sequence_id", "offset"))
    ties = [F.hash(c) if kind == "binary" else F.col(c) for c, kind in pieces_written.dtypes if c not in ("length", id_col, "start") and not kind.startswith(("map", "variant"))]
    order = [F.desc("length"), F.asc(id_col), F.asc("start"), *ties, F.monotonically_increasing_id()]
    numbered = global_row_number(pieces_written, order, "sequence_id")
    return numbered.withColumns({"sequence_id": F.col("sequence_id") - 1, "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, each of rows of one size that a trainer can batch as they are."""
    packed.repartition("length", F.pmod(F.xxhash64("sequence_id"), F.lit(64))).write.partitionBy("length").parquet(path)
