"""Token counts by a tokenizer compiled to a deterministic transducer.

The vocabulary file (lower-cased words, byte-pair merges with an end-of-word mark) becomes a
machine whose states hold what the merges still need to know of the current word: the characters
that a longer token could begin with, and the last token before each of them.  A transition reads
one character and is annotated with the number of tokens that are settled with it; white space
leads every state back to the start.  States and transitions are compiled when first needed and
kept by the worker up to a bound, which changes speed only.

A text is cut into chunks of a fixed number of characters that are counted in parallel.  White
space forgets the state, so the map of a chunk from entry to exit state is fully given by the
characters before its first white space, the count between, and the characters after its last.
Such maps compose associatively: a row's maps are combined in chunk order, and what crosses the
chunk borders is counted on the combined map.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the vocabulary's file splits a text into words (a fixed value of that file).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V1)
#: The same over lower-cased ASCII.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
MAX_STATES = 300_000
KEPT_WORD = 10
CHUNK = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


class Merges:
    """Tokens and merges of a vocabulary file, and which tokens may follow each other.

    A sequence of tokens is what the merges make of its symbols exactly if that holds for every
    two neighbours.  So the last token of each prefix of a word, which is unique, can be found from
    the last tokens of shorter prefixes; no word has to be merged as a whole.
    """

    def __init__(self, model: dict):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        #: token as its symbols (the mark belongs to the last one) -> the token
        self.tokens = {self.split(t): t for t in model["vocab"]}
        self.tokens |= {(c,): c for c in self.symbols} | {(c + self.end,): c + self.end for c in self.symbols}
        self.starts = {t[:i] for t in self.tokens for i in range(len(t))} | {()}
        self.follows: dict[tuple, bool] = {}

    def split(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """The merges applied one by one: always the lowest rank, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            ranked = [(self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: tuple[str, ...] | None, right: tuple[str, ...]) -> bool:
        found = self.follows.get((left, right))
        if found is None:
            if len(self.follows) > MAX_STATES:
                self.follows.clear()
            want = [self.tokens[t] for t in (left, right) if t is not None]
            found = self.follows[left, right] = self.merged((left or ()) + right) == want
        return found


class Run:
    """What the merges need to know of a run's symbols so far.

    ``tail`` are the last symbols that a longer token could begin with, ``lasts`` the last token of
    the run as it ends before each of them and after them, ``counts`` the tokens up to there,
    relative to the first.
    """

    __slots__ = ("tail", "lasts", "counts", "after", "last")

    def __init__(self, tail: tuple[str, ...], lasts: tuple, counts: tuple[int, ...]):
        self.tail, self.lasts, self.counts = tail, lasts, counts
        self.after: dict[str, tuple[Run, int]] = {}
        self.last: dict[str, int] = {}

    def last_token(self, symbol: str, merges: Merges) -> tuple[tuple[str, ...], int]:
        """The last token if this symbol comes next, and the count with it."""
        for j in range(len(self.lasts)):
            token = (*self.tail[j:], symbol)
            if token in merges.tokens and merges.may_follow(self.lasts[j], token):
                return token, self.counts[j] + 1
        raise ValueError(f"no token ends with {symbol!r}")


class Machine:
    """The transducer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.reset()

    def reset(self) -> None:
        self.runs: dict[tuple, Run] = {}
        self.words = Words(self)
        self.start = self.run((), (None,), (0,))

    def run(self, tail: tuple, lasts: tuple, counts: tuple) -> Run:
        found = self.runs.get((tail, lasts, counts))
        if found is None:
            found = self.runs[tail, lasts, counts] = Run(tail, lasts, counts)
        return found

    def _next(self, run: Run, symbol: str) -> tuple[Run, int]:
        token, count = run.last_token(symbol, self.merges)
        tail, lasts, counts = (*run.tail, symbol), (*run.lasts, token), (*run.counts, count)
        drop = 0
        while tail[drop:] not in self.merges.starts:
            drop += 1
        emitted = counts[drop]
        return self.run(tail[drop:], lasts[drop:], tuple(c - emitted for c in counts[drop:])), emitted

    def moved(self, run: Run, char: str) -> tuple[Run, int]:
        """The transition by a character that isn't the word's last, and the tokens it emits."""
        at, total = run, 0
        for byte in char.encode("utf-8"):
            at, n = self._next(at, self.merges.symbols[byte])
            total += n
        run.after[char] = at, total
        return at, total

    def closed(self, run: Run, char: str) -> int:
        """Tokens emitted by the transition back to the start with a word's last character."""
        at, total = run, 0
        *body, end = char.encode("utf-8")
        for byte in body:
            at, n = self._next(at, self.merges.symbols[byte])
            total += n
        total += at.last_token(self.merges.symbols[end] + self.merges.end, self.merges)[1]
        run.last[char] = total
        return total

    def count(self, word: str) -> int:
        run, total, end = self.start, 0, word[-1]
        for char in word[:-1]:
            step = run.after.get(char) or self.moved(run, char)
            run = step[0]
            total += step[1]
        n = run.last.get(end)
        return total + (self.closed(run, end) if n is None else n)

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special strings."""
        ascii_only = text.isascii()
        if not ascii_only:
            text = unicodedata.normalize("NFC", text)
        # lower() looks at neighbours for the capital sigma only; the vocabulary's library never does.
        text = text.replace("Σ", "σ").lower()
        if len(self.runs) > MAX_STATES or len(self.words) > MAX_STATES:
            self.reset()
        words = self.words
        return sum([words[w] for w in (ASCII_WORD if ascii_only else WORD).findall(text)])

    def tokens(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        return len(self.special.findall(text)) + sum(map(self.ordinary, self.special.split(text)))


class Words(dict):
    """Transitions by whole short words, composed of those by their characters."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) <= KEPT_WORD:
            self[word] = n
        return n


#: At these characters chunks may be cut in thought: they join with no neighbour when normalised.
RESET = re.compile(r"[ \t\n\r\f\v]")


@lru_cache(maxsize=4)
def machine(path: str) -> Machine:
    return Machine(path)


def chunk_map(text: str, m: Machine) -> tuple[str, int]:
    """What crosses the chunk's borders (with a space where white space was), and the count between."""
    first = RESET.search(text)
    if first is None:
        return text, 0
    last = max(text.rfind(c) for c in " \t\n\r\f\v")
    return text[: first.start()] + " " + text[last + 1 :], m.tokens(text[first.start() : last])


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens.

    ``vocabulary`` is the path of the tokenizer file on every executor.  Counts are those of the
    file's own library, without added special tokens.  A null text counts as empty.  Repeated
    rows and repeated ids are counted row by row, other columns are ignored, an empty table gives
    no rows.  Chunks of one row share a key that is unique per row, so no group is hot.
    """

    @F.pandas_udf("struct<edge string, n long>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = machine(vocabulary)
        for texts in batches:
            yield pd.DataFrame([chunk_map(t, m) for t in texts], columns=["edge", "n"])

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(vocabulary)
        for texts in batches:
            yield texts.map(m.tokens)

    text = F.coalesce(F.col(text_col), F.lit(""))
    n_chunks = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    chunks = rows.select(
        "row", "id", F.octet_length("text").cast("long").alias("n_bytes"), "text",
        F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("i"),
    ).select("row", "id", "n_bytes", "i", mapped(F.substring("text", F.col("i") * chunk + 1, F.lit(chunk))).alias("m"))
    return (
        chunks.groupBy("row")
        .agg(
            F.first("id").alias(id_col), F.first("n_bytes").alias("n_bytes"), F.sum("m.n").alias("inner"),
            F.array_sort(F.collect_list(F.struct("i", "m.edge"))).alias("edges"),
        )
        .select(
            id_col, "n_bytes",
            (F.col("inner") + counted(F.array_join("edges.edge", ""))).cast("long").alias("n_tokens"),
        )
    )


def over_limit(n_tokens: Column, limit: int) -> Column:
    return n_tokens > limit
