"""Repair of conversations by the cheapest edits of their rows, with an audit of them.

Rows are kept, given another role, deleted, or inserted, so that the initials of the roles read
``(s?(ua)+)?``.  Four states say where in that pattern a conversation stands.  A dynamic program over
its rows keeps, for each state, the cheapest edits and among those the least audit string.  Audits
share their beginnings: an audit is a node that holds its last letter and a link to the audit
before it, with binary-lifting ancestors and a rolling hash.  Audits of equal cost are compared at
the end of their longest common prefix, which is searched through the ancestors' hashes; equal
hashes are verified letter by letter where the links do not meet by themselves.

Rows are put in order by one range-partitioned sort, so no conversation has to lie in one task.
Blocks of the numbered rows are worked on by themselves: a conversation that begins in an earlier
block gets an audit for every state that it could be in by then, and blocks are joined like that by
up to ``FAN`` at a time.  What one task must see in a row is only what the results themselves need
whole: an audit string, and the bytes under a conversation's digest, which are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import global_row_number
from arbitra.llm.tables import written

SPACES = " \t\n\v\f\r"
#: Rows of a block, and audits of blocks joined at a time.
BLOCK, FAN = 2048, 64

START, SYSTEM, USER, PAIRED = range(4)
#: (state, role initial) -> state: the pattern ``(s?(ua)+)?``, which may end in START and PAIRED.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRED, (PAIRED, "u"): USER}
FINAL = (START, PAIRED)
#: State after an inserted or renamed row, whose role is user or assistant.
MADE = {START: USER, SYSTEM: USER, PAIRED: USER, USER: PAIRED}
LEGAL = {"su", "ua", "au"}
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

PRIME, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audit strings that share their beginnings; an audit is the number of its last node."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        #: Ancestors 1, 2, 4, ... letters before a node; the root has none.
        self.up: list[list[int]] = [[]]

    def add(self, at: int, letter: str) -> int:
        node, step = len(self.letter), at
        self.letter.append(letter)
        self.depth.append(self.depth[at] + 1)
        self.hash.append((self.hash[at] * BASE + ord(letter)) % PRIME)
        ups, k = [at], 0
        while k < len(self.up[step]):
            step = self.up[step][k]
            ups.append(step)
            k += 1
        self.up.append(ups)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lifted(self, node: int, depth: int) -> int:
        above = self.depth[node] - depth
        while above:
            k = above.bit_length() - 1
            node, above = self.up[node][k], above - (1 << k)
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two audits of one depth are equal, given that their hashes are."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit at a comes before that at b; a beginning comes before what it begins."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, depth), self._lifted(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(depth.bit_length() - 1, -1, -1):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


Best = list[tuple[int, int] | None]


class Edits:
    """Cheapest edits of a run of rows from one state on, as cost and audit by state."""

    def __init__(self, entry: int):
        self.audits = Audits()
        self.best: Best = [None] * 4
        self.best[entry] = (0, 0)
        self._inserted()

    def _offer(self, best: Best, state: int, cost: int, at: int, letter: str) -> bool:
        now = best[state]
        if now is not None and (now[0] < cost or now[0] == cost and now[1] == at):
            return False
        node = self.audits.add(at, letter)
        if now is not None and now[0] == cost and not self.audits.less(node, now[1]):
            return False
        best[state] = (cost, node)
        return True

    def _inserted(self) -> None:
        again = [q for q in range(4) if self.best[q] is not None]
        while again:
            q = again.pop()
            cost, node = self.best[q]
            if self._offer(self.best, MADE[q], cost + INSERT, node, "I"):
                again.append(MADE[q])

    def row(self, initial: str, fault: int) -> None:
        after: Best = [None] * 4
        more = UNFINISHED if fault == TRUNCATED else 0
        for q, found in enumerate(self.best):
            if found is None:
                continue
            cost, node = found
            self._offer(after, q, cost + DELETE, node, "D")
            if fault in (OK, TRUNCATED):
                kept = MOVES.get((q, initial))
                if kept is not None:
                    self._offer(after, kept, cost + KEEP + more, node, "K")
                self._offer(after, MADE[q], cost + REROLE + more, node, "R")
        self.best = after
        self._inserted()

    def found(self) -> list[tuple[int, int, str]]:
        return [(q, b[0], self.audits.text(b[1])) for q, b in enumerate(self.best) if b is not None]


def joined(left: list[dict], right: list[dict]) -> list[dict]:
    """Maps (entry, exit, cost, audit) of two runs of rows, one after the other, as one map."""
    best: dict[tuple[int, int], tuple[int, list[tuple[str, str]]]] = {}
    for a in left:
        for b in right:
            if a["exit"] == b["entry"]:
                key, cost = (a["entry"], b["exit"]), a["cost"] + b["cost"]
                if key not in best or cost < best[key][0]:
                    best[key] = (cost, [(a["audit"], b["audit"])])
                elif cost == best[key][0]:
                    best[key][1].append((a["audit"], b["audit"]))
    return [{"entry": e, "exit": x, "cost": c, "audit": min(p + q for p, q in parts)} for (e, x), (c, parts) in best.items()]


def in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, g: rows numbered by conversation and turn, nulls first.

    A null role or text becomes one space.  Rows of one turn follow their role and then the SHA-256
    of their text; which of several equal rows comes first makes no difference.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.sha2("text", 256), F.monotonically_increasing_id()]
    return global_row_number(plain, order, "g")


def _key(conv: str = "conv") -> Column:
    """One string for (conversation, role, text), which no other three have."""
    conv_text = F.coalesce(F.concat(F.lit("+"), F.col(conv).cast("string")), F.lit("-"))
    return F.sha2(F.concat(conv_text, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def faults(ordered: DataFrame) -> DataFrame:
    """conv, turn, g, initial, fault: each row's first fault, without the texts."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    seen = ordered.select("conv", "turn", "g", F.substring("role", 1, 1).alias("initial"), end.alias("end"), _key().alias("key"))
    seen = written(seen)
    again = seen.groupBy("key").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    kind = (
        F.when(F.col("end") == "", BLANK).when(F.col("g") > F.col("first"), DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    )
    return written(seen.join(again, "key", "left").select("conv", "turn", "g", "initial", kind.alias("fault")))


MAPS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
#: A run of rows of one conversation: its first row, initials at its ends, illegal neighbours, edits.
RUN = "conv {}, g long, first string, last string, illegal long, maps " + MAPS


def _run(g: int, initials: list[str], kinds: list[int], entries: Iterable[int]) -> tuple:
    maps = []
    for entry in entries:
        edits = Edits(entry)
        for initial, fault in zip(initials, kinds):
            edits.row(initial, fault)
        maps += [{"entry": entry, "exit": q, "cost": cost, "audit": audit} for q, cost, audit in edits.found()]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return g, initials[0], initials[-1], illegal, maps


def _runs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, block by block -> runs.  Holds the rows of one run."""
    columns = ["conv", "g", "first", "last", "illegal", "maps"]
    none = object()
    at, conv, initials, kinds, entries, g = -1, none, [], [], [START], 0
    for frame in frames:
        out = []
        convs = frame.conv.astype(object).where(frame.conv.notna(), None)
        for c, block, n, initial, fault in zip(convs, frame.block, frame.g, frame.initial, frame.fault):
            if block != at or c != conv:
                if initials:
                    out.append((conv, *_run(g, initials, kinds, entries)))
                entries = range(4) if block != at else [START]
                at, conv, initials, kinds, g = block, c, [], [], n
            initials.append(initial)
            kinds.append(fault)
        yield pd.DataFrame(out, columns=columns)
    if initials:
        yield pd.DataFrame([(conv, *_run(g, initials, kinds, entries))], columns=columns)


def _joined_runs(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("g").to_dict("records")
    now = rows[0]
    for r in rows[1:]:
        illegal = now["illegal"] + r["illegal"] + (now["last"] + r["first"] not in LEGAL)
        now = now | {"last": r["last"], "illegal": illegal, "maps": joined(now["maps"], r["maps"])}
    return pd.DataFrame([now])[list(frame.columns)]


def audits(faulty: DataFrame) -> DataFrame:
    """conv, g, illegal, cost, audit: the cheapest edits of each conversation; g is its first row's."""
    conv_type = faulty.schema["conv"].dataType.simpleString()
    blocks = faulty.select("conv", "g", "initial", "fault", F.expr(f"g div {BLOCK}").alias("block"))
    runs = written(blocks.repartition("block").sortWithinPartitions("g").mapInPandas(_runs, RUN.format(conv_type)))
    ends = runs.groupBy("conv").agg(F.min("g").alias("start"), F.max("g").alias("end"), F.count(F.lit(1)).alias("n"))
    several = ends.where("n > 1")
    span = several.agg(F.max(F.expr(f"end div {BLOCK} - start div {BLOCK}"))).first()[0]
    whole = runs.join(ends.where("n = 1").select("start"), F.col("g") == F.col("start")).drop("start")
    if span:
        parts = runs.join(several.select(F.col("conv").alias("of"), "start"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
        step = BLOCK
        while span:
            near = F.expr(f"(g div {BLOCK} - start div {BLOCK}) div {step // BLOCK * FAN}")
            kept = parts.columns
            parts = written(parts.groupBy("start", near.alias("_near")).applyInPandas(_joined_runs, parts.schema).select(*kept))
            step, span = step * FAN, span // FAN
        whole = whole.unionByName(parts.drop("start"))
    ended = F.filter("maps", lambda m: (m["entry"] == START) & m["exit"].isin(*FINAL))
    best = F.array_min(F.transform(ended, lambda m: F.struct(m["cost"].alias("cost"), m["audit"].alias("audit"))))
    return written(whole.select("conv", "g", "illegal", best.alias("best")).select("conv", "g", "illegal", "best.cost", "best.audit"))


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit -> the rows it leaves: number of the row (null if inserted), place, role if given."""
    for batch in batches:
        for i, (first, audit) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            letters = np.frombuffer(audit.encode("ascii"), dtype="S1")
            g = first + np.cumsum(letters != b"I") - 1
            left = np.flatnonzero(letters != b"D")
            if not len(left):
                continue
            place, letter = np.arange(len(left)), letters[left]
            role = np.where((place - len(left) % 2) % 2 == 0, "user", "assistant")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.full(len(left), i))), pa.array(g[left], mask=letter == b"I"),
                    pa.array(place), pa.array(role.astype(object), pa.string(), mask=letter == b"K"),
                ],
                ["conv", "g", "place", "new_role"],
            )


def repaired_rows(ordered: DataFrame, audited: DataFrame) -> DataFrame:
    """conv, place, role, text: the rows that the audits leave, numbered from 0 in each conversation."""
    conv_type = audited.schema["conv"].dataType.simpleString()
    edits = written(audited.select("conv", "g", "audit").mapInArrow(_edits, f"conv {conv_type}, g long, place long, new_role string"))
    own = edits.where("g IS NOT NULL").join(ordered.select("g", "role", "text"), "g")
    made = edits.where("g IS NULL").select("conv", "place", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return own.select("conv", "place", F.coalesce("new_role", "role").alias("role"), "text").unionByName(made)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and place -> one digest per conversation; a row is held at a time."""
    now, first = None, None
    for batch in batches:
        done: list[tuple] = []
        for i, (place, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text")))):
            if place == 0:
                if now is not None:
                    done.append((first, now.hexdigest()))
                now, first = hashlib.sha256(), batch.column(0)[i]
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c.as_py() for c, _ in done], batch.column(0).type), pa.array([h for _, h in done])], ["conv", "digest"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first.as_py()], first.type), pa.array([now.hexdigest()])], ["conv", "digest"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv, digest: SHA-256 of each conversation's ``role:text`` lines."""
    conv_type = repaired.schema["conv"].dataType.simpleString()
    placed = repaired.repartition("conv").sortWithinPartitions("conv", "place")
    return placed.mapInArrow(_digests, f"conv {conv_type}, digest string")


def reports(faulty: DataFrame, audited: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = faulty.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated")
    )
    found = audited.select(F.col("conv").alias("of"), "illegal", "cost", "audit")
    return counted.join(found, F.col("conv").eqNullSafe(F.col("of"))).drop("of")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report per conversation, repaired rows: conv, place, role, text).

    Rows without a conversation id make up one conversation.  Nulls of roles and texts are one
    space, so their rows are blank or need a role; null turns come first.  Repeated rows are
    duplicates, empty texts blank, an empty table gives two empty results.  Other columns are
    ignored, whatever their names.  A conversation may be longer than any task holds, up to the
    2^31 bytes of its audit string.
    """
    ordered = in_order(conversations, conv_col, turn_col, role_col, text_col)
    faulty = faults(ordered)
    audited = audits(faulty)
    return reports(faulty, audited), repaired_rows(ordered, audited)
